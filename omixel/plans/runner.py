"""Phases of an analysis on one matrix, from scores to validation, with wall times: `python -m omixel.plans.runner --phases ...`."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..operators import enrich, impute, matrix, ml, resample, similarity, stats
from .tables import Tables


@dataclass
class Analysis:
    """Results by name; each phase reads those of the phases before it."""

    spark: SparkSession
    matrix: DataFrame
    samples: DataFrame
    membership: DataFrame
    scores_of_features: DataFrame
    config: Config = Config()
    results: dict[str, DataFrame] = field(default_factory=dict)
    times: dict[str, float] = field(default_factory=dict)
    heap: dict[str, float] = field(default_factory=dict)

    def impute(self) -> None:
        """The phases after it read a matrix without gaps in all features but those that lack more than `tier_2` of the samples.

        Features that lack at most `tier_1` are predicted from each other, those up to `tier_2` are drawn from the left tail."""
        features = self.matrix.select("feature").distinct()
        rates = matrix.missing_rate(self.matrix, features, self.samples.select("sample_id").distinct().count())
        tiers = matrix.tiers(rates, self.config.tier_1, self.config.tier_2).cache()
        near, far = tiers.filter("tier in ('Complete', 'Tier1')").select("feature"), tiers.filter("tier = 'Tier2'").select("feature")
        forests = impute.chained_forests(self.matrix.join(near, "feature", "left_semi"), self.samples, self.config.trees, self.config.impute_rounds, self.config.seed)
        gaps = far.join(self.samples.select("sample_id").distinct(), how="cross").join(self.matrix, ["sample_id", "feature"], "left_anti")
        drawn = impute.tail_draws(gaps, impute.tail_parameters(self.matrix), self.config.seed)
        cells = impute.assembled(self.matrix, self.samples, tiers, forests.unionByName(drawn)).cache()
        self.results["imputation_report"] = impute.accounting(cells)
        self.results["imputed_matrix"] = cells.select("sample_id", "feature", "full")
        self.matrix = cells.filter("full is not null").select("sample_id", "feature", F.col("full").alias("value"))

    @contextmanager
    def timed(self, phase: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.times[phase] = time.perf_counter() - began
        runtime = self.spark.sparkContext._jvm.Runtime.getRuntime()
        self.heap[phase] = (runtime.totalMemory() - runtime.freeMemory()) / 2**20

    def score(self) -> None:
        weight = enrich.weights(self.scores_of_features, self.config)
        es = enrich.ssgsea(self.matrix, self.membership, weight, self.samples, self.config).cache()
        self.results["scores"] = es
        self.results["summary"] = enrich.group_means(es, self.samples)

    def reduce(self) -> None:
        """Redundant sets go (one per cluster stays), then sets of low variance, then what bootstraps do not select."""
        es = self.results["scores"]
        ids = es.select("set_id").distinct()  # sets without scores take no part
        filled = es.withColumn("es", F.coalesce("es", F.avg("es").over(Window.partitionBy("set_id"))))
        correlation = stats.pairwise_correlation(filled, "set_id", "sample_id", "es")
        near = similarity.combined_similarity(similarity.jaccard_pairs(self.membership.join(ids, "set_id", "left_semi")), correlation)
        clusters = similarity.clusters(ids, near, (self.config.similarity,))
        order = ids.withColumn("ord", F.row_number().over(Window.orderBy("set_id")))  # of equal ones the first; average linkage bounds the sets
        iqrs = enrich.iqr(es)
        kept = similarity.representatives(clusters.join(order, "set_id"), iqrs).select("set_id")
        self.results["nonredundant"] = kept
        self.results["filtered"] = enrich.variance_filter(iqrs.join(kept, "set_id", "left_semi"), self.config.iqr_percentile)
        chosen = es.join(self.results["filtered"], "set_id", "left_semi").select("sample_id", F.col("set_id").alias("feature"), F.col("es").alias("value"))
        x, y, _, names = ml.training_matrix(matrix.fill(chosen, self.samples), self.samples)
        frequency = resample.selection_frequency(resample.bootstrap_coefficients(self.spark, x, y, self.config))
        self.results["stable"] = resample.stable(frequency, self.config.stability).join(self.spark.createDataFrame(list(enumerate(names)), "position int, set_id string"), "position").cache()

    def test(self) -> None:
        tests = stats.mann_whitney_u(self.results["scores"].join(self.samples, "sample_id"), ["set_id"]).filter("n1 >= 3 and n0 >= 3")
        self.results["differential"] = stats.benjamini_hochberg(tests.withColumn("p", stats.mann_whitney_p()))

    def validate(self) -> None:
        """Leave-one-out of the stable sets by both models, the former's accuracy under shuffled labels, and nested leave-one-out, which selects
        among all filtered sets anew.  Nothing to do with fewer than two stable sets."""
        stable = self.results["stable"].select("set_id")
        if stable.count() < 2:
            return
        x, y = self._matrix_of(stable)
        self.results["loocv"] = stats.metrics(resample.leave_one_out(self.spark, x, y, config=self.config), score="probability").cache()
        self.results["loocv_forest"] = stats.metrics(resample.leave_one_out(self.spark, x, y, "forest", self.config), score="probability")
        reached = self.results["loocv"].first()["accuracy"]
        self.results["permutation"] = stats.empirical_p(resample.permutation_null(self.spark, x, y, self.config), "accuracy", reached)
        x, y = self._matrix_of(self.results["filtered"])
        self.results["nested_loocv"] = stats.metrics(resample.nested_leave_one_out(self.spark, x, y, self.config), score="probability")

    def _matrix_of(self, sets: DataFrame) -> tuple:
        chosen = self.results["scores"].join(sets.select("set_id"), "set_id", "left_semi").select("sample_id", F.col("set_id").alias("feature"), F.col("es").alias("value"))
        x, y, _, _ = ml.training_matrix(matrix.fill(chosen, self.samples), self.samples)
        return x, y

    def profile(self) -> DataFrame:
        """phase, seconds, heap_mb: wall time of each phase so far, and the driver's heap in use after it."""
        rows = [(p, s, self.heap.get(p)) for p, s in self.times.items()]
        return self.spark.createDataFrame(rows, "phase string, seconds double, heap_mb double")


PHASES = {"impute": Analysis.impute, "score": Analysis.score, "reduce": Analysis.reduce, "test": Analysis.test, "validate": Analysis.validate}


def imputed_variant(analysis: Analysis, phases: tuple[str, ...] = ("score", "reduce", "test", "validate")) -> Analysis:
    """The same phases on the imputed matrix, as an analysis of its own; the given one stays as it is."""
    return run(replace(analysis, results={}, times={}, heap={}), ["impute", *phases])


def run(analysis: Analysis, phases: list[str]) -> Analysis:
    for p in phases:
        if p not in PHASES:
            print(f"unknown phase: {p}", file=sys.stderr)
            continue
        with analysis.timed(p):
            PHASES[p](analysis)
    return analysis


def main(args: list[str] | None = None) -> None:
    from ..session import session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--tables", required=True, help="folder of the star schema's Parquet tables")
    parser.add_argument("--phases", nargs="+", default=["score", "test"])
    parser.add_argument("--imputed", action="store_true", help="the same phases on the imputed matrix")
    parser.add_argument("--quick", action="store_true", help="fewer bootstraps, permutations and trees, to try things out")
    parser.add_argument("--out", help="folder for the results")
    given = parser.parse_args(args)
    spark = session()
    t = Tables(spark, given.tables)
    config = replace(Config(), bootstraps=20, inner_bootstraps=5, permutations=50, n_cs=4, trees=10, impute_rounds=2) if given.quick else Config()
    analysis = Analysis(spark, t.matrix(), t.samples(), t.membership(), t.scores(), config)
    done = imputed_variant(analysis, tuple(given.phases)) if given.imputed else run(analysis, given.phases)
    for name, df in done.results.items():
        if given.out:
            df.write.mode("overwrite").parquet(f"{given.out}/{name}")
        else:
            df.show(20, truncate=False)
    for phase, seconds in done.times.items():
        print(f"{phase}: {seconds:.1f} s, {done.heap[phase]:.0f} MB of heap")


if __name__ == "__main__":
    main()
