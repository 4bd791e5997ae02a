"""Registered queries of the library proper: every operator on whole tables of a star schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import numeric, text
from ..operators import enrich, impute, matrix, ml, order, points, resample, rowwise, similarity, stats
from ..sources.files import unpivot
from . import oracle
from .tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def _query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[f.__name__.rstrip("_")] = f
    return f


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# sources and routing


@_query
def scan_unpivot(t: Tables) -> DataFrame:
    rows = unpivot(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "measure")
    return rows.groupBy("measure").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@_query
def genesets_explode(t: Tables) -> DataFrame:
    k = F.explode(F.map_values(F.from_json("props", "map<string,int>")))
    return t.read("events").select(F.col("event_type").alias("set_id"), k.alias("feature")).groupBy("set_id", "feature").agg(F.count("*").alias("n"))


@_query
def disease_fallback(t: Tables) -> DataFrame:
    s = t.scores()
    groups = t.read("part").select(F.col("p_partkey").alias("feature"), "p_brand", "p_type")
    return enrich.with_fallback(s.select("feature", F.col("d").alias("score")), s.filter("s is not null").select("feature", F.col("s").alias("score")), groups, by=["p_brand", "p_type"])


@_query
def degree_centrality(t: Tables) -> DataFrame:
    edges = t.read("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    return _round(enrich.degree_centrality(edges), 9, "centrality")


@_query
def route_regex(t: Tables) -> DataFrame:
    return t.names().select("p_partkey", text.is_immunoglobulin(F.col("name")).alias("is_ig"))


@_query
def route_split(t: Tables) -> DataFrame:
    names = t.names().withColumn("ig", text.is_immunoglobulin(F.col("name")))
    parts = names.filter("ig").withColumn("route", F.lit("ig")).unionByName(names.filter("not ig").withColumn("route", F.lit("canonical")))
    return parts.groupBy("route").agg(F.count("*").alias("n"), F.count("name").alias("named"))


@_query
def classify_category(t: Tables) -> DataFrame:
    return t.names().select("p_partkey", text.category(F.col("name")).alias("category"))


@_query
def ig_subtype(t: Tables) -> DataFrame:
    return t.names().select("p_partkey", text.immunoglobulin_subtype(F.col("name")).alias("subtype"))


@_query
def v_genes_top(t: Tables) -> DataFrame:
    genes = t.names().select(text.v_gene(F.col("name")).alias("gene")).filter("gene is not null")
    return genes.groupBy("gene").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gene").limit(20)


@_query
def gene_symbol_extract(t: Tables) -> DataFrame:
    return t.names().select("p_partkey", text.gene_symbol(F.col("name")).alias("gene"))


@_query
def name_parts(t: Tables) -> DataFrame:
    n = F.col("name")
    return t.names().select("p_partkey", text.before_bracket(n).alias("head"), text.first_token(n).alias("token"), F.array_join(text.comma_list(n), "|").alias("parts"), text.shortened(n, 20).alias("short"))


@_query
def keyword_crossref(t: Tables) -> DataFrame:
    return t.names().select("p_partkey", text.matched_keywords(F.col("name")).alias("keywords")).filter("keywords <> ''")


@_query
def keyword_spotlight(t: Tables) -> DataFrame:
    words = F.explode(F.array(*[F.lit(w) for w in ("complement", "kinase", "ring", "bolt")])).alias("word")
    hits = t.names().select("p_partkey", "name", words).filter(F.contains(F.lower("name"), F.col("word")))
    return hits.groupBy("word").agg(F.min_by("p_partkey", "p_partkey").alias("first_part"), F.count("*").alias("n"))


@_query
def label_parse(t: Tables) -> DataFrame:
    k = F.col("r_regionkey")
    value = F.when(k == 0, "AD").when(k == 1, "1").when(k == 2, "Patient").when(k == 3, "control").otherwise("TRUE")
    return t.read("region").select("r_regionkey", text.label(value).alias("label"))


@_query
def to_numeric(t: Tables) -> DataFrame:
    return t.read("part").agg(F.sum(F.expr("try_cast(replace(p_brand, 'Brand#', '') as double)")).alias("total"), F.count(F.expr("try_cast(p_name as double)")).alias("bad"), F.count(F.expr("try_cast(p_size as double)")).alias("good"))


@_query
def union_tables(t: Tables) -> DataFrame:
    both = t.read("part").select(F.lit("part").alias("source"), F.col("p_name").alias("name")).unionByName(t.read("customer").select(F.lit("customer").alias("source"), F.col("c_name").alias("name")))
    return both.groupBy("source").agg(F.count("*").alias("n"))


# matrix


def _rates(t: Tables) -> DataFrame:
    return matrix.missing_rate(t.matrix(), t.features(), t.samples().count())


@_query
def missing_rate(t: Tables) -> DataFrame:
    return _round(_rates(t), 9, "rate")


@_query
def impute_tiers(t: Tables) -> DataFrame:
    return matrix.tiers(_rates(t)).select("feature", "tier")


@_query
def tier_counts(t: Tables) -> DataFrame:
    return matrix.tiers(_rates(t)).groupBy("tier").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))


@_query
def detection_rate(t: Tables) -> DataFrame:
    return _round(matrix.detection_by_sample(t.matrix(), t.samples(), t.features().count()), 9, "rate", "mean_rate")


@_query
def detection_ecdf(t: Tables) -> DataFrame:
    return _round(matrix.detection_ecdf(_rates(t)), 9, "rate", "share")


@_query
def category_missing(t: Tables) -> DataFrame:
    m, parts = t.matrix(), t.read("part").select(F.col("p_partkey").alias("feature"), "p_type")
    totals = parts.groupBy("p_type").agg(F.count("*").alias("total"))
    seen = m.join(parts, "feature").groupBy("p_type", "sample_id").agg(F.count("value").alias("seen"))
    cells = totals.join(t.samples(), how="cross").join(seen, ["p_type", "sample_id"], "left")
    return cells.groupBy("p_type", "y").agg(F.round(F.avg(F.lit(1.0) - F.coalesce("seen", F.lit(0)) / F.col("total")), 9).alias("mean_missing"))


@_query
def dedup_keep_best(t: Tables) -> DataFrame:
    rows = _rates(t).join(t.read("part").select(F.col("p_partkey").alias("feature"), F.col("p_name").alias("gene")), "feature")
    return matrix.keep_best(rows, F.coalesce("gene", F.col("feature").cast("string")), F.col("missing"), F.col("feature")).select("gene", "feature", "missing")


@_query
def fill_mean(t: Tables) -> DataFrame:
    return _round(matrix.fill(t.matrix(), t.samples()), 3, "filled").select("sample_id", "feature", "filled")


@_query
def row_zscore(t: Tables) -> DataFrame:
    m = t.matrix()
    enough = m.groupBy("feature").agg(F.count("*").alias("n")).filter("n >= 3")
    return _round(matrix.zscores(m.join(enough, "feature", "left_semi")), 6, "z").select("sample_id", "feature", "z")


def _medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    return order.quantiles(rows, [by], value, [0.5]).select(by, F.col("q")[0].alias("median"))


@_query
def row_stats(t: Tables) -> DataFrame:
    m = t.matrix()
    out = m.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.stddev_pop("value").alias("sd"))
    return _round(out.join(_medians(m, "feature", "value"), "feature", "left"), 6, "mean", "median", "variance", "sd")


@_query
def median_of_medians(t: Tables) -> DataFrame:
    medians = _medians(t.matrix(), "feature", "value").join(t.read("part").select(F.col("p_partkey").alias("feature"), "p_type"), "feature")
    return _round(_medians(medians, "p_type", "median"), 6, "median").orderBy(F.desc("median"))


@_query
def feature_matrix(t: Tables) -> DataFrame:
    rows = matrix.feature_arrays(matrix.fill(t.matrix(), t.samples()))
    total = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("sample_id", F.size("features").alias("n"), F.round(total, 3).alias("checksum"))


@_query
def sharing(t: Tables) -> DataFrame:
    groups = t.matrix().join(t.samples(), "sample_id").groupBy("feature").agg(F.count_distinct("y").alias("n_groups"))
    return groups.groupBy("n_groups").agg(F.count("*").alias("n"), F.count_if(F.col("n_groups") == 1).alias("unique_to_one"))


@_query
def ranges(t: Tables) -> DataFrame:
    return t.matrix().agg(F.count("*").alias("n"), F.count_distinct("feature").alias("n_features"), F.count_distinct("sample_id").alias("n_samples"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@_query
def log2_strict(t: Tables) -> DataFrame:
    return t.raw().agg(F.count(numeric.log2_positive(F.col("value"))).alias("positive"), F.count(numeric.log2_positive(F.col("value") / 20000.0, strict=True)).alias("strict"))


@_query
def hist_bins(t: Tables) -> DataFrame:
    return matrix.histogram(_rates(t), "rate", 0.3, 0.033)


@_query
def kernel_density(t: Tables) -> DataFrame:
    return _round(matrix.kernel_density(_rates(t), "rate", [0.1, 0.3, 0.5, 0.7, 0.9]), 6, "density")


@_query
def qrilc_params(t: Tables) -> DataFrame:
    return _round(impute.tail_parameters(t.matrix()), 6, "mu", "sigma", "lower", "upper")


@_query
def impute_accounting(t: Tables) -> DataFrame:
    m, tiers = t.matrix(), matrix.tiers(_rates(t))
    found = tiers.filter("tier <> 'Tier3'").join(impute.tail_parameters(m), "feature").join(t.samples().select("sample_id"), how="cross").select("sample_id", "feature", F.col("mu").alias("imputed"))
    return impute.accounting(impute.assembled(m, t.samples(), tiers, found))


# weights and sets


@_query
def combined_weight(t: Tables) -> DataFrame:
    return _round(enrich.weights(t.scores()), 9, "w")


@_query
def param_weight(t: Tables) -> DataFrame:
    steps = F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 1.5, 2.0)])
    grid = t.scores().withColumn("alpha", F.explode(steps)).withColumn("beta", F.explode(steps))
    w = numeric.parametric_weight(F.col("d"), F.col("s"), F.col("alpha"), F.col("beta"))
    return grid.groupBy("alpha", "beta").agg(F.round(F.avg(w), 6).alias("mean_w"), F.round(F.max(w), 6).alias("max_w"))


@_query
def set_size_band(t: Tables) -> DataFrame:
    m = t.membership()
    entries = m.withColumn("ord", F.lit(0)).unionByName(m.withColumn("feature", F.col("feature") + 1).withColumn("ord", F.lit(1)))
    return enrich.sized_sets(entries, 3, 100).select("set_id", "n_genes").distinct()


@_query
def set_coverage(t: Tables) -> DataFrame:
    return enrich.present_sets(t.membership(), t.matrix()).groupBy("set_id").agg(F.count("*").alias("present"))


@_query
def invert_index(t: Tables) -> DataFrame:
    return t.membership().groupBy("feature").agg(F.array_join(F.sort_array(F.collect_set("set_id")), ",").alias("sets"))


@_query
def set_algebra(t: Tables) -> DataFrame:
    first, second = ((F.col("set_id") == s).cast("int") for s in ("T:ECONOMY", "S:11"))
    held = t.membership().filter(F.col("set_id").isin("T:ECONOMY", "S:11")).groupBy("feature").agg(F.max(first).alias("a"), F.max(second).alias("b"))
    return held.agg(*[F.count(F.when(F.expr(rule), 1)).cast("int").alias(name) for name, rule in (("shared", "a = 1 and b = 1"), ("together", "true"), ("only_first", "a = 1 and b = 0"))])


@_query
def unmapped(t: Tables) -> DataFrame:
    return t.features().join(t.matrix().select("feature"), "feature", "left_anti")


@_query
def core_members(t: Tables) -> DataFrame:
    high = t.matrix().filter("value > 14").select("feature")
    return t.membership().distinct().join(high, "feature", "left_semi").groupBy("set_id").agg(F.count("*").alias("detected"))


@_query
def first_match(t: Tables) -> DataFrame:
    here = t.read("customer").join(t.read("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return here.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first_customer"), F.count("*").alias("n"))


@_query
def best_hits(t: Tables) -> DataFrame:
    """Names without what is in brackets, looked up in the catalogue of parts."""
    return enrich.best_hits(t.names().select("name").distinct(), t.read("part").select("p_partkey", "p_name"), "name", "p_name", F.col("p_partkey")).select("query_original", "query_clean", "p_partkey", "hit")


@_query
def usable_symbols(t: Tables) -> DataFrame:
    return text.usable_symbols(t.names().select(text.gene_symbol(F.col("name")).alias("gene")), "gene")


@_query
def mapped_features(t: Tables) -> DataFrame:
    """Every feature of the matrix with its symbol, where it has one."""
    symbols = t.names().select(F.col("p_partkey").alias("feature"), text.gene_symbol(F.col("name")).alias("gene")).filter("gene is not null")
    return enrich.with_symbols(t.matrix(), symbols, "feature").groupBy("feature", "gene").agg(F.count("*").alias("n"))


@_query
def join_metadata(t: Tables) -> DataFrame:
    sets = t.membership().select("set_id").distinct()
    meta = t.membership().filter("left(set_id, 1) <> 'S'").groupBy("set_id").agg(F.first(F.left(F.col("set_id"), F.lit(1))).alias("source"), F.count("*").alias("n_genes"))
    return sets.join(meta, "set_id", "left").select("set_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


@_query
def count_by_source(t: Tables) -> DataFrame:
    return t.membership().groupBy(F.left(F.col("set_id"), F.lit(1)).alias("source")).agg(F.count_distinct("set_id").alias("n"))


@_query
def theme_match(t: Tables) -> DataFrame:
    theme = F.col("p_type")
    first, second = theme.isin("ECONOMY", "SMALL"), theme.isin("SMALL", "PROMO")
    return t.read("part").groupBy("p_type", numeric.theme_match(first, second, "First", "Second").alias("source_match"), (~(first | second)).alias("novel")).agg(F.count("*").alias("n"))


# enrichment


def _scores(t: Tables) -> DataFrame:
    """The scores of all sets, made once a query."""
    values = t.once("matrix", t.matrix)
    return t.once("scores", lambda: _round(enrich.ssgsea(values, t.membership(), enrich.weights(t.scores()), t.samples()), 9, "es"))


def _means(t: Tables) -> DataFrame:
    return enrich.group_means(_scores(t), t.samples())


@_query
def ssgsea(t: Tables) -> DataFrame:
    return _round(_means(t), 6, "mean_1", "mean_0", "diff").drop("abs_diff")


@_query
def ssgsea_scores(t: Tables) -> DataFrame:
    return _round(_scores(t), 6, "es")


@_query
def group_diff(t: Tables) -> DataFrame:
    return _round(_means(t).withColumn("direction", numeric.direction(F.col("diff"))), 6, "diff", "abs_diff").select("set_id", "diff", "abs_diff", "direction")


@_query
def source_direction(t: Tables) -> DataFrame:
    return _means(t).groupBy(F.left(F.col("set_id"), F.lit(1)).alias("source")).agg(F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"))


@_query
def top_sets(t: Tables) -> DataFrame:
    return _round(_means(t).orderBy(F.desc("abs_diff"), "set_id").limit(20).select("set_id", "abs_diff"), 6, "abs_diff")


@_query
def jaccard_pairs(t: Tables) -> DataFrame:
    return _round(similarity.jaccard_pairs(t.membership()), 9, "jaccard")


@_query
def similar_sets(t: Tables) -> DataFrame:
    """Sets of parts up to a size, or of a brand and up to a size, that have seven tenths in common."""
    parts = t.read("part").select("p_partkey", "p_size", F.explode(F.array(F.lit("all"), F.col("p_brand"))).alias("of"))
    upto = parts.select("p_partkey", "of", F.explode(F.sequence("p_size", F.lit(50))).alias("size"))
    sets = upto.select(F.concat("of", F.lit(":"), F.lpad(F.col("size").cast("string"), 2, "0")).alias("set_id"), F.col("p_partkey").alias("feature"))
    return _round(similarity.similar_pairs(sets, 0.7), 9, "jaccard")


def _correlations(t: Tables) -> DataFrame:
    mean = F.avg("es").over(Window.partitionBy("set_id"))
    return stats.pairwise_correlation(_scores(t).withColumn("es", F.coalesce("es", mean)), "set_id", "sample_id", "es")


@_query
def combined_similarity(t: Tables) -> DataFrame:
    return _round(similarity.combined_similarity(similarity.jaccard_pairs(t.membership()), _correlations(t)), 6, "s")


@_query
def iqr(t: Tables) -> DataFrame:
    return _round(enrich.iqr(_scores(t)), 6, "iqr")


@_query
def iqr_filter(t: Tables) -> DataFrame:
    return _round(enrich.variance_filter(_round(enrich.iqr(_scores(t)), 9, "iqr")), 6, "iqr").select("set_id", "iqr")


@_query
def box_summary(t: Tables) -> DataFrame:
    by_source = _scores(t).select(F.left(F.col("set_id"), F.lit(1)).alias("source"), "es")
    five = order.quantiles(by_source, ["source"], "es", [0.0, 0.25, 0.5, 0.75, 1.0])
    out = five.select("source", *[F.col("q")[i].alias(c) for i, c in enumerate(("low", "q1", "mid", "q3", "high"))])
    return _round(out, 6, "low", "q1", "mid", "q3", "high")


# tests


def _tests(t: Tables) -> DataFrame:
    return stats.mann_whitney_u(_scores(t).join(t.samples(), "sample_id"), ["set_id"])


def _p_values(t: Tables) -> DataFrame:
    return _tests(t).withColumn("p", stats.mann_whitney_p())


@_query
def mann_whitney(t: Tables) -> DataFrame:
    return _tests(t).select("set_id", "n1", "n0", "u", "ties")


@_query
def rank_biserial(t: Tables) -> DataFrame:
    return _round(_tests(t), 9, "r").select("set_id", "r")


@_query
def bh_fdr(t: Tables) -> DataFrame:
    return _round(stats.benjamini_hochberg(_p_values(t)), 6, "p", "q").select("set_id", "p", "q", "significant")


@_query
def differential(t: Tables) -> DataFrame:
    tests = stats.benjamini_hochberg(_p_values(t).filter("n1 >= 3 and n0 >= 3")).withColumnRenamed("significant", "significant_fdr")
    out = tests.join(_means(t), "set_id").withColumns({"significant": F.col("p") < 0.05, "neg_log10_p": F.round(numeric.minus_log10(F.col("p")), 5), "stars": numeric.stars(F.col("p"))})
    return _round(out, 6, "mean_1", "mean_0", "diff", "r", "p", "q").select("set_id", "mean_1", "mean_0", "diff", "u", "r", "p", "q", "significant_fdr", "significant", "neg_log10_p", "stars")


@_query
def driver_features(t: Tables) -> DataFrame:
    by_feature = stats.mann_whitney_u(t.matrix().join(t.samples(), "sample_id"), ["feature"], "value").filter("n1 >= 3 and n0 >= 2")
    tests = by_feature.withColumn("p", stats.mann_whitney_p()).join(t.membership().distinct(), "feature")
    best = matrix.first_n(stats.benjamini_hochberg(tests), 5, ["set_id"], F.abs("r").desc(), F.col("feature"))
    return _long(_round(best, 6, "r", "p", "q"), "rank").select("set_id", "feature", "n1", "n0", "r", "p", "q", "rank")


@_query
def significance_counts(t: Tables) -> DataFrame:
    return _p_values(t).agg(F.count_if(F.col("p") < 0.05).alias("nominal"), F.count_if(F.col("p") < 0.01).alias("strong"), F.count("*").alias("tests"))


@_query
def pairwise_corr(t: Tables) -> DataFrame:
    return _round(stats.pairwise_correlation(t.matrix(), "sample_id", "feature", "value"), 6, "r")


@_query
def filled_corr(t: Tables) -> DataFrame:
    r = F.coalesce(F.when(F.isnan("r"), 0.0).otherwise(F.col("r")), F.lit(0.0))
    return _correlations(t).select("a", "b", F.round(r, 6).alias("r"))


@_query
def reproducibility(t: Tables) -> DataFrame:
    """Means of events by day against those by hour, put together again to two digits."""
    day = F.to_date("ts").alias("day")
    stored = t.read("events").groupBy(day).agg(F.round(F.avg("value"), 2).alias("mean"))
    hours = t.read("events").groupBy(day, F.hour("ts").alias("hour")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    again = hours.groupBy("day").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return _round(stats.reproduced(again, stored, ["day"], "mean"), 6, "again", "stored")


@_query
def empirical_p(t: Tables) -> DataFrame:
    out = stats.empirical_p(t.read("events"), "value", 40.0)
    return _round(_round(out, 9, "p"), 6, "mean", "sd")


@_query
def value_counts(t: Tables) -> DataFrame:
    return t.read("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


# models


def _vectors(t: Tables) -> DataFrame:
    rows = t.read("embeddings").select(F.col("vec_id").alias("sample_id"), "label", F.posexplode("embedding").alias("feature", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


def _parameters(t: Tables) -> DataFrame:
    k = F.col("id")
    return t.spark.range(64).select(k.cast("int").alias("feature"), (((k % 7) - 3).cast("double") / F.lit(10.0)).alias("coefficient"), (k / 1000.0).alias("mean"), (k % 3 + 1).cast("double").alias("deviation"), F.lit(0.05).alias("intercept"))


def _predictions(t: Tables) -> DataFrame:
    v = _vectors(t)
    scored = _round(ml.score_long(v, _parameters(t), t.read("embeddings").select(F.col("vec_id").alias("sample_id"))), 6, "probability").withColumn("predicted", (F.col("probability") > 0.5).cast("int"))
    return scored.join(t.read("embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") < 5).cast("int").alias("y")), "sample_id")


def _phi(t: Tables) -> DataFrame:
    return _round(ml.linear_shap(_vectors(t), _parameters(t), "value"), 9, "phi")


@_query
def standardize(t: Tables) -> DataFrame:
    return _round(matrix.zscores(_vectors(t)), 5, "z").select("sample_id", "feature", "z")


@_query
def score_logistic(t: Tables) -> DataFrame:
    p = F.col("probability")
    return _predictions(t).select("sample_id", "probability", "predicted", ((p > 0.3) & (p < 0.7)).alias("low_confidence"))


@_query
def classification_metrics(t: Tables) -> DataFrame:
    rows = t.read("labels").select(F.col("quality").alias("y"), (1 - F.col("toxic")).alias("predicted"), ((F.col("doc_id") * 7 % 101).cast("double") / F.lit(101.0)).alias("score"))
    return _round(stats.metrics(rows), 9, "accuracy", "kappa", "auc").select("tp", "fn", "fp", "tn", "accuracy", "kappa", "auc")


@_query
def linear_shap(t: Tables) -> DataFrame:
    return _round(ml.shap_ranking(_phi(t)), 6, "importance")


@_query
def misclassified(t: Tables) -> DataFrame:
    return _long(_round(ml.misclassified(_phi(t), _predictions(t)), 5, "phi"), "rank").select("sample_id", "side", "feature", "phi", "rank")


@_query
def representative_samples(t: Tables) -> DataFrame:
    return ml.representative_samples(_predictions(t))


def _runs(t: Tables) -> DataFrame:
    k = F.col("event_id") % 9
    accuracy = F.lit(0.75) + F.lit(0.25) * F.least("value", F.lit(50.0)) / F.lit(50.0) * ((k + 3).cast("double") / F.lit(11.0))
    return t.read("events").select((20 * (1 + k)).cast("int").alias("n_total"), accuracy.alias("accuracy"))


@_query
def resample_summary(t: Tables) -> DataFrame:
    return _round(resample.summary(_runs(t), "n_total"), 6, "mean", "sd", "ci_low", "ci_high")


@_query
def recommended_n(t: Tables) -> DataFrame:
    return resample.recommended_n(resample.summary(_runs(t), "n_total"), 0.85, 0.75)


@_query
def threshold_sweep(t: Tables) -> DataFrame:
    frequency = t.read("events").groupBy(F.col("user_id").alias("position")).agg(F.avg((F.col("value") > 10).cast("double")).alias("selection_prob"))
    return resample.threshold_sweep(frequency, (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9))


def _coefficients(t: Tables) -> DataFrame:
    status = F.when(F.col("user_id") % 10 == 9, "one class").otherwise("ok")
    return t.read("events").select((F.col("event_id") % 200).cast("int").alias("b"), status.alias("status"), F.col("user_id").alias("position"), F.when(F.col("value") > 10, F.col("value") - 30.0).otherwise(0.0).alias("coefficient"))


@_query
def selection_frequency(t: Tables) -> DataFrame:
    return _round(resample.stable(resample.selection_frequency(_coefficients(t)), 0.5), 6, "selection_prob", "mean_coef")


@_query
def features_per_fold(t: Tables) -> DataFrame:
    folds = _coefficients(t).filter("status = 'ok' and coefficient <> 0").groupBy("b").agg(F.count_distinct("position").alias("n"))
    return folds.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"))


def _grid(t: Tables) -> DataFrame:
    return t.read("events").groupBy(F.col("event_type").alias("alpha"), (F.col("user_id") % 5).cast("int").alias("beta")).agg(F.round(F.avg("value"), 6).alias("acc"))


@_query
def grid_pivot(t: Tables) -> DataFrame:
    return _grid(t).groupBy("beta").pivot("alpha", ["click", "error", "purchase", "signup", "view"]).agg(F.first("acc"))


@_query
def grid_best(t: Tables) -> DataFrame:
    return _grid(t).orderBy(F.desc("acc"), "alpha", "beta").limit(1)


@_query
def theme_counts(t: Tables) -> DataFrame:
    return t.read("part").groupBy(F.col("p_type").alias("theme")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands")).orderBy(F.desc("n"), "theme")


@_query
def jaccard_themes(t: Tables) -> DataFrame:
    theme = F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string"))
    sets = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.collect_set(theme).alias("themes"))
    pairs = sets.alias("x").join(sets.alias("y"), F.col("x.n_regionkey") < F.col("y.n_regionkey"))
    together = F.size(F.array_union("x.themes", "y.themes"))
    jaccard = F.when(together == 0, 1.0).otherwise(F.size(F.array_intersect("x.themes", "y.themes")) / together)
    return pairs.select(F.col("x.n_regionkey").alias("a"), F.col("y.n_regionkey").alias("b"), F.round(jaccard, 9).alias("jaccard"))


# iterative operators: no SQL, tested against plain versions


def _set_scores(t: Tables) -> tuple[np.ndarray, np.ndarray, list, list]:
    filled = matrix.fill(_scores(t).select("sample_id", F.col("set_id").alias("feature"), F.col("es").alias("value")), t.samples())
    return ml.training_matrix(filled, t.samples())


@_query
def upgma_clusters(t: Tables) -> DataFrame:
    sim = similarity.combined_similarity(similarity.jaccard_pairs(t.membership()), _correlations(t))
    return similarity.clusters(_scores(t).select("set_id").distinct(), sim, (0.7, 0.8, 0.9))


@_query
def cluster_representatives(t: Tables) -> DataFrame:
    order = t.membership().select("set_id").distinct().withColumn("ord", F.row_number().over(Window.orderBy("set_id")))
    return similarity.representatives(upgma_clusters(t).join(order, "set_id"), enrich.iqr(_scores(t)))


@_query
def mann_whitney_p(t: Tables) -> DataFrame:
    """Of every feature: many have small groups, whose p is exact."""
    tests = stats.mann_whitney_u(t.matrix().join(t.samples(), "sample_id"), ["feature"], "value")
    return _round(tests.withColumn("p", stats.mann_whitney_p()), 6, "p").select("feature", "n1", "n0", "u", "p")


@_query
def clopper_pearson(t: Tables) -> DataFrame:
    counts = t.read("events").groupBy("event_type").agg(F.count_if(F.col("value") > 40).alias("k"), F.count("*").alias("n"))
    return stats.clopper_pearson(counts)


def _complete_scores(t: Tables) -> DataFrame:
    return matrix.complete_features(_scores(t).select("sample_id", F.col("set_id").alias("feature"), F.round("es", 9).alias("value")), t.samples())


@_query
def complete_features(t: Tables) -> DataFrame:
    return _complete_scores(t).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@_query
def pca_samples(t: Tables) -> DataFrame:
    """Samples in two dimensions, from the sets that are scored in all of them."""
    return ml.wide_components(_complete_scores(t))


@_query
def pca_features(t: Tables) -> DataFrame:
    """Samples in two dimensions, from every feature of the matrix; a missing value counts as the feature's mean."""
    return ml.wide_components(t.once("matrix", t.matrix))


@_query
def pca2(t: Tables) -> DataFrame:
    return ml.principal_components(t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding").select("vec_id", "scores", "explained")


@_query
def qrilc_draws(t: Tables) -> DataFrame:
    m = t.matrix()
    gaps = matrix.tiers(_rates(t)).filter("tier = 'Tier2'").select("feature").join(t.samples().select("sample_id"), how="cross").join(m, ["sample_id", "feature"], "left_anti")
    return impute.tail_draws(gaps, impute.tail_parameters(m))


@_query
def missforest(t: Tables) -> DataFrame:
    m = t.once("matrix", t.matrix)
    near = matrix.tiers(matrix.missing_rate(m, t.features(), t.samples().count())).filter("tier in ('Complete', 'Tier1')").select("feature")
    return impute.chained_forests(m.join(near, "feature", "left_semi"), t.samples(), trees=10, rounds=2)


@_query
def train_predict(t: Tables) -> DataFrame:
    rows = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") < 5).cast("int").alias("y"))
    model = ml.train_distributed(rows.filter("y is not null and embedding is not null"), "embedding")
    return ml.score_arrays(rows.select("vec_id", "embedding"), F.col("embedding"), model).drop("embedding")


@_query
def elastic_net_rows(t: Tables) -> DataFrame:
    """How often each component of the embeddings is selected to tell the labels apart, by 200 bootstraps of all rows."""
    rows = t.read("embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"))
    fits = rowwise.bootstrapped_elastic_nets(rows, F.xxhash64("vec_id"), "embedding", "y", c=0.02, l1_ratio=0.7, passes=400, tolerance=1e-5)
    told = t.spark.createDataFrame(fits, "b int, status string, position int, coefficient double").filter(F.col("position") < int(fits["position"].max()) if len(fits) else F.lit(True))
    return resample.selection_frequency(told)


@_query
def stability_selection(t: Tables) -> DataFrame:
    x, y, _, names = _set_scores(t)
    frequency = resample.selection_frequency(resample.bootstrap_coefficients(t.spark, x, y, Config()))
    return frequency.join(t.spark.createDataFrame(list(enumerate(names)), "position int, set_id string"), "position")


@_query
def loocv_logistic(t: Tables) -> DataFrame:
    x, y, _, _ = _set_scores(t)
    return stats.metrics(resample.leave_one_out(t.spark, x, y), score="probability")


@_query
def loocv_forest(t: Tables) -> DataFrame:
    x, y, _, _ = _set_scores(t)
    return stats.metrics(resample.leave_one_out(t.spark, x, y, "forest"), score="probability")


@_query
def nested_loocv(t: Tables) -> DataFrame:
    x, y, _, _ = _set_scores(t)
    return resample.nested_leave_one_out(t.spark, x, y, replace(Config(), inner_bootstraps=10, n_cs=5))


@_query
def permutation_test(t: Tables) -> DataFrame:
    x, y, _, _ = _set_scores(t)
    null = resample.permutation_null(t.spark, x, y, Config())
    return stats.empirical_p(null, "accuracy", 0.7)


@_query
def power_curve(t: Tables) -> DataFrame:
    x, y, _, _ = _set_scores(t)
    return resample.summary(resample.power_curve(t.spark, x, y, (20, 30, 50, 75, 100, 150, 200, 300, 500), 20), "n_total")


@_query
def class_covariance(t: Tables) -> DataFrame:
    x, y, _, _ = _set_scores(t)
    rows = [(k, int((y == k).sum()), float(s), float(np.linalg.cond(c))) for k, (_, c, s) in resample.class_model(x, y).items()]
    return t.spark.createDataFrame(rows, "y int, n int, shrinkage double, condition double")


#: the weightings that are compared
_GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
_CONDITIONS = {"A": (0.0, 0.0), "B": (1.0, 0.0), "C": (0.0, 1.0), "D": (1.0, 1.0)}


def _effects(t: Tables, points: list[tuple[float, float]]) -> DataFrame:
    """alpha, beta, set_id, r: how far the groups differ in each set under each weighting."""
    scores = _round(enrich.ssgsea_grid(t.once("matrix", t.matrix), t.membership(), t.scores(), t.samples(), points), 9, "es")
    return stats.mann_whitney_u(scores.join(t.samples(), "sample_id"), ["alpha", "beta", "set_id"])


@_query
def weight_grid(t: Tables) -> DataFrame:
    """alpha x beta grid: score all sets under each weighting, count those that differ between the groups."""
    tests = _effects(t, [(a, b) for a in _GRID for b in _GRID])
    return tests.groupBy("alpha", "beta").agg(F.count("*").alias("sets"), F.count_if(F.abs("r") >= 0.3).alias("n_large"), F.round(F.max(F.abs("r")), 6).alias("max_r"))


@_query
def ablation(t: Tables) -> DataFrame:
    """Conditions without weights, with either, with both: sets with large effects and their overlap with the full condition."""
    name = F.coalesce(*[F.when((F.col("alpha") == a) & (F.col("beta") == b), F.lit(k)) for k, (a, b) in _CONDITIONS.items()])
    large = _effects(t, list(_CONDITIONS.values())).filter(F.abs("r") >= 0.3).select(name.alias("condition"), "set_id")
    full = large.filter("condition = 'D'").select("set_id", F.lit(1).alias("in_d"))
    counts = large.join(full, "set_id", "left").groupBy("condition").agg(F.count("*").alias("n_sets"), F.count("in_d").alias("both"))
    size = full.agg(F.count("*").alias("n_d"))
    return counts.join(F.broadcast(size), how="cross").select("condition", "n_sets", F.round(F.col("both") / (F.col("n_sets") + F.col("n_d") - F.col("both")), 6).alias("overlap"))


def _scored_points(t: Tables, points_: list[tuple[float, float]]) -> DataFrame:
    values = t.once("matrix", t.matrix)
    return t.once("points", lambda: _round(enrich.ssgsea_grid(values, t.membership(), t.scores(), t.samples(), points_), 9, "es"))


@_query
def grid_validation(t: Tables) -> DataFrame:
    """Every weighting of the grid: sets that are left, selected, and leave-one-out of those that are selected; 100 bootstraps a point."""
    scores = _scored_points(t, [(a, b) for a in _GRID for b in _GRID])
    return points.evaluated(scores, t.samples(), t.membership(), ["alpha", "beta"], nested=False, config=replace(Config(), bootstraps=100))


@_query
def ablation_validation(t: Tables) -> DataFrame:
    """The four conditions: selection by 200 bootstraps, leave-one-out, and nested leave-one-out with 10 bootstraps a fold."""
    name = F.coalesce(*[F.when((F.col("alpha") == a) & (F.col("beta") == b), F.lit(k)) for k, (a, b) in _CONDITIONS.items()]).alias("condition")
    scores = _scored_points(t, list(_CONDITIONS.values())).select(name, "set_id", "sample_id", "es")
    return points.evaluated(scores, t.samples(), t.membership(), ["condition"], nested=True, config=replace(Config(), inner_bootstraps=10))


@_query
def stable_by_point(t: Tables) -> DataFrame:
    """Sets that reach the stability threshold at each point of a grid, from a table of coefficients; points without one count 0."""
    fits = _coefficients(t).select((F.col("position") % 5).alias("alpha"), (F.col("b") % 5).cast("long").alias("beta"), "b", "status", F.col("position").alias("set_id"), "coefficient")
    by = ["alpha", "beta"]
    return points.stable_counts(points.frequency(fits, by), fits, by, 0.8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, folder, f=f: f(Tables(spark, folder)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _QUERIES}


