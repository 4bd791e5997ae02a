"""The queries of this subpackage: name -> function of (spark, folder of the tables), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, mixing, url_rules


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .dartminhash import classes

    return classes(_table(spark, folder, "documents")).select("doc_id", "class_id", "kept")


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .url_rules import judged, rule_table

    return judged(_table(spark, folder, "pages").select("page_id", "url"), rule_table(spark)).select(
        "page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict")
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import packed

    return packed(_table(spark, folder, "documents"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .substring_index import dedup_documents

    return dedup_documents(_table(spark, folder, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(_table(spark, folder, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, folder, "embeddings"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from .language_id import held_out, identified, trained

    docs = _table(spark, folder, "documents")
    predicted = identified(docs.select("doc_id", "text"), trained(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from . import cluster
    from .mixing import mix, n_words, text_digest

    # words are counted once: sizes and digests are written, and the mix reads them instead of the texts
    text = F.col("text")
    sizes = cluster.written(_table(spark, folder, "documents").select("doc_id", "source", n_words(text).alias("size"), text_digest(text).alias("digest")), "mix-sizes")
    taken = (F.col("__size") * F.col("__copies")).alias("taken")
    return mix(sizes, size=F.col("size"), digest=F.col("digest")).select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken)


def op9_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    from .brown_lm import held_out, scored

    return scored(_table(spark, folder, "documents")).withColumn("held_out", held_out(F.col("doc_id")))


def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from .fingerprints import edited_pairs

    return edited_pairs(_table(spark, folder, "documents"))


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from .personal_data import BASE, KINDS, judged, listed

    found = judged(_table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(KINDS.index(kind)).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    from .fill_middle import output, restored, transformed

    cut = transformed(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("__units").alias("n"),
        F.col("__form").alias("form"),
        F.length("__prefix").cast("long").alias("prefix_chars"),
        F.length("__middle").cast("long").alias("middle_chars"),
        output(F.col("__form"), F.col("__prefix"), F.col("__middle"), F.col("__suffix")).alias("output"),
    )
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from .periodic_runs import judged, listed, repeated_tail, strongest

    found = judged(_table(spark, folder, "documents").select("doc_id", "text"), rewrite=repeated_tail).withColumn("best", strongest(F.col("__runs")))
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("__runs").cast("long").alias("n_runs"), *best, milli, F.sha2(listed(F.col("__runs")), 256).alias("runs_sha256"), F.sha2("__rest", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": url_rules.ORACLE_SQL, "op7_source_mixing": mixing.ORACLE_SQL, "op12_fill_middle": fill_middle.ORACLE_SQL}
