"""From raw documents to packed training sequences: five stages, each a Parquet table for the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

1. language ID: documents whose language cannot be told go: those without a letter, and those of which less than LEAST_KNOWN of what is
   usual is known in the predicted language (n-grams that its training texts have); that does not depend on how many
   languages there are, where the classifier's score does.  A document without `lang` takes the predicted one.  Where no language can be learned (no label
   outside the held-out documents), all documents with a letter stay as they are.
2. near-dedup: of each class of near copies (weighted Jaccard 0.8 of five-word shingles) the one of the least doc_id stays.
3. long repeats: passages of 50 words and more that also begin earlier are cut from the text.
4. mixing: sources are repeated or thinned to 3 : 1 : 2 weights and 150 % of all words.
5. packing: token ids in full sequences of up to 4096.

Null texts go in stage 1; an empty table gives an empty result; further columns, whatever their names,
are carried along to stage 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omixel.llm import cluster, dartminhash, language_id, mixing, packing, suffix_dedup

#: least share of known n-grams, relative to what training texts of the language know of each other
LEAST_KNOWN = 0.65


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.trained(docs)
    if not model.languages:
        return docs.filter(language_id.has_letter(docs["text"]))
    told = language_id.identified(docs, model)
    language, known = F.col(told.columns[-3]), F.col(told.columns[-1])
    return told.filter((language != language_id.UNKNOWN) & (known >= LEAST_KNOWN)).withColumn("lang", F.coalesce(F.col("lang").cast("string"), language)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language_id", tell_language),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: no SQL for kernels, near copies and tokenizers: tests/llm/ hold the result against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with cluster.temporary(spark):  # what stages leave goes when the last table is written
        for name, stage in STAGES[:-1]:
            with cluster.temporary(spark):  # what a stage leaves goes when its table is written
                docs = cluster.written(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        return cluster.written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}", lasting=True)
