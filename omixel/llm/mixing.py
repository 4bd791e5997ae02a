"""Mixing sources to target weights.

The tokens (words) of each source are summed, targets follow from weights, and a source is repeated at
rate = target / size: each document floor(rate) times, plus one more copy where a hash of seed,
doc_id and text falls below the fraction of the rate.

Targets share `share` times all tokens by weight; none exceeds `most` times its source's size, and what
is over goes to the others by weight until none is above.  That fixed point is target = min(cap, level * weight),
and the level follows from running sums over the sources in order of cap / weight; no iteration is needed.

Only one row per source is ever shuffled (sums are taken before the shuffle, so a hot source is one row a task).
The sources' table is broadcast while it has at most BROADCAST_SOURCES rows; beyond that the join is left to
Spark, which splits hot sources.

Defined results: a null text has no words; a null source is a source of its own and comes last; rows that share
doc_id and text share the draw, others do not, so a source without ids comes near its target too; sources without words get no target; columns of docs stay as they
are: a new column of a name that docs has gets an underscore more; an empty table gives an empty result; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 50_000
_NAMES = ("__size", "__source_size", "__target", "__rate", "__copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit("null"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) -> (source, source_size, target); weights repeat over the sources in code point order, null last."""
    everything = Window.partitionBy()
    weighted = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn(
        "weight", F.element_at(F.lit([float(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    weighted = weighted.withColumn("cap", F.lit(float(most)) * F.col("size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        weighted.withColumn("capped", F.sum("cap").over(rising) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(rising) + F.col("weight"))
        .withColumn("level", (F.lit(float(share)) * F.sum("size").over(everything) - F.col("capped")) / F.col("open"))
    )
    # the first source that its own level leaves below its cap sets the level of all
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return running.withColumn("the_level", level).select(
        "source", F.col("size").alias("source_size"), F.least("cap", F.coalesce(F.col("the_level"), F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def _draw(doc_id: Column, text_md5: Column, seed: int) -> Column:
    """Uniform on [0, 1): 52 bits of a hash of seed, id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text_md5))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, size: Column | None = None, digest: Column | None = None) -> DataFrame:
    """docs with __size, __source_size, __target, __rate and __copies: how often the mix takes each document.

    size, digest: a document's size and the digest of its text, where docs has these; by default they are taken from `text`."""
    spark = docs.sparkSession
    size = n_words(F.col("text")) if size is None else size
    digest = text_digest(F.col("text")) if digest is None else digest
    rows = docs.select(cluster.as_row(docs), F.col("source").cast("string").alias("source"), size.alias("__size"), F.col("doc_id").alias("doc_id"), digest.alias("text_md5"))
    sizes = rows.groupBy("source").agg(F.sum("__size").alias("size"))
    plan = cluster.written(targets(sizes, weights, share, most), "mix-targets").withColumnsRenamed({"source": "key", "source_size": "__source_size", "target": "__target"})
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    copies = F.floor("__rate") + (_draw(F.col("doc_id"), F.col("text_md5"), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    mixed = rows.join(plan, F.col("source").eqNullSafe(F.col("key")), "left").withColumn("__rate", rate).withColumn("__copies", copies)
    return mixed.select(*cluster.of_row(docs), *[F.col(c).alias(cluster.free_name(docs.columns, c)) for c in _NAMES])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    copies = F.col(cluster.free_name(docs.columns, "__copies"))
    times = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array())
    taken = mix(docs, **options)
    return taken.select(cluster.as_row(docs), F.explode(times)).select(*cluster.of_row(docs))


ORACLE_SQL = r"""
with s as (select doc_id, source, coalesce(md5(text), 'null') as text_md5, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
g as (select source, sum(size)::bigint as size from s group by source),
r as (select *, row_number() over (order by source collate "binary" asc nulls last) - 1 as rank from g),
w as (select *, case rank % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, 2.0::double * size as cap from r),
q as (select *, cap / weight as ratio from w),
c as (select *, sum(cap) over (order by ratio, rank rows unbounded preceding) - cap as capped,
  sum(weight) over () - sum(weight) over (order by ratio, rank rows unbounded preceding) + weight as open, 1.5::double * (sum(size) over ())::bigint as total from q),
l as (select *, (total - capped) / open as level from c),
t as (select source, size as source_size, least(cap, (select arg_min(level, ratio * 1e6 + rank) from l where level <= ratio) * weight) as target from l),
d as (select s.doc_id, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
  ('0x' || substr(md5('7:' || coalesce(s.doc_id::varchar, 'null') || ':' || s.text_md5), 1, 13))::bigint / 4503599627370496.0::double as draw
  from s join t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken from d
"""
