"""What the operators need from the cluster: shared folders, documents in id order, materialised steps."""

from __future__ import annotations

import atexit
import contextlib
import math
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_LAST = (1 << 63) - 1
#: bytes of text in a range of ids, which one task sorts
RANGE_BYTES = 256 << 20
_SEQUENCE_BITS = 24
#: of each thread the folders to remove, for each `temporary` that is open: jobs of two threads never remove each other's
_here = threading.local()


def _open() -> list[list[str]]:
    return _here.__dict__.setdefault("open", [])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir.

    Where it is unset, a session in one process (tests) gets a temporary folder; any other one uses the warehouse, which is shared."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="omixel-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            path = f"file://{folder}"
        else:
            path = spark.conf.get("spark.sql.warehouse.dir") + "/omixel-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new folder name below the shared folder; lasting: it outlives the innermost `temporary`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    levels = _open()[:-1] if lasting else _open()
    if levels:
        levels[-1].append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Removes, at the end, what is written inside, but for what is lasting."""
    _open().append([])
    try:
        yield
    finally:
        for path in _open().pop():
            remove(spark, path)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives executors."""
    path = scratch(df.sparkSession, name, lasting)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def shuffles_end_with_query(spark: SparkSession):
    """Queries run inside drop their shuffle files as they end; for jobs whose results are written out and read back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def free_name(columns: list[str], name: str) -> str:
    """`name`, or with underscores after it where a column is called so already (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(docs: DataFrame) -> Column:
    """All columns in one, out of reach of names that an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def of_row(docs: DataFrame) -> list[Column]:
    """The columns of docs again, from `row`."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def id_order(col: Column) -> Column:
    """doc_id as a sort key: null comes last."""
    return F.coalesce(col.cast("long"), F.lit(_LAST))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def id_bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n (and 65,536) ids that cut documents into ranges of about equal rows; the first is the smallest id.

    For ranges whose size bounds no task's memory: batches, and ranges that Spark sorts and walks through."""
    n = max(1, min(n, 1 << 16))
    shares = [i / n for i in range(n)]
    got = docs.agg(F.percentile_approx(id_order(F.col("doc_id")), F.lit(shares), F.lit(max(10_000, 4 * n)))).first()[0]
    return sorted(set(got or [0]))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Position of the last bound <= key (0 if none is), by binary search."""
    n = len(bounds)
    if n == 1:
        return F.lit(0)
    values = F.lit(bounds)
    steps = [1 << i for i in reversed(range(max(1, math.ceil(math.log2(n)))))]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda low, step: F.when((low + step < n) & (F.element_at(values, F.least(low + step + 1, F.lit(n))) <= key), low + step).otherwise(low),
    )


def _number(bytes_per_chunk: int):
    """Adds the chunk: the number of the task's range, and how many chunks of text came before in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, before = TaskContext.get().partitionId() << _SEQUENCE_BITS, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            ends = before + np.cumsum(sizes)
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + (ends - sizes) // bytes_per_chunk, pa.int64())], names=[*batch.schema.names, "chunk"])

    return run


def with_chunk(docs: DataFrame, bytes_per_chunk: int, total_bytes: int, row: Column | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, chunk (and row): texts of about bytes_per_chunk bytes in all share a chunk, which rises with (doc_id, text).

    Ids are dealt to ranges by Spark's range partitioning, null ids last, and numbered within each range; so neither many
    rows of one id, nor null ids, nor long texts make a chunk larger than bytes_per_chunk and one text, and nothing is
    gathered on the driver.  Rows of one id and the same first letters share a range; equal rows may stand in any order.
    Written, so that a chunk stays the same however often it is read."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([] if row is None else [row.alias("row")])]
    n = max(1, math.ceil(total_bytes / range_bytes), math.ceil(math.sqrt(total_bytes / bytes_per_chunk)))
    key = F.col("doc_id").asc_nulls_last()
    dealt = docs.select(*columns).repartitionByRange(n, key, F.left(F.col("text"), F.lit(64))).sortWithinPartitions(key, "text")
    with shuffles_end_with_query(docs.sparkSession):
        return written(dealt.mapInArrow(_number(bytes_per_chunk), StructType([*dealt.schema.fields, StructField("chunk", LongType())])), "chunks")
