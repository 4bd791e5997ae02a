"""Tables written on the way: what is read more than once is written to the folder that all machines share, and read from there.

That cuts lineage, runs the work before it once, outlives lost executors, and leaves the caller's cache alone.  Inside
`scratch` what was written goes at its end, otherwise when the process ends."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()  # each thread's open scopes: jobs of two threads never remove each other's tables


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a session in one process, else the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        path = f"file://{tempfile.mkdtemp(prefix='omixel-')}" if local else spark.conf.get("spark.sql.warehouse.dir") + "/omixel-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at the end what is stored inside, in this thread."""
    scopes = _here.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            _remove(spark, path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _here.__dict__.get("scopes")
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
