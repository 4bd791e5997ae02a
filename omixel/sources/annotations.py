"""A paged annotation service as a Spark source: partitions are batches of names.

`spark.dataSource.register(Annotations)`, then
`spark.read.format("annotations").schema(DDL).option("url", ...).option("names", json_list).load()`; names that are a table
already, of any number, go through `annotated`.  A request is `url?names=a|b|c&page=token`; an answer is a JSON object
`{"results": [{"query": ..., ...}], "next": token or null}`.  Rows have the schema's columns: `query`, `hit` (from 1 within a query, over its pages)
and whatever fields of an entry it names; a field that an entry lacks, or that has another type, is null.

A request that fails is tried again `retries` times, after a pause that doubles; a batch that fails in the end, or whose answer is not what it
should be, gives no rows (typed all the same) and does not stop the others."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

#: names that an option may list; more belong into a table
MOST_NAMES = 100_000


class Request:
    """How to ask: options as the source has them."""

    def __init__(self, url: str, timeout: float = 10.0, retries: int = 3, pause: float = 0.5, batch: int = 100):
        self.url, self.timeout, self.retries, self.pause, self.batch = url, float(timeout), int(retries), float(pause), max(1, int(batch))

    def page(self, names: list[str], token: str | None) -> dict:
        asked = {"names": "|".join(names)} | ({"page": token} if token else {})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(asked)}", timeout=self.timeout) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError):
                if attempt == self.retries:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError("not reached")

    def entries(self, names: list[str]) -> list[dict]:
        """All entries of all pages; none where a page can't be had."""
        found, token, seen = [], None, set()
        try:
            while True:
                got = self.page(names, token)
                found += [e for e in got["results"] if isinstance(e, dict)]
                token = got.get("next")
                if not token or token in seen:  # a service that repeats a page would never end
                    return found
                seen.add(token)
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return []


def _fits(value: object, kind: DataType) -> object:
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else None
    if isinstance(kind, (IntegerType, LongType)):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(kind, ArrayType):
        return [x for x in (_fits(v, kind.elementType) for v in value) if x is not None] if isinstance(value, list) else None
    return None


def rows_of(entries: list[dict], schema: StructType) -> Iterator[tuple]:
    hits: dict[object, int] = {}
    for e in entries:
        query = e.get("query")
        hits[query] = hits.get(query, 0) + 1
        yield tuple(_fits((e | {"hit": hits[query]}).get(f.name), f.dataType) for f in schema.fields)


class _Batch(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        names = list(dict.fromkeys(n for n in json.loads(options.get("names", "[]")) if n))
        if len(names) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} names: use annotated() on a table")
        self.schema, self.names = schema, names
        self.request = Request(options["url"], **{k: options[k] for k in ("timeout", "retries", "pause", "batch") if k in options})

    def partitions(self) -> list[InputPartition]:
        size = self.request.batch
        return [_Batch(self.names[i : i + size]) for i in range(0, len(self.names), size)] or [_Batch([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.names:
            yield from rows_of(self.request.entries(partition.names), self.schema)


class Annotations(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return "query string, hit int, id string, symbol string, sets array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, {k.lower(): v for k, v in self.options.items()})


def annotated(names: DataFrame, column: str, request: Request, schema: str, partitions: int = 8) -> DataFrame:
    """The entries of every distinct name of a table that is not empty; `partitions` bounds how many requests run at a time."""
    kinds = StructType.fromDDL(schema)
    fields = [f.name for f in kinds.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            some = f["name"].tolist()
            for i in range(0, len(some), request.batch):
                yield pd.DataFrame(list(rows_of(request.entries(some[i : i + request.batch]), kinds)), columns=fields, dtype=object)

    asked = names.select(names[column].cast("string").alias("name")).filter("name <> ''").distinct()
    return asked.repartition(partitions).mapInPandas(run, kinds)
