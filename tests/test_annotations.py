"""The annotation source against recorded pages, served by a thread of this process."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from omixel.operators import enrich
from omixel.sources.annotations import Annotations, Request, annotated

SCHEMA = "query string, hit int, id string, symbol string, length int, sets array<string>"
ENTRIES = {
    "alpha": [{"id": "A1", "symbol": "ALP", "length": 10, "sets": ["S1", "S2"]}, {"id": "A2", "symbol": "ALQ", "length": "long", "sets": "S1"}],
    "beta": [{"id": "B1", "symbol": "BET", "sets": ["S2", 5]}],
    "gamma": [{"id": f"G{i}", "symbol": "GAM", "length": i} for i in range(7)],
    "delta": [{"id": "D1", "symbol": None}],
}


@pytest.fixture(scope="module")
def service():
    """Three entries a page; `flaky` fails at first, `broken` always, `garbled` is no JSON, `slow` does not answer in time, `loop` repeats a page."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            names, at = q["names"][0].split("|"), int(q.get("page", ["0"])[0])
            asked[tuple(names), at] += 1
            if "broken" in names or ("flaky" in names and asked[tuple(names), at] == 1):
                return self.send_error(503)
            if "slow" in names:
                time.sleep(1.5)
            found = [{"query": n} | e for n in names for e in ENTRIES.get(n, [{"id": "F1"}] if n in ("flaky", "loop") else [])]
            more = str(at + 3) if at + 3 < len(found) else "0" if "loop" in names else None
            body = b"{not json" if "garbled" in names else json.dumps({"results": found[at : at + 3], "next": more}).encode()
            self.send_response(200)
            self.end_headers()
            try:
                self.wfile.write(body)
            except BrokenPipeError:
                pass

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/search", asked
    server.shutdown()


def _read(spark, url, names, **options):
    spark.dataSource.register(Annotations)
    reader = spark.read.format("annotations").schema(SCHEMA).option("url", url).option("names", json.dumps(names)).option("pause", "0.01").option("timeout", "0.5").option("retries", "2")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_pages_and_types(spark, service):
    df = _read(spark, service[0], ["alpha", "beta", "alpha", "", "gamma", "delta", "nobody"], batch="3")
    got = sorted((r.query, r.hit, r.id, r.symbol, r.length, r.sets) for r in df.collect())
    assert [g[:3] for g in got] == [("alpha", 1, "A1"), ("alpha", 2, "A2"), ("beta", 1, "B1"), ("delta", 1, "D1"), *[("gamma", i + 1, f"G{i}") for i in range(7)]]
    assert got[0][3:] == ("ALP", 10, ["S1", "S2"]) and got[1][3:] == ("ALQ", None, None) and got[2][3:] == ("BET", None, ["S2"]) and got[3][3:] == (None, None, None)
    assert df.rdd.getNumPartitions() == 2


def test_failures(spark, service):
    """A batch that fails for good is empty, typed, and leaves the others alone."""
    url, asked = service
    got = _read(spark, url, ["broken", "flaky", "garbled", "slow", "loop", "beta"], batch="1").collect()
    assert sorted((r.query, r.id) for r in got) == [("beta", "B1"), ("flaky", "F1"), ("loop", "F1"), ("loop", "F1")]
    assert asked[("broken",), 0] == 3 and asked[("flaky",), 0] == 2
    none = _read(spark, "http://127.0.0.1:1/none", ["alpha"])
    assert none.collect() == [] and none.schema.simpleString() == _read(spark, url, []).schema.simpleString() and _read(spark, url, []).collect() == []


def test_look_up_and_sets(spark, service):
    """best_hits and a set catalogue read from the service."""
    names = spark.createDataFrame([("Alpha (kinase)",), ("beta",), ("gamma",), ("nobody",), (None,), ("",)], "name string")
    clean = names.select(F.lower(F.trim(F.regexp_extract("name", r"^([^(]+)", 1))).alias("clean"))
    entries = annotated(clean, "clean", Request(service[0], pause=0.01, batch=2), SCHEMA, 3)
    hits = enrich.best_hits(names, entries, "name", "query", F.col("hit").asc()).select("query_original", "id", "hit").collect()
    assert sorted(tuple(h) for h in hits) == [("Alpha (kinase)", "A1", 1), ("Alpha (kinase)", "A2", 2), ("beta", "B1", 1), *[("gamma", f"G{i}", i + 1) for i in range(5)]]
    membership = entries.select(F.explode("sets").alias("set_id"), F.col("symbol").alias("feature"))
    assert sorted(tuple(r) for r in membership.collect()) == [("S1", "ALP"), ("S2", "ALP"), ("S2", "BET")]
    assert {r.set_id for r in enrich.sized_sets(membership.withColumn("ord", F.lit(0)), 2, 10).collect()} == {"S2"}
