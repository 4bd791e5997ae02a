"""Personal data, fill-in-the-middle and runs: each against a plain version, on messy input and on none."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from omixel.llm import fill_middle, periodic_runs, personal_data

from . import helpers as h

FOLDER = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with a messy documents table: that of the helpers, spans of all kinds, stretches that repeat, a text of ten million characters."""
    rng, folder = random.Random(5), str(tmp_path_factory.mktemp("messy"))
    rows = h.corpus()
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n))
    texts = [*PERSONAL, "<P> a\nb\n", "a\n\n\nb", "\n", "\n\n\n", "no end\nof line", "x <M", "é\n漢\n\U0001f600\n", (say(30) + "\n") * 5, "a " * 100, "a b " * 11 + "a", say(40) + " " + "p q r s t u v " * 4 + say(5)]
    for n in (24, 25, 71, 72, 73, 300, 24, 30, 40, 50, 60, 70):
        unit = say(rng.randrange(1, 20)).split()
        texts.append(" ".join([*say(10).split(), *(unit * n)[:n], *say(10).split()]))
    rows += [(1000 + i, t, "en", "s", len(t), 0, "k") for i, t in enumerate(texts)]
    long = " ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(1_500_000)) + " to me@long.example.org " + "1" * 1_000_000 + " " + "a." * 200_000 + "@"
    rows.append((5000, long, "en", "s", len(long), 0, "k"))
    spark.createDataFrame(rows, h.SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


PERSONAL = [
    "write to a.b@c.de, x@y.z.org@q.r or a@b.c_d@e.f; not @b.c nor a@b",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 1.2.3 12.34.56.078",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 5500000000000004 1 2 3 4 5 6 7 8 9 0 1 2",
    "+49 (0)30 123456-78 +1 (017) 555-7713 +1-2 +123456789012345678 + 1 234567890 +44 20.7946.0958.",
    "mail: jane (at) mail (dot) com or joe at example dot org; meet at noon. Then",
    "call me on 555-123-4567 or (030) 1234 5678, version 1 23 45, on 2024-01-05",
    "SSN 123-45-6789 and 000-12-3456; Dear Maria Schmidt, New York said Monday Morning",
    "漢字\U0001f600 é@x.com 😀a@b.cd +3312345678901 é",
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base(text):
    out, digits = [], lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_personal_data(spark, tables):
    folder, rows = tables
    got = entry.queries()["op11_personal_data"](spark, folder).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        # the plain patterns are quadratic on the long text: of that, only the pieces that can match
        found = base(r[1] or "") if r[0] != 5000 else [(r[1].index("me@long"), 0, r[1].index("me@long") + len("me@long.example.org"))]
        said = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in found)
        want.append((str(r[0]), *[sum(k == i for _, k, _ in found) for i in range(4)], sha(said)))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    spans = {r.doc_id: r.spans.split(",") for r in got}
    texts = {r[0]: r[1] for r in rows}
    added = {(k, texts[d][int(a) : int(b)]) for d, items in spans.items() if d is not None and d >= 1000 for k, a, b in (x.split(":") for x in items if x)}
    assert {("email", "jane (at) mail (dot) com"), ("email", "joe at example dot org"), ("phone", "555-123-4567"), ("ssn", "123-45-6789"), ("name", "Maria Schmidt")} <= added
    assert not {x for k, x in added if x in ("2024-01-05", "Monday Morning", "New York", "1 23 45", "000-12-3456")}
    assert all(set(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base(texts[d])) <= set(items) for d, items in spans.items() if d is not None and 1000 <= d < 5000)


def test_personal_data_is_native(spark, tables):
    plan = personal_data.judged(spark.read.parquet(f"{tables[0]}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|RDD", plan)


def test_reliabilities(spark):
    """Expectation-maximisation as plain loops; and reliable labelers get more weight than noise."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.5, 0.7])
    votes = np.where(rng.random((4000, 5)) < 0.2, 1, np.where((rng.random((4000, 5)) < right) == truth[:, None], 2, 0))
    frame = spark.createDataFrame([(0, [int(x) for x in v], [0] * 5) for v in votes], "kind int, votes array<int>, features array<int>")
    state = personal_data.reliabilities(frame)[0]
    mine = [0.0] + [v for _ in range(5) for v in (-1.4, 0.0, 1.4)]
    for _ in range(30):
        odds = mine[0] + sum(np.array(mine[1 + 3 * j : 4 + 3 * j])[votes[:, j]] for j in range(5))
        p = 1 / (1 + np.exp(-odds))
        new = [math.log((p.sum() + 1) / ((1 - p).sum() + 1))]
        for j in range(5):
            for v in range(3):
                prior = ((8, 5, 2), (2, 5, 8))
                new.append(math.log((p[votes[:, j] == v].sum() + prior[1][v]) / (p.sum() + 15)) - math.log(((1 - p)[votes[:, j] == v].sum() + prior[0][v]) / ((1 - p).sum() + 15)))
        mine = new
    assert np.allclose(state, mine, atol=1e-6)
    spread = [state[3 + 3 * j] - state[1 + 3 * j] for j in range(5)]
    assert spread[0] > spread[1] > spread[2] > spread[4] > spread[3]
    assert ((p > 0.5) == truth).mean() > 0.93


def test_masked(spark):
    docs = spark.createDataFrame([(1, PERSONAL[0]), (2, None), (3, "plain"), (4, "é a@b.cd x")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in personal_data.masked(docs).collect()}
    assert got == {1: "write to <email>, <email>@q.r or <email><email>; not @b.c nor a@b", 2: "", 3: "plain", 4: "é <email> x"}


def plain_cut(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark, tables):
    folder, rows = tables
    got = sorted(str(tuple(r)) for r in entry.queries()["op12_fill_middle"](spark, folder).collect())
    want = []
    for r in rows:
        n, form, p, m, out = plain_cut(r[0], r[1] or "")
        want.append(str((r[0], n, form, p, m, sha(out), sha(r[1] or ""))))
    assert got == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.text("a\n <PSM>é\U0001f600", max_size=40), st.sampled_from(["lines", "words", "characters"]))
def test_units(text, unit):
    pattern = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*|[\x20\x09-\x0d]+", "characters": "(?s:.)"}[unit]
    ends = fill_middle.unit_ends(np.frombuffer(text.encode("utf-32-le"), "<u4"), unit)
    assert ends.tolist() == [m.end() for m in re.finditer(pattern, text)]
    n, form, p, m, s = fill_middle.cut(text, "1", unit)
    assert n == len(ends) and (form == "plain" and s == text or p + m + s == text)


def test_fill_middle_options(spark):
    docs = spark.createDataFrame([(i, f"line {i}\n" * 5, "x") for i in range(300)], "doc_id int, text string, __form string")
    got = fill_middle.transformed(docs, unit="words", rate=50, spm=20)
    assert got.columns == ["doc_id", "text", "__form", "__units", "__form_", "__prefix", "__middle", "__suffix"]
    rows = got.withColumn("out", fill_middle.output(F.col("__form_"), F.col("__prefix"), F.col("__middle"), F.col("__suffix"))).withColumn("back", fill_middle.restored(F.col("__form_"), F.col("out"))).collect()
    share = {f: sum(r["__form_"] == f for r in rows) for f in ("plain", "spm", "psm")}
    assert 110 < share["plain"] < 190 and 10 < share["spm"] < 60 and all(r.back == r.text and r["__form"] == "x" and r["__units"] == 10 for r in rows)


def plain_runs(x, least=24, exponent=3):
    """Of each period the maximal stretches, without those that have a smaller period."""
    out, n = {}, len(x)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and (i, j + q - i) not in out:
                out[i, j + q - i] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(0, 60), st.integers(1, 9), st.sampled_from([(24, 3), (2, 2), (6, 3), (12, 4)]))
def test_runs(x, start, period, bounds):
    x = [c if i < start else x[start + (i - start) % period] if start + (i - start) % period < len(x) else 0 for i, c in enumerate(x)]
    want = plain_runs(x, *bounds)
    assert periodic_runs.runs_of(x, *bounds) == want
    found = [(i + s, length, q) for i, j in periodic_runs.stretches(np.array(x, np.int32), np.array([0, len(x)]), *bounds) for s, length, q in periodic_runs.runs_of(x[i:j], *bounds)]
    assert sorted(found) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_lyndon(x):
    n = len(x)
    after, agree = periodic_runs.lyndon(x)
    for i in range(n):
        assert after[i] == next((j for j in range(i + 1, n) if x[j:] < x[i:]), n)
        if after[i] < n:
            j = after[i]
            assert agree[i] == next(k for k in range(n) if j + k == n or x[i + k] != x[j + k])


class _Counted(int):
    compared = 0

    def __eq__(self, other):
        _Counted.compared += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("n", [2000, 8000])
def test_lyndon_is_linear(n):
    words = [[0] * n, [i % 7 for i in range(n)], [bin(i).count("1") % 2 for i in range(n)]]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for x in [*words, b[:n], [0] * (n // 2) + [1] + [0] * (n // 2)]:
        for sign in (1, -1):
            _Counted.compared = 0
            periodic_runs.lyndon([_Counted(sign * c) for c in x])
            assert _Counted.compared <= 4 * n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("ab \t\x0b\r\x1c\xa0 é", max_size=30), max_size=6))
def test_words_of(texts):
    words, first = periodic_runs.words_of(pa.array(texts, pa.string()))
    assert [words.to_pylist()[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [h.words(t) for t in texts]


def test_periodic_runs(spark, tables):
    folder, rows = tables
    got = {}
    for r in entry.queries()["op13_periodic_runs"](spark, folder).collect():
        got.setdefault(str(r.doc_id), []).append(str(tuple(r)[1:]))
    seen = 0
    for r in rows:
        if r[0] == 5000:
            assert len(got["5000"]) == 1
            continue
        w = h.words(r[1])
        code = zlib.crc32(str(r[0]).encode())
        g, n = code // 10, len(w)
        if code % 10 == 0 and n and r[0] is not None:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 3000:
            continue
        runs = plain_runs(w)
        seen += len(runs)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        told = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
        want = (len(runs), *told, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
        assert str(want) in got[str(r[0])], (r[0], want, got[str(r[0])])
    assert seen > 10


def test_without_runs(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 20 + "y", 5), (2, " few \n words ", 6), (3, None, 7)], "doc_id long, text string, __runs int")
    got = {r.doc_id: (r.text, r["__runs"]) for r in periodic_runs.without_runs(docs).collect()}
    assert got == {1: ("x a b c y", 5), 2: (" few \n words ", 6), 3: (None, 7)}


@pytest.mark.parametrize("name", ["op11_personal_data", "op12_fill_middle", "op13_periodic_runs"])
def test_nothing(spark, tables, tmp_path, name):
    spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()[name](spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_given_tables(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in entry.queries()["op11_personal_data"](spark, FOLDER).collect()}
    assert {d: sha(",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base(t))) for d, t in docs.items()} == {d: r.base_sha256 for d, r in got.items()}
