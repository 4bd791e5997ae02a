"""Each operator against a plain version, on messy input and on none."""

from __future__ import annotations

import hashlib
import math
import random
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from omixel.llm import brown_lm, buckets, cluster, components, dartminhash, embedding_dedup, fingerprints, language_id, mixing, packing, substring_index, suffix_dedup, url_rules
from omixel.llm.textarrays import Words, pack, unpack

from . import helpers as h

# text arrays

_TEXTS = st.lists(st.none() | st.text("ab \t\n\xa0é漢", max_size=30), max_size=8)


@settings(max_examples=100, deadline=None)
@given(_TEXTS)
def test_words(texts):
    w = Words(pa.array(texts, pa.string()))
    assert w.n_words.tolist() == [len(h.words(t)) for t in texts]
    flat = [x for t in texts for x in h.words(t)]
    hashes = w.hashes().tolist()
    assert len(set(hashes)) == len(set(flat)) and all((a == b) == (x == y) for a, x in zip(hashes, flat, strict=True) for b, y in zip(hashes, flat, strict=True))
    keep = np.array([len(x) % 2 == 0 for x in flat], bool)
    assert w.joined(keep) == [" ".join(x for x in h.words(t) if len(x) % 2 == 0).encode() for t in texts]
    at, hashed = w.windows(2, w.hashes())
    pairs = [p for t in texts for p in zip(h.words(t), h.words(t)[1:], strict=False)]
    assert len(at) == len(pairs) and len(set(hashed.tolist())) == len(set(pairs))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True))
def test_pack(values):
    a = np.array(sorted(values), np.uint64)
    assert (unpack(pack(a)) == a).all()


def test_range_of(spark):
    for n in (1, 2, 3, 7, 8, 9):
        bounds = [10 * i for i in range(n)]
        got = spark.range(-5, 120).select("id", cluster.range_of(F.col("id"), bounds).alias("r")).collect()
        assert all(r.r == max(0, sum(b <= r.id for b in bounds) - 1) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    of = {x: x for p in pairs for x in p}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}


# 4 and 8: repeats


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_substring_index(spark, chunk):
    rows = h.corpus()
    index = substring_index.SubstringIndex(spark, size=20, n_buckets=5, fan_in=2, chunk_bytes=chunk)
    df, out = h.frame(spark), []
    for low, high in ((-1, 20), (21, 60), (61, 1 << 62)):  # three batches: a run, two runs merged, and one of a lower level
        out += index.dedup(df.filter(f"doc_id between {low} and {high}" + (" or doc_id is null" if high > 60 else ""))).collect()
    assert [level for level, _ in index.runs] == [1, 0]
    want = [(d, len(w), sum(g), hashlib.sha256(" ".join(x for x, gone in zip(w, g, strict=True) if not gone).encode()).hexdigest()) for d, w, g in h.removed(rows, 20)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 500
    index.drop_runs()


def test_colliding_hashes_are_told_apart_by_the_check(monkeypatch):
    """With word hashes of two values most windows collide in the hash; within a chunk, across chunks and in runs the check decides."""
    monkeypatch.setattr(Words, "hashes", lambda self: self.checks() % np.uint64(2))
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(9)]
    tables = [pa.table({"chunk": [c] * 3, "doc_id": list(range(3 * c, 3 * c + 3)), "text": texts[3 * c : 3 * c + 3]}) for c in range(3)]
    send, merge, resolve = substring_index._send(6, 1), substring_index._merge(True, 1), substring_index._resolve(6, 1)
    history, got = [], []
    for part in (tables[:1], tables[1:]):
        sent = pa.concat_tables([send(t) for t in part])
        past = [pa.table({"chunk": pa.array([None] * r.num_rows, pa.int64()), **{c: r[c] for c in ("bucket", "hashes", "checks")}}) for r in history]
        answers = pa.Table.from_batches(merge(iter(pa.concat_tables([sent, *past]).to_batches())))
        history.append(answers.filter(pc.less(answers["chunk"], 0)).select(["bucket", "part", "hashes", "checks"]))
        for t in part:
            got += resolve(t, answers.filter(pc.equal(answers["chunk"], t["chunk"][0]))).select(["doc_id", "n_removed"]).to_pylist()
    runs = h.grouped((r["part"], r) for r in pa.concat_tables(history).to_pylist())
    merged = [substring_index._compact(pa.Table.from_pylist(r, history[0].schema)) for r in runs.values()]
    want = [(d, sum(g)) for d, _, g in h.removed(list(enumerate(texts)), 6)]
    assert [(r["doc_id"], r["n_removed"]) for r in got] == want and 0 < sum(n for _, n in want) < 9 * 40
    assert sum(len(unpack(t["hashes"][0].as_py())) for t in merged) == len({tuple(t.split()[i : i + 6]) for t in texts for i in range(35)})


def test_a_window_is_rewritten_once_a_level(spark, monkeypatch):
    """40 batches: nothing is merged more often than log3(40), and few runs are left."""
    index, rewritten = substring_index.SubstringIndex(spark, fan_in=3), Counter()
    holds = {}

    class Reader:
        def __init__(self, runs):
            self.ids = [i for _, path in runs for i in holds[path]]
            rewritten.update(self.ids)

        def groupBy(self, *_):  # noqa: N802
            return self

        def applyInArrow(self, *_):  # noqa: N802
            return self

        @property
        def write(self):
            return self

        def parquet(self, path):
            holds[path] = self.ids

    monkeypatch.setattr(substring_index.SubstringIndex, "_read", lambda self, runs: Reader(runs))
    monkeypatch.setattr(cluster, "remove", lambda spark, path: holds.pop(path))
    for i in range(40):
        holds[f"batch-{i}"] = [i]
        index.runs.append((0, f"batch-{i}"))
        index._made += 1
        index.compact()
    assert sorted(i for x in holds.values() for i in x) == list(range(40)) and len(holds) <= 8
    assert max(rewritten.values()) == 3 and {path for _, path in index.runs} == set(holds)


def test_batches_are_cut_by_bytes_and_rows(spark):
    rows = [(i, "long " * (1000 if i < 20 else 1), "en", "s", 0, 0, "k") for i in range(400)]
    got = substring_index.batches_of(h.frame(spark, rows), 4)
    assert len(got) == 4 and sum(n for _, n in got) == sum(len(r[1]) for r in rows)
    assert got[0][0] == 0 and max(n for _, n in got) <= 2 * sum(n for _, n in got) / 4 + 7 * 5000  # a range has 7 ids at most
    assert substring_index.batches_of(h.frame(spark, []), 4) == [(0, 0)]


def test_the_index_is_compacted_in_the_query(spark, monkeypatch):
    made = []
    compact = substring_index.SubstringIndex.compact
    monkeypatch.setattr(substring_index.SubstringIndex, "compact", lambda self: (made.append(len(self.runs)), compact(self))[1])
    substring_index.dedup_documents(h.frame(spark)).count()
    assert made == [3]


@pytest.mark.parametrize("doc_id", [7, None])
def test_one_id_is_many_chunks(spark, doc_id):
    """10,000 rows of one id, or of none, beside one long text: no chunk takes more than its bytes and one text."""
    rows = [(doc_id, f"{i % 5000:05d} some words of it", "en", "s", 0, 0, "k") for i in range(10_000)] + [(3, "w " * 20_000, "en", "s", 0, 0, "k")]
    docs = h.frame(spark, rows)
    chunks = cluster.with_chunk(docs, 4000, cluster.text_bytes(docs), F.struct("chunk", "key"), range_bytes=50_000)
    by = chunks.groupBy("chunk").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows"), F.min("text").alias("low"), F.max("text").alias("high"), F.count("doc_id").alias("ids")).orderBy("chunk").collect()
    assert sum(r.rows for r in by) == 10_001 and len(by) > 40
    assert all(r.n <= 4100 or r.rows < 200 and r.n < 44_100 for r in by)
    same = [r for r in by if r.low[0] != "w" and r.high[0] != "w"]
    assert all(a.high <= b.low for a, b in zip(same, same[1:], strict=False))
    assert len({r.chunk >> cluster._SEQUENCE_BITS for r in by}) > 2
    got = suffix_dedup.repeated_passages(docs, 4, 2, 4000).agg(F.sum("n_removed")).first()[0]
    assert got == sum(sum(g) for _, _, g in h.removed(rows, 4))


def test_dedup_documents(spark):
    got = substring_index.dedup_documents(h.frame(spark)).collect()
    assert Counter(r.kept_sha256 for r in got) == Counter(hashlib.sha256(" ".join(x for x, gone in zip(w, g, strict=True) if not gone).encode()).hexdigest() for _, w, g in h.removed(h.corpus(), 20))
    assert substring_index.dedup_documents(h.frame(spark, [])).collect() == []


@pytest.mark.parametrize(("length", "k", "chunk"), [(50, 16, 2000), (20, 6, 1 << 20), (12, 4, 500)])
def test_suffix_dedup(spark, length, k, chunk):
    rows = h.corpus()
    want = h.removed(rows, length)
    got = suffix_dedup.repeated_passages(h.frame(spark), length, k, chunk).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=key) == sorted(((d, len(w), sum(g)) for d, w, g in want), key=key)
    for r in got:
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed and all(0 <= s.begin < s.end <= r.n_words for s in r.spans)
    texts = suffix_dedup.without_repeats(h.frame(spark), length, k, chunk)
    assert texts.columns == h.frame(spark).columns
    left = Counter((r.doc_id, tuple(h.words(r.text)), r.lang, r.source, r.chunk, r.key) for r in texts.collect())
    whole = h.grouped((x[0], x) for x in sorted(rows, key=h.order))
    kept = defaultdict(list)
    for d, w, g in want:
        kept[d].append(tuple(x for x, gone in zip(w, g, strict=True) if not gone))
    assert left == Counter((d, w, x[2], x[3], x[5], x[6]) for d, ws in kept.items() for w, x in zip(ws, whole[d], strict=True))
    for r in texts.collect():
        if r.text is not None and r.n_chars != 0:
            assert r.n_chars == len(r.text)
    assert suffix_dedup.without_repeats(h.frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_suffixes_match_as_far_as_their_words_do(seed):
    """Every window of every suffix against a plain search, in texts of few words, where matches end anywhere."""
    rng = random.Random(seed)
    length, k = 8, 3
    say = [[rng.choice(("a", "b", "ab", "é", "a\x01")) for _ in range(rng.randrange(0, 25))] for _ in range(6)]
    w = Words(pa.array([" ".join(x) for x in say]))
    anchors = np.array([i for i in range(len(w.starts)) if rng.random() < 0.6], np.int64)
    flat = [x for t in say for x in t]
    doc = np.searchsorted(w.first, anchors, side="right") - 1
    asked = np.zeros(len(anchors), np.uint64)
    for i, (p, d) in enumerate(zip(anchors.tolist(), doc.tolist(), strict=True)):
        for a in range(length - k + 1):
            if p - a >= w.first[d] and p - a + length <= w.first[d + 1]:
                asked[i] |= np.uint64(1 << a)
    got = suffix_dedup.repeated_windows(*suffix_dedup.contexts(w, anchors, asked, length, k), anchors, asked, length, k)
    for a in range(length - k + 1):
        seen = set()
        for i, p in enumerate(anchors.tolist()):
            if int(asked[i]) >> a & 1:
                window = tuple(flat[p - a : p - a + length])
                assert bool(int(got[i]) >> a & 1) == (window in seen)
                seen.add(window)


def test_equal_hashes_of_different_words_do_not_match(spark, monkeypatch):
    """Passages are told apart by words: with hashes of three values nearly all collide."""
    c = suffix_dedup._Chunk(pa.table({"doc_id": [1, 2, 3], "text": [" ".join(f"{x}{i}" for i in range(30)) for x in "abb"]}), 10, 4)
    c.windows %= np.uint64(3)
    found = suffix_dedup._Candidates(c, np.ones(len(c.at), bool), 10, 4)
    assert sum(int(x).bit_count() for x in found.repeated) == 21


@pytest.mark.parametrize(("held", "hot_chunks"), [(1, 1000), (7, 3), (10_000, 1), (10_000, 2)])
def test_suffixes_of_hot_words_give_the_same(spark, held, hot_chunks):
    """Held or passed on window by window, split over tasks or not: the same words go."""
    rows = h.corpus()
    want = sorted((d or 0, len(w), sum(g)) for d, w, g in h.removed(rows, 20))
    got = suffix_dedup.repeated_passages(h.frame(spark), 20, 6, 3000, held, hot_chunks).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == want


@pytest.mark.parametrize("different", [1, 5, 40_000])
def test_suffixes_are_a_stream(different):
    """160,000 suffixes of one prefix: memory does not grow with them, and each window but the first of its words repeats."""
    n, step, length, k = 160_000, 4000, 10, 4
    one = [" ".join(f"w{(0 if j < k else i)}x{j}" for j in range(length)) + " " for i in range(different)]
    most = 0

    def batches():
        per = n // different
        for low in range(0, n, step):
            at = np.arange(low, low + step)
            columns = [np.full(step, 7), [one[i // per].encode() for i in at.tolist()], [b""] * step, at, np.zeros(step, int), np.ones(step, int), np.zeros(step, bool), np.zeros(step, bool)]
            names = ["prefix", "suffix", "before", "chunk", "anchor", "windows", "settled", "hot"]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    one.sort()
    began, out = pa.total_allocated_bytes(), []
    for b in suffix_dedup._extend(length, k, 1000)(batches()):
        most = max(most, pa.total_allocated_bytes() - began)
        out += zip(b["words"].to_pylist(), b["chunk"].to_pylist(), strict=True)
    assert most < 8 << 20
    out.sort(key=lambda x: (x[0] or b"", x[1]))
    met = pa.record_batch([pa.array([x[i] for x in out], t) for i, t in ((1, pa.int64()), (0, pa.binary()))], names=["chunk", "words"])
    met = met.append_column("anchor", pa.array(np.zeros(len(out)), pa.int32())).append_column("repeated", pa.array(np.ones(len(out)), pa.int64()))
    got = {c for b in suffix_dedup._compare(iter([met])) for c in b["chunk"].to_pylist()}
    assert got == {i for i in range(n) if i % (n // different)}


def test_suffixes_are_sorted_by_spark(spark):
    plan = suffix_dedup.repeated_passages(h.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "prefix#" in plan and any("Sort [prefix#" in x and "suffix#" in x for x in plan.splitlines())


def test_untouched_texts_stay_as_they_are(spark):
    rows = h.corpus()
    clean = Counter(x[1] for x, (_, _, g) in zip(sorted(rows, key=h.order), h.removed(rows, 50), strict=True) if not any(g))
    got = Counter(r.text for r in suffix_dedup.without_repeats(h.frame(spark)).collect())
    assert not clean - got


# 1: near copies


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        found = []
        for _ in range(12):
            a = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
            b = np.sort(np.concatenate([a[: int(400 * share)], rng.integers(0, 2**63, 400 - int(400 * share)).astype(np.uint64)]))
            s = dartminhash.signatures(np.concatenate([a, b]), np.array([0, 400, 800]))
            found.append((s[0] == s[1]).mean())
        assert np.mean(found) == pytest.approx(share / (2 - share), abs=0.04)


def test_dart_signatures_take_weights():
    found = []
    for i in range(60):
        e = np.arange(4, dtype=np.uint64) * np.uint64(7919) + np.uint64(i * 1_000_003)
        s = dartminhash.signatures(np.concatenate([e, e]), np.array([0, 4, 8]), np.array([3, 1, 2, 2.5, 1, 1, 2, 5.0]))
        assert s.all()
        found.append((s[0] == s[1]).mean())
    assert np.mean(found) == pytest.approx(6.5 / 11, abs=0.03)


def test_links_of_weighted_sets():
    """Two sets of equal elements are apart by their weights alone; a third is near both."""
    e = np.arange(10, dtype=np.uint64)
    weights = [np.full(10, 1.0), np.full(10, 1.2), np.full(10, 1.4)]
    assert {frozenset(p) for p in dartminhash.linked([e, e, e], weights=weights)} == {frozenset({0, 1}), frozenset({1, 2})}
    assert dartminhash.linked([e, e], weights=[weights[0], weights[2]]) == []


def test_repeated_shingles_weigh_more():
    values, edges, weights = dartminhash.shingle_sets(pa.array(["a b c d e " * 3, "a b", None]))
    assert edges.tolist() == [0, 5, 6, 6] and sorted(weights[:5].tolist()) == pytest.approx(sorted([1 + math.log(3)] + [1 + math.log(2)] * 4)) and weights[5] == 1


def test_no_bucket_is_compared_twice(spark):
    """Buckets of the same nodes are one; a large bucket is cut so that every two nodes meet, once."""
    rows = [(k, n) for k, nodes in ((1, range(50)), (2, range(50)), (3, (7, 8)), (4, (9,)), (5, range(40, 60))) for n in nodes]
    kept = buckets.kept_buckets(spark.createDataFrame(rows, "key long, node long"))
    assert {r.key for r in kept.collect()} == {1, 3, 5}
    for within in (True, False):
        met = Counter()
        for task in h.grouped(((r.bin, r.low, r.high), r) for r in buckets.dealt(kept.withColumn("size", F.lit(1)), 12, within).collect()).values():
            for own in h.grouped((r.key, r) for r in task).values():
                sides = [{r.node for r in own if r.block == side} for side in (own[0].low, own[0].high)]
                if own[0].low == own[0].high:
                    pairs = [(own[0].key, a, b) for a in sides[0] for b in sides[0] if a < b]
                else:
                    pairs = [(own[0].key, *sorted((a, b))) for a in sides[0] for b in sides[1]]
                    pairs += [] if within else [(own[0].key, a, b) for s in sides for a in s for b in s if a < b]
                met.update(pairs)
        want = {(k, a, b) for k, nodes in ((1, range(50)), (3, (7, 8)), (5, range(40, 60))) for a in nodes for b in nodes if a < b}
        assert set(met) == want and (not within or max(met.values()) == 1)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_linked_connects_what_is_connected(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 12, 40)[: rng.integers(1, 12)]).astype(np.uint64) for _ in range(25)]
    of = list(range(25))

    def find(o, x):
        while o[x] != x:
            x = o[x]
        return x

    for i in range(25):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) / len(a | b) >= 0.8:
                x, y = find(of, i), find(of, j)
                of[max(x, y)] = min(x, y)
    mine = list(range(25))
    for i, j in dartminhash.linked(sets):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        assert len(a & b) / len(a | b) >= 0.8
        x, y = find(mine, i), find(mine, j)
        mine[max(x, y)] = min(x, y)
    assert [find(mine, i) for i in range(25)] == [find(of, i) for i in range(25)]


@pytest.mark.parametrize("block", [(1000, 5), (2_000_000, 2000)])
def test_near_copies(spark, block):
    rows = sorted(h.corpus(), key=h.order)
    of = h.classes(rows)
    least = {c: min((rows[i][0] for i in range(len(rows)) if of[i] == c and rows[i][0] is not None), default=None) for c in set(of)}
    want = Counter((r[0], least[c] if h.words(r[1]) else r[0]) for r, c in zip(rows, of, strict=True))
    got = dartminhash.classes(h.frame(spark), *block).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert all(r.doc_id == r.class_id for r in got if r.kept)
    kept = h.grouped((r.class_id, r.text_hash) for r in got if r.kept)
    assert set(kept) == {r.class_id for r in got} and all(len(set(v)) == 1 for k, v in kept.items() if k is not None)


def test_deduplicated(spark):
    rows = h.corpus()
    kept = dartminhash.deduplicated(h.frame(spark))
    assert kept.columns == h.frame(spark).columns
    got = kept.collect()
    of = h.classes(sorted(rows, key=h.order))
    assert len({frozenset(h.weighted(r.text).items()) for r in got if h.words(r.text)}) == sum(1 for r in got if h.words(r.text)) == len({c for r, c in zip(sorted(rows, key=h.order), of, strict=True) if h.words(r[1])})
    assert dartminhash.deduplicated(h.frame(spark, [])).collect() == []


# 5: vectors


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((12, 16))
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(16) * (0.02 if i % 3 else 0.06)
        rows.append((i, [float(x) for x in np.float32(v)], i % 2))
    rows += [(200 + i, rows[0][1], 0) for i in range(4)] + [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, rows[0][1], None), (305, rows[0][1][:8], 0), (306, [None, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    ok = [i for i, (_, v, x) in enumerate(rows) if v and x is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, of = Counter(), {i: i for i in range(len(rows))}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                p, q = find(a), find(b)
                of[max(p, q)] = min(p, q)
    want = {(r[0], links[i], rows[find(i)][0], find(i) == i) for i, r in enumerate(rows)}
    for block in (2000, 7):
        assert set(map(tuple, embedding_dedup.near_duplicates(df, block_vectors=block).collect())) == want
    assert sum(links.values()) > 100
    assert embedding_dedup.near_duplicates(df.filter("vec_id < 0")).collect() == []


def test_table_plan():
    for n in (2, 1000, 10**6, 10**9):
        m, tables = embedding_dedup.table_plan(n)
        assert 1 - (1 - embedding_dedup.collision(0.2) ** m) ** tables > 0.999


# 2: urls


def _judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (host == a or host.endswith("." + a)) and path.startswith(b)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("part_rows", [1, 2000])
def test_urls(spark, part_rows):
    rules = [*url_rules.RULES, ("a.example.net", "/", "allow"), ("example.net", "/e", "block"), ("example.net", "/en/x", "block"), ("com", "/", "block"), ("b.com", "/x/", "allow"), ("a.b.com", "/", "block"), ("a.b.com", "/x/y", "allow")]
    hosts = ["example.net", "a.example.net", "b.a.EXAMPLE.net", "xexample.net", "net", "example.com", "www.example.com", "b.com", "a.b.com", "c.a.b.com", "org", "x.org", "é.org", "", "a..net", "com"]
    paths = ["", "/", "/en/", "/en", "/en/x?q=/de/", "/de/1#x", "/fr/", "/x/", "/x/yz", "?a=/", "#/x", "/É"]
    urls = [f"{s}://{a}{p}" for s in ("http", "https://x") for a in hosts for p in paths] + [None, "", "no url", "://net/", "http://net/\nx", "http://net/", "http://net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_rules.judged(pages, url_rules.rule_table(spark, rules), part_rows=part_rows)
    assert {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in got.collect()} == {i: _judge(u, rules) for i, u in enumerate(urls)}
    assert got.count() == len(urls)
    assert url_rules.judged(pages.limit(0), url_rules.rule_table(spark)).collect() == []


# 3: packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = h.corpus()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*(whole.encode(r[1], add_special_tokens=False).ids if r[1] else []), 2] for r in rows]
    got = packing.packed(h.frame(spark)).collect()
    covered = Counter()
    by_sequence = h.grouped((r.sequence_id, r) for r in got)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    for r in got:
        fits = [i for i, x in enumerate(ids) if rows[i][0] == r.doc_id and len(x) == r.doc_tokens]
        assert any(zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for i in fits)
        covered[r.doc_id, r.doc_tokens] += r.length
    for r in h.grouped((r.document, r) for r in got).values():  # each document, and each copy of it, is whole
        assert sorted(x.start for x in r)[0] == 0 and sum(x.length for x in r) == r[0].doc_tokens
    assert covered == Counter({k: sum(len(x) for i, x in enumerate(ids) if (rows[i][0], len(x)) == k) for k in {(r[0], len(x)) for r, x in zip(rows, ids, strict=True)}})
    assert packing.packed(h.frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_pack_block(lengths):
    windows, rest = packing.pack_block([(i, 0, n) for i, n in enumerate(lengths)], packing.TIERS)
    assert all(sum(p.length for p in w) == t for t, w in windows)
    assert sum(p.length for p in rest) < packing.TIERS[0]
    windows += packing.powers_of_two(rest, packing.TIERS)
    pieces = h.grouped((p.doc, (p.start, p.length)) for _, w in windows for p in w)
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == n


def test_tokens_are_the_tokenizer_s():
    import public_tokenizers

    from omixel.llm.tokens import WordTokenizer

    t = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's THEY'LL 'tis ''s don''t", "naïve ÀÉÎ ß µ ª º ² ¼ ½ 3½", "a\tb\nc\rd", "x\x0by\x1cz", "½ «x» ¡!¿? \xad", "<|endoftext|> <|x|>", "ΣΑΣ", "é", "", None, "a" * 3000]
    for text, ids in zip(texts, t.encode(texts, 2), strict=True):
        assert ids.tolist() == [*(t.whole.encode(text, add_special_tokens=False).ids if text else []), 2]


# 6: languages


def test_language(spark):
    docs = h.frame(spark)
    model = language_id.trained(docs)
    assert model.languages == ["en", "fr"]
    got = language_id.identified(docs, model)
    assert got.columns == [*docs.columns, "__lang_pred", "__lang_score", "__lang_known"]
    rows = got.collect()
    assert len(rows) == len(h.corpus())
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["__lang_pred"] == "und") == (not letters) and 0 <= r["__lang_score"] <= 1
        if len(h.words(r.text)) > 25:
            assert r["__lang_pred"] == r.lang
    none = language_id.trained(h.frame(spark, []))
    assert {r["__lang_pred"] for r in language_id.identified(docs, none).collect()} == {"und"}
    assert language_id.identified(h.frame(spark, []), model).collect() == []


def test_ngrams_are_presence():
    flags = np.zeros(language_id.DIMENSIONS, bool)
    assert (language_id.ngrams("abab", flags) == language_id.ngrams("ABABAB", flags)).all()
    assert len(language_id.ngrams("", flags)) == 0 and not flags.any()
    whole = language_id.ngrams("x" * (language_id._BLOCK + 5) + "yz", flags)
    assert set(language_id.ngrams("xyz", flags)) <= set(whole)


# 7: mixing


def test_targets(spark):
    sizes = [("a", 100), ("b", 10), ("c", 1000), (None, 40), ("d", 0), ("é", 500)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(ordered)}
    target, open_, left = {}, dict(sizes), 1.5 * sum(n for _, n in sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if level * weight[s] > 2 * n]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * open_.pop(s)
            left -= target[s]
    assert got == pytest.approx(target)


def test_mixing(spark):
    docs = h.frame(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(h.corpus())
    for r in rows:
        assert r["__size"] == len(h.words(r.text)) and 0 <= r["__copies"] <= 2 and abs(r["__copies"] - r["__rate"]) < 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter({k: v for k, v in sum((Counter({(r.doc_id, r.text): r["__copies"]}) for r in rows), Counter()).items() if v})
    assert mixing.mixed(h.frame(spark, [])).collect() == []


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 9 as int)) as text", "concat('s', id % 5) as source")
    by = mixing.mix(docs).selectExpr("source", "__target", "__size * __copies as taken").groupBy("source", "__target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] / r["__target"] - 1) < 0.03 for r in by)


# 9: language model


def _plain_likelihood(bigrams, of):
    n = np.zeros((of.max() + 1,) * 2)
    for i in range(len(of)):
        for j in range(len(of)):
            n[of[i], of[j]] += bigrams[i, j]
    f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(6)
    bigrams = rng.poisson(1.0, (14, 14)).astype(float)
    of = brown_lm.exchange_classes(bigrams, 3, 50)
    best = _plain_likelihood(bigrams, of)
    assert of[-2:].tolist() == [3, 4] and of[:12].max() <= 2
    for w in range(12):
        for c in range(3):
            other = of.copy()
            other[w] = c
            assert _plain_likelihood(bigrams, other) <= best + 1e-6


def test_language_model(spark):
    rows = h.corpus()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*h.words((r[1] or "").translate(low)), None] for r in rows]
    learn = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    c = Counter(w for t, ok in zip(tokens, learn, strict=True) if ok for w in t)
    n, v = sum(c.values()), len(c)
    got = brown_lm.scored(h.frame(spark), chunk_bytes=3000).collect()
    want = Counter((r[0], len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for r, t in zip(rows, tokens, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(-1e9 < r.score < 0 for r in got)
    assert brown_lm.scored(h.frame(spark, [])).collect() == []


def test_words_beyond_the_top_have_classes(spark):
    """x and y are all past rank TOP, and stand where c and d stand: their order in a text counts."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        say = []
        for _ in range(40):
            say += [f"a{rng.randrange(260)}", f"c{rng.randrange(260)}", f"d{rng.randrange(260)}", f"b{rng.randrange(260)}"]
        for j in rng.sample(range(200), 1):
            say += [f"a{rng.randrange(260)}", f"x{j}", f"y{rng.randrange(200)}", f"b{rng.randrange(260)}"]
        rows.append((i, " ".join(say), "en", "s", 0, 0, "k"))
    seen = Counter(w for r in rows for w in r[1].split() if zlib.crc32(str(r[0]).encode()) % 7 != 2)
    x, y = (next(w for w, n in seen.items() if w[0] == k and n >= 2) for k in "xy")
    assert max(n for w, n in seen.items() if w[0] in "xy") < sorted(seen.values())[-brown_lm.TOP]
    out = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(i, text, "en", "s", 0, 0, "k") for i, text in zip(out, (f"a1 {x} {y} b1", f"a1 {y} {x} b1"), strict=True)]
    got = {r.doc_id: r.score for r in brown_lm.scored(h.frame(spark, rows)).filter("doc_id >= 1000").collect()}
    assert got[out[0]] > got[out[1]] + 1


def test_best_class_has_the_most_likelihood():
    rng = np.random.default_rng(3)
    bigrams = rng.poisson(2.0, (9, 9)).astype(float)
    before, after = rng.poisson(1.0, 9).astype(float), rng.poisson(1.0, 9).astype(float)
    after[-1] += max(0.0, before.sum() - after.sum())
    before[-1] += max(0.0, after.sum() - before.sum())
    n = np.concatenate([before, after])
    codes = np.flatnonzero(n)
    got = brown_lm.best_classes(bigrams, np.zeros(len(codes), int), codes, n[codes])
    grown = []
    for c in range(7):
        more = bigrams.copy()
        more[:, c] += before
        more[c] += after
        grown.append(_plain_likelihood(more, np.arange(9)))
    assert got.tolist() == [int(np.argmax(grown))]


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    bigrams = rng.poisson(3.0, (12, 12)).astype(float)
    counts = bigrams[:, :10].sum(0).astype(np.int64)
    rare, ends = int(bigrams[:, 10].sum()), int(bigrams[:, 11].sum())
    m = brown_lm.Model(int(counts.sum()) + rare + ends, 10 + 7 + 1, np.arange(10, dtype=np.uint64), counts, bigrams)
    assert (m.rare_tokens, m.rare_types) == (rare, 7)
    shares = np.zeros(m.classes.max() + 1)
    for w, e in enumerate(m.emissions):
        shares[m.classes[w]] += 10**e
    used = sorted({*m.classes[:10].tolist()})
    assert shares[used] == pytest.approx(np.ones(len(used)))
    assert (10**m.transitions).sum(1) == pytest.approx(np.ones(len(m.transitions)))
    # rare words: counts c_i of 7 types and one share for the unseen
    each = np.append(rng.multinomial(rare, [1 / 7] * 7), 0)
    assert ((each + 1) / (rare + 7 + 1)).sum() == pytest.approx(1.0)


# 10: fingerprints


def test_fingerprints(spark):
    rows = h.corpus()
    got = fingerprints.edited_pairs(h.frame(spark)).collect()
    ordered = sorted(rows, key=h.order)
    texts = [r[1] or "" for r in ordered]
    want = []
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        want.append((ordered[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard_of(t, edited), jaccard_of(t, following)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    errors = []
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3]
        errors += [a[5] - b[3], a[6] - b[4]]
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    prints = h.grouped((r.fingerprint, r) for r in got)
    assert all(len(r.fingerprint) in (0, fingerprints.BINS * fingerprints.BITS // 4) for r in got)
    assert len(prints[""]) == sum(not h.words(t) for t in texts)
    assert fingerprints.edited_pairs(h.frame(spark, [])).collect() == []


def jaccard_of(a, b):
    return h.jaccard(h.shingles(a), h.shingles(b))


def test_fingerprints_are_native(spark):
    plan = fingerprints.edited_pairs(h.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_document_follows_itself(spark):
    r = fingerprints.edited_pairs(h.frame(spark, [(1, "a b c d e f", "en", "s", 0, 0, "")])).first()
    assert r.n_chars == 11 and r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


# names and one id


def test_clashing_names(spark):
    """Columns called like what an operator adds, or uses inside, stay as they are."""
    names = ["__size", "__source_size", "__target", "__rate", "__copies", "__copy", "__key", "__host", "__path", "__rule", "__verdict", "__lang_pred", "__LANG_SCORE", "row", "own_hash", "id", "node", "key_", "block", "size", "bin", "rep", "n_removed"]
    docs = h.frame(spark).withColumns({c: F.lit(f"kept {c}") for c in names})

    def kept(out, more):
        assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + more
        rows = out.collect()
        assert rows and all(r[c] == f"kept {c}" for r in rows for c in names)
        return rows

    mixed = mixing.mix(docs)
    assert mixed.columns[-5:] == ["__size_", "__source_size_", "__target_", "__rate_", "__copies_"]
    assert all(r["__size_"] == len(h.words(r.text)) for r in kept(mixed, 5))
    kept(mixing.mixed(docs), 0)
    kept(dartminhash.deduplicated(docs), 0)
    kept(suffix_dedup.without_repeats(docs), 0)
    told = language_id.identified(docs, language_id.trained(docs))
    assert told.columns[-3:] == ["__lang_pred_", "__lang_score_", "__lang_known"]
    kept(told, 3)
    judged = url_rules.judged(docs.withColumn("url", F.lit("http://a.net/")), url_rules.rule_table(spark))
    assert judged.columns[-4:] == ["__host_", "__path_", "__rule_", "__verdict_"] and {(r["__host"], r["__host_"], r["__verdict_"]) for r in judged.collect()} == {("kept __host", "a.net", "block")}
    same = lambda f: Counter(map(str, f(docs).collect())) == Counter(map(str, f(h.frame(spark)).collect()))
    assert same(suffix_dedup.repeated_passages) and same(lambda d: dartminhash.classes(d)) and same(fingerprints.edited_pairs)
    assert packing.packed(docs).count() > 0 and brown_lm.scored(docs).count() == substring_index.dedup_documents(docs).count() == docs.count()


def test_the_sample_of_one_id_is_bounded(spark):
    docs = h.frame(spark, [(1, f"word{i} and more of {i % 7}", "en", "s", 0, 0, "k") for i in range(300)] + [(1, "encore un mot", "fr", "s", 0, 0, "k")] * 300)
    seen = []
    fit = language_id.fit
    try:
        language_id.fit = lambda examples: (seen.append(len(examples)), fit(examples))[1]
        language_id.trained(docs, train_docs=8)
    finally:
        language_id.fit = fit
    assert 0 < seen[0] <= 8


def test_kernel_ridge_is_what_the_plain_kernel_gives():
    """With every example a landmark, decisions are those of kernel ridge regression solved on the kernel matrix itself."""
    rng, flags = random.Random(11), np.zeros(language_id.DIMENSIONS, bool)
    say = lambda of: " ".join("".join(rng.choice(of) for _ in range(5)) for _ in range(8))
    texts = [(k, say(of)) for k, of in (("a", "abcdeu"), ("b", "efghio"), ("c", "klmnoa")) for _ in range(9)]
    sets = [set(language_id.ngrams(t, flags).tolist()) for _, t in texts]
    model = language_id.fit([(k, np.array(sorted(s))) for (k, _), s in zip(texts, sets, strict=True)])
    kernel = np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    n = len(texts)
    ridge = language_id.RIDGE * n / (np.linalg.matrix_rank(kernel) + 1)
    weight = np.full(n, n / 3 / 9)
    system = np.block([[kernel + ridge * np.diag(1 / weight), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    signs = np.array([[1.0 if k == name else -1.0 for name in "abc"] for k, _ in texts])
    solved = np.linalg.solve(system, np.vstack([signs, np.zeros((1, 3))]))
    other = say("abcdek")
    x = set(language_id.ngrams(other, flags).tolist())
    want = np.array([len(x & y) / math.sqrt(len(x) * len(y)) for y in sets]) @ solved[:-1] + solved[-1]
    got = model.weights[sorted(x)].sum(0) / math.sqrt(len(x)) + model.weights[-1]
    assert got == pytest.approx(want, abs=2e-3)


def test_scores_of_the_language_model(spark, monkeypatch):
    """Scores from plain counts over the classes that the model learnt."""
    rows = h.corpus()
    model, folder = [], []
    score, trained = brown_lm._score, brown_lm.trained
    monkeypatch.setattr(brown_lm, "_score", lambda m: (model.append(m), score(m))[1])
    monkeypatch.setattr(brown_lm, "trained", lambda docs, path, *more: (folder.append(path), trained(docs, path, *more))[1])
    got = brown_lm.scored(h.frame(spark), chunk_bytes=3000).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    say = [h.words((r[1] or "").translate(low)) for r in rows]
    names = sorted({x for t in say for x in t})
    of_hash = {}
    for r in spark.read.parquet(folder[0]).collect():
        of_hash |= dict(zip(unpack(bytes(r.hashes)).tolist(), brown_lm._read_numbers(bytes(r.classes), "u1").tolist(), strict=True))
    hashes = Words(pa.array([" ".join(names)])).hashes().tolist()
    rare, end = model[0].rare, model[0].end
    of = {x: of_hash.get(k, rare) for x, k in zip(names, hashes, strict=True)}
    learn = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    counts, pairs = Counter(), np.zeros((end + 1, end + 1))
    for t, ok in zip(say, learn, strict=True):
        counts.update(t if ok else ())
        path = [end, *(of[x] for x in t), end]
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += ok
    size = Counter()
    for x, n in counts.items():
        size[of[x]] += n
    rare_types = sum(of[x] == rare for x in counts)
    assert all(of[x] != rare for x, n in counts.items() if n >= brown_lm.LEAST) and len(set(of.values())) > 30
    to = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))

    def plain(t):
        total, before = 0.0, end
        for x in [*t, None]:
            c = end if x is None else of[x]
            total += math.log10((pairs[before, c] + brown_lm.SMOOTHING * to[c]) / (pairs[before].sum() + brown_lm.SMOOTHING))
            if c == rare:
                total += math.log10((counts[x] + 1) / (size[rare] + rare_types + 1))
            elif c != end:
                total += math.log10(counts[x] / size[c])
            before = c
        return total

    want = Counter((r[0], len(t) + 1, round(plain(t), 4)) for r, t in zip(rows, say, strict=True))
    assert Counter((r.doc_id, r.n_tokens, round(r.score, 4)) for r in got) == want


def test_rows_compared_grow_with_the_vectors():
    """Vectors of one label, three times as many: about three times as many rows have company under a key; nearly all near pairs share one."""
    rng, rows = np.random.default_rng(5), []
    for n in (2000, 6000):
        x = rng.standard_normal((n, 64))
        x[1::10] = x[::10] + rng.standard_normal((n // 10, 64)) * 0.17  # pairs of cosine about 0.986
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        m, tables = embedding_dedup.table_plan(n)
        batch = pa.record_batch([pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array([v.tobytes() for v in x], pa.binary())], names=["node", "label", "vector"])
        keys = np.array([np.frombuffer(k, "<i8") for k in next(embedding_dedup._hash(m, tables)([batch])).column("keys").to_pylist()])
        values, times = np.unique(keys, return_counts=True)
        far = np.isin(keys, values[times > 1])
        far[::10] = far[1::10] = False
        rows.append(far.sum() / n)
        near = np.flatnonzero((x[::10] * x[1::10]).sum(1) >= 0.98)
        met = (keys[10 * near] == keys[10 * near + 1]).any(1)
        assert len(near) > n / 30 and met.mean() >= 0.99
    assert rows[1] < 1.5 * rows[0] + 0.5 and max(rows) < 8


def test_packing_of_many_short_texts_takes_no_square_of_them():
    import time

    began = time.perf_counter()
    windows, rest = packing.pack_block([(i, 0, 40) for i in range(100_000)], packing.TIERS)
    assert time.perf_counter() - began < 5 and sum(p.length for _, w in windows for p in w) + sum(p.length for p in rest) == 4_000_000


def test_step_groups_are_full_until_the_last_block():
    piece = lambda n: [packing._Piece(0, 0, n)]
    windows, counters = [(4096, piece(4096))] * 21 + [(512, piece(512))] * 130, {}
    first = packing._step_groups(windows, 1 << 16, counters, last=False)
    assert Counter(first) == Counter({None: 5 + 2, 4096: 16, 512: 128})
    then = packing._step_groups([w for w, g in zip(windows, first, strict=True) if g is None], 1 << 16, counters, last=True)
    assert Counter(then) == Counter({1 << 13 | 4096: 5, 1 << 13 | 512: 2})


def test_a_source_without_ids_comes_near_its_target(spark):
    """Rows of no id or of one id draw apart by their texts; rows that are the same draw alike."""
    rows = [(None if i % 3 else 5, f"{i} a few words", "en", f"s{i % 2}", 0, 0, "k") for i in range(2000)] + [(5, "the same", "en", "s0", 0, 0, "k")] * 3
    got = mixing.mix(h.frame(spark, rows)).collect()
    for source in ("s0", "s1"):
        own = [r for r in got if r.source == source]
        assert sum(r["__size"] * r["__copies"] for r in own) == pytest.approx(own[0]["__target"], rel=0.1)
    assert len({r["__copies"] for r in got if r.text == "the same"}) == 1


def test_scopes_belong_to_threads(spark):
    def other():
        with cluster.temporary(spark):
            cluster.scratch(spark, "other")

    with cluster.temporary(spark):
        path = cluster.scratch(spark, "own")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert cluster._open() == [[path]]
