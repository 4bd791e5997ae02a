"""The registered queries on whole tables, and the pipeline."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from omixel.llm import language_id

from . import helpers as h

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()]


def test_names():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_near_copies(spark, documents):
    of = h.classes(documents)
    got = {r.doc_id: r.class_id for r in entry.queries()["op1_minhash_near_dedup"](spark, FOLDER).collect()}
    assert got == {d[0]: documents[c][0] for d, c in zip(documents, of, strict=True)}


@pytest.mark.parametrize(("name", "size"), [("op4_substring_dedup", 20), ("op8_suffix_array_dedup", 50)])
def test_repeats(spark, documents, name, size):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in entry.queries()[name](spark, FOLDER).collect()}
    assert got == {d: (len(w), sum(g)) for d, w, g in h.removed(documents, size)}


def test_vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    got = {r.vec_id: r.n_links for r in entry.queries()["op5_embedding_near_dedup"](spark, FOLDER).collect()}
    assert got == {r.vec_id: int(n) - 1 for r, n in zip(rows, near.sum(1), strict=True)}


def test_language_held_out(spark, documents):
    got = {r.doc_id: r for r in entry.queries()["op6_language_id"](spark, FOLDER).collect()}
    out = [d for d in documents if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert [d[0] for d in out] == sorted(k for k, r in got.items() if r.held_out)
    assert np.mean([got[d[0]].lang_pred == d[2] for d in out]) >= 0.95


def test_language_model_beats_single_words(spark):
    rows = entry.queries()["op9_brown_lm"](spark, FOLDER).collect()
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_pipeline(spark, documents):
    """Each stage against a plain version, on what the stage before it left."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before, by_id = docs.columns, None, {d[0]: d for d in documents}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, FOLDER)
        rows = now.collect()
        if name != "packing":
            assert now.columns == columns
        if name == "language_id":
            told = {r.doc_id: r for r in entry.queries()["op6_language_id"](spark, FOLDER).collect()}
            known = {r["doc_id"]: r["__lang_known"] for r in language_id.identified(docs, language_id.trained(docs)).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in documents if any(c.isalpha() for c in d[1] or "") and known[d[0]] >= corpus_pipeline.LEAST_KNOWN)
            assert all(r.lang == (told[r.doc_id].lang_pred if d[2] is None else d[2]) for r in rows for d in (by_id[r.doc_id],))
        elif name == "minhash_near_dedup":
            of = h.classes(before)
            assert sorted(r.doc_id for r in rows) == sorted(before[c][0] for c in set(of))
        elif name == "suffix_array_dedup":
            kept = {d: [x for x, gone in zip(w, g, strict=True) if not gone] for d, w, g in h.removed(before, 50)}
            assert {r.doc_id: h.words(r.text) for r in rows} == kept
        elif name == "source_mixing":
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
        else:
            sizes = Counter()
            for r in rows:
                sizes[r.sequence_id] += r.length
            assert all(n & (n - 1) == 0 and n <= 4096 for n in sizes.values())
            assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r[0] for r in before)
        docs = spark.createDataFrame(rows, now.schema)
        before = [tuple(r) for r in rows]
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


@pytest.mark.parametrize("lang", [None, "en"])
def test_no_language_to_learn(spark, lang):
    """No labels at all, or held-out ones only: documents with a letter stay, as they do where languages are known."""
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]
    texts = ["some words", "é", "漢", "12 34", "...", "", None, "½"]
    docs = h.frame(spark, [(i, t, lang, "s", 0, 0, "k") for i, t in zip(out, texts, strict=False)])
    kept = corpus_pipeline.tell_language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {"some words", "é", "漢", "½"}
    known = corpus_pipeline.tell_language(spark, docs.union(h.frame(spark, [(i, "some words", "en", "s", 0, 0, "k") for i in range(100) if i not in out])), FOLDER)
    assert {r.text for r in known.collect()} == {"some words"}


@pytest.mark.parametrize("languages", [1, 2, 4, 40])
def test_number_of_languages(languages):
    """The same texts stay and go, however many languages are known: clean texts of a known language stay, junk and other scripts go."""
    rng, flags = random.Random(4), np.zeros(language_id.DIMENSIONS, bool)
    syllables = [[rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "n", "r", "s")) for _ in range(24)] for _ in range(40)]
    say = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."
    clean = [say(0, n) for n in (5, 20, 100, 400)]
    junk = ["zzqx 8123 ||| kkkk", "слово дело и ещё", "0x00ff 0x7f3a 0xdead", "zxqjv wqkzx " * 50, "漢字仮名交じり文", "½"]
    texts = [(f"l{k:02d}", say(k, rng.randrange(50, 300))) for k in range(languages) for _ in range(2400 // 40)]
    model = language_id.fit([(k, language_id.ngrams(t, flags)) for k, t in texts])
    names, _, known = language_id.predict(clean + junk, model, flags)
    assert [k >= corpus_pipeline.LEAST_KNOWN for k in known] == [True] * len(clean) + [False] * len(junk), list(zip(names, known, strict=True))
    assert names[:4] == ["l00"] * 4


def test_language_decides(spark):
    """What no language stands out for goes; a missing lang is filled with the prediction."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    unlabelled = [i for i in range(10**6, 10**6 + 40) if zlib.crc32(str(i).encode()) % 4 == 2]
    texts = [r.text for r in docs.filter("lang = 'fr' and length(text) > 300").limit(4).collect()] + [r.text for r in docs.filter("lang = 'de' and length(text) > 300").limit(4).collect()]
    more = spark.createDataFrame([(i, t, None, "s", 0) for i, t in zip(unlabelled, texts, strict=False)], docs.schema)
    kept = corpus_pipeline.tell_language(spark, docs.unionByName(more), FOLDER).filter("doc_id >= 1000000").orderBy("doc_id").collect()
    assert [r.lang for r in kept] == ["fr"] * 4 + ["de"] * 4
    told = language_id.identified(docs, language_id.trained(docs)).collect()
    assert min(r["__lang_known"] for r in told) > corpus_pipeline.LEAST_KNOWN  # all are clean enough to stay
    least = corpus_pipeline.LEAST_KNOWN
    try:
        corpus_pipeline.LEAST_KNOWN = 0.99
        kept = {r.doc_id for r in corpus_pipeline.tell_language(spark, docs, FOLDER).collect()}
    finally:
        corpus_pipeline.LEAST_KNOWN = least
    assert kept == {r.doc_id for r in told if r["__lang_pred"] != "und" and r["__lang_known"] >= 0.99} and 0 < len(kept) < len(told)


def test_scratch_goes(spark):
    """Of what the pipeline writes on its way only the result stays."""
    from omixel.llm import cluster

    path = spark._jvm.org.apache.hadoop.fs.Path(cluster.shared_dir(spark))
    there = lambda: {str(f.getPath()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    before = there()
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert len(there() - before) == 1
