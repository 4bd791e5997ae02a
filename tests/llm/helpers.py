"""Small messy corpora and plain versions of the operators."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus(seed=0):
    """(doc_id, text, lang, source, n_chars, chunk, key): nulls, blanks, copies, near copies, long texts, ties."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    en = [rng.choice(syllables) + rng.choice(syllables) for _ in range(300)]
    fr = ["é" + rng.choice(syllables) + "où" for _ in range(300)]
    say = lambda n, of=en: " ".join(rng.choice(of) for _ in range(n))
    passage, rows = say(60), []

    def add(text, lang="en", source="s1", doc_id=None):
        rows.append((len(rows) if doc_id is None else doc_id, text, lang, source, None if text is None else len(text), rng.randrange(5), f"k{len(rows) % 3}"))

    for i in range(30):
        add(say(rng.randrange(30, 200)), source=f"s{i % 4}")
    for i in range(20):
        add(say(rng.randrange(30, 120), fr), "fr", f"s{i % 3}")
    base = say(150)
    for i in range(12):  # near copies
        w = base.split()
        w[rng.randrange(150)] = f"changed{i}"
        add(" ".join(w), source="s0")
    for _ in range(5):  # copies
        add(rows[3][1], source="s9")
    for i in range(6):  # a passage in other texts
        add(say(30 + i) + "\n\t" + passage.replace(" ", "  ") + " " + say(20))
    for text in (None, "", " \t\n", "...", "12 34", "hi", "Hi there", "ça", "one two three four", "one two three four five", "<|endoftext|> x", "Σίσυφος ΣΑΣ 漢字  x y"):
        add(text, None if text is None else "en", None)
    add(" ".join(["again and again"] * 40))
    add(say(20_000), source="big")
    add(rows[5][1] + " tail", doc_id=5)  # a doc_id that occurs twice
    rows.append(rows[7])  # a row that occurs twice
    add(say(40), doc_id=10_000_000_000)
    rows.append((None, say(35), "en", "s1", 0, 1, "k"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, key string"


def frame(spark, rows=None, parts=3):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(parts)


def order(row):
    return (row[0] is None, row[0] or 0, row[1] is not None, row[1] or "")


def removed(rows, size):
    """For each row, in order of age: (doc_id, words, which of them a window covers that begins earlier too)."""
    seen, out = set(), []
    for row in sorted(rows, key=order):
        w = words(row[1])
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        out.append((row[0], w, gone))
    return out


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b) if a and b else 0.0


def weighted(text):
    """Each shingle with its weight."""
    w = words(text)
    times = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {s: 1 + math.log(n) for s, n in times.items()}


def likeness(a, b):
    """Weighted Jaccard similarity."""
    common = sum(min(x, b[s]) for s, x in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def classes(rows, threshold=0.8):
    """Class of each row (position of its least member) under links of similarity >= threshold."""
    sets, of = [weighted(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (sets[i] == sets[j] or likeness(sets[i], sets[j]) >= threshold):
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
