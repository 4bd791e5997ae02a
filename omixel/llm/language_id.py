"""Language identification by string kernels.

The kernel is the blended spectrum presence kernel: a text is the set of its character n-grams, n = 1..N_MAX (lower
case, hashed to DIMENSIONS numbers), and k(x, y) = |x & y| / sqrt(|x| |y|).  LANDMARKS training texts span the
Nyström approximation; one-versus-rest kernel ridge regression is solved in its feature space.  Since the kernel
is an inner product of presence vectors, landmarks and coefficients fold into one matrix of DIMENSIONS x
languages, and a batch of texts is scored by a product of its sparse presence matrix with that.

Bounds: the classifier is fitted on at most `train_docs` labelled rows (two of each language at least), the same number of each language as far
as there are, drawn by a threshold on a hash of id and text, so that few rows are ever ranked, and cut by rank, so that
rows of one id are bounded too; what is sent to the driver is their sets of at most DIMENSIONS numbers, and a count a language.  Every document is scored, over its whole text, by a map without a
shuffle; the model it carries has DIMENSIONS x languages numbers.

Defined results: a null text, or one without a letter, is `und` with score 0; documents with null lang or null doc_id are
never learned from but are predicted; with no labelled document at all everything is `und`; repeated rows are
predicted alike; a column of docs that is called like a new one stays, and the new one gets an underscore more.  lang, source and doc_id are not inputs of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import cluster
from .textarrays import tidy

N_MAX, DIMENSIONS, LANDMARKS, RIDGE = 3, 1 << 16, 192, 1e-2
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHIFT = np.uint64(64 - 16)
_BLOCK = 1 << 20  # characters at once


def ngrams(text: str, flags: np.ndarray) -> np.ndarray:
    """The distinct n-gram numbers of a text; flags is an all-false scratch array of DIMENSIONS."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    for i in range(0, max(1, len(codes)), _BLOCK):
        part = codes[i : i + _BLOCK + N_MAX - 1]
        keys = part * _MULTIPLIERS[0]
        for n in range(1, N_MAX + 1):
            if n > 1:
                if len(part) < n:
                    break
                keys = keys[:-1] * np.uint64(0xD1342543DE82EF95) + part[n - 1 :] * _MULTIPLIERS[n - 1]
            mixed = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            flags[(mixed >> _SHIFT).astype(np.int64)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMENSIONS x languages
    known: np.ndarray  # DIMENSIONS x languages: whether a training text of the language has the n-gram
    level: np.ndarray  # of each language the usual share of a text's n-grams that other training texts have


def fit(examples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """(language, n-gram numbers) -> one-versus-rest ridge regression on Nyström features."""
    languages = sorted({lang for lang, _ in examples})
    if not languages:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros((DIMENSIONS, 0), bool), np.zeros(0))
    chosen: list[np.ndarray] = []  # round robin over the languages
    queues = [[x for lang, x in examples if lang == name] for name in languages]
    for i in range(max(map(len, queues))):
        chosen += [q[i] for q in queues if i < len(q)]
    chosen = chosen[:landmarks]
    basis = np.zeros((len(chosen), DIMENSIONS), np.float32)
    for row, x in zip(basis, chosen, strict=True):
        row[x] = 1 / np.sqrt(len(x))
    kernel = np.array([basis[:, x].sum(1) / np.sqrt(len(x)) for _, x in examples], np.float64)
    values, vectors = np.linalg.eigh(np.array([basis[:, x].sum(1) / np.sqrt(len(x)) for x in chosen], np.float64))
    kept = values > values[-1] * 1e-6
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.hstack([kernel @ root, np.ones((len(examples), 1))])
    signs = np.array([[1.0 if lang == name else -1.0 for name in languages] for lang, _ in examples])
    weight = np.array([1 / len(queues[languages.index(lang)]) for lang, _ in examples])[:, None] * len(examples) / len(languages)
    solved = np.linalg.solve(features.T @ (weight * features) + ridge * len(examples) * np.diag([1.0] * (features.shape[1] - 1) + [0.0]) / features.shape[1], features.T @ (weight * signs))
    # the constant is spread over all n-grams only through the norm, so it is kept as a last row
    weights = np.vstack([basis.T @ (root @ solved[:-1]), solved[-1:]]).astype(np.float32)
    known, level = np.zeros((DIMENSIONS, len(languages)), bool), np.zeros(len(languages))
    for j, name in enumerate(languages):
        own = [x for lang, x in examples if lang == name]
        times = np.bincount(np.concatenate(own), minlength=DIMENSIONS)
        known[:, j] = times > 0
        level[j] = np.median([(times[x] > 1).mean() for x in own])
    return Model(languages, weights, known, level)


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def has_letter(text: Column) -> Column:
    """What a text needs to be predicted; the classes of characters are those of _LETTER."""
    return F.coalesce(text.cast("string").rlike(r"[\p{L}\p{Nl}\p{No}]"), F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(DIMENSIONS, bool)
    for batch in batches:
        sets = [ngrams(t, flags).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), pa.array(sets, pa.binary())], names=["doc_id", "lang", "grams"])
    tidy()


def trained(docs: DataFrame, train_docs: int = 2400, modulus: int = 4, remainder: int = 2) -> Model:
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)
    )
    with_letters = labelled.filter(F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in with_letters.groupBy("lang").count().collect()}  # a row per language, as the model has
    if not counts:
        return fit([])
    quota = max(2, train_docs // len(counts))
    # about twice the quota of each language passes a threshold on a hash of the row, so that few rows are ranked
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * quota + 50) / n))]), F.col("lang"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    sample = with_letters.withColumn("draw", draw).filter(F.col("draw") < share).withColumn("rank", rank).filter(F.col("rank") <= quota)
    rows = sample.select("doc_id", "lang", "text").mapInArrow(_features, "doc_id long, lang string, grams binary").collect()
    rows = sorted(((r.lang, r.doc_id, bytes(r.grams)) for r in rows), key=lambda r: r)
    return fit([(lang, np.frombuffer(g, "<u4").astype(np.int64)) for lang, _, g in rows if g])


def predict(texts: list[str | None], model: Model, flags: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """Of each text the language, its score, and how much of the text is known in it: the share of its n-grams that the language's training
    texts have, over the level that is usual there.  The score is relative to the other languages; what is known does not depend on them."""
    names, scores, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and model.languages and _LETTER.search(t)]
    if rows:
        sets = [ngrams(texts[i], flags) for i in rows]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        decision = np.add.reduceat(model.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / np.sqrt(sizes)[:, None] + model.weights[-1]
        e = np.exp(4 * (decision - decision.max(1, keepdims=True)).astype(np.float64))
        share = e / e.sum(1, keepdims=True)
        best = decision.argmax(1)
        seen = np.add.reduceat(model.known[flat, np.repeat(best, sizes)].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes
        level = model.level[best]
        relative = np.where(level > 0, seen / np.where(level > 0, level, 1.0), 1.0)  # a language of one text has no level
        for i, b, row, r in zip(rows, best.tolist(), share, relative.tolist(), strict=True):
            names[i], scores[i], known[i] = model.languages[b], float(row[b]), r
    return names, scores, known


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __lang_pred, __lang_score and __lang_known (see predict)."""

    place, added = docs.columns.index("text"), [cluster.free_name(docs.columns, c) for c in ("__lang_pred", "__lang_score", "__lang_known")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(DIMENSIONS, bool)
        for batch in batches:
            texts, columns = batch.column(place), ([], [], [])
            for i in range(0, batch.num_rows, 256):
                for column, values in zip(columns, predict(texts.slice(i, 256).to_pylist(), model, flags), strict=True):
                    column += values
            new = [pa.array(c, pa.string() if k == 0 else pa.float64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])
        tidy()

    if docs.schema["text"].dataType != StringType():
        docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(added[0], StringType()), *[StructField(c, DoubleType()) for c in added[1:]]]))
