"""One-permutation MinHash fingerprints of texts, in DataFrame functions only.

The words of a text are hashed, each run of `SHINGLE` words (all words, if fewer) becomes one hash, and each
hash goes to one of BINS bins, which keeps the least.  An empty bin borrows from the first non-empty bin of
its own hashed probe sequence (optimal densification: start and odd stride are hashes of the bin, so every bin is
reached and each empty bin chooses by itself).  The low-order BITS bits of each bin make the fingerprint, one
hexadecimal digit a bin.  Two fingerprints agree by chance in 2**-BITS of their bins, which likeness() takes off.

All of it is per row: no shuffle, no Python; only arrays of longs as large as the text's own words.

Defined results: a null text counts as empty; a text without words has the empty fingerprint, like (1.0) to
another such and unlike (0.0) to any other; equal texts, and texts of equal words, have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster

BINS, BITS, SHINGLE = 256, 4, 5
_DIGITS = 64 // BITS  # digits in a long
_REST = 63 - int(math.log2(BINS))  # bits of a hash besides its bin
_NONE = (1 << _REST) - 1


def words_of(text: Column) -> Column:
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a plain reference inside a lambda may be inlined and computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(hashes: Column) -> Column:
    """Array of word hashes -> array of shingle hashes; a short text is one shingle, no word gives no shingle.

    `hashes` has to be a lambda variable (see let)."""
    runs = F.sequence(F.lit(0), F.greatest(F.size(hashes) - SHINGLE, F.lit(0)))
    return F.when(F.size(hashes) == 0, F.array().cast("array<long>")).otherwise(F.transform(runs, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(SHINGLE)])))


def _ints(values: list[int]) -> Column:
    return F.expr(f"array({','.join(map(str, values))})")


def _probes() -> tuple[Column, Column]:
    """For each bin the start and the odd stride of its probe sequence, from a hash of the bin."""
    digests = [int.from_bytes(hashlib.sha256(f"bin {i}".encode()).digest()[:8], "big") for i in range(BINS)]
    return _ints([d % BINS for d in digests]), _ints([(d >> 32) % BINS | 1 for d in digests])


def _bin(keyed: Column) -> Column:
    return F.shiftrightunsigned(keyed, _REST)


def _empty(keyed: Column) -> Column:
    return keyed.bitwiseAND(F.lit(_NONE)) == _NONE


def bin_minima(text: Column) -> Column:
    """BINS longs, bin above hash: the least hash of each bin, or _NONE where it has none."""
    keyed = lambda x: F.shiftleft(x.bitwiseAND(F.lit(BINS - 1)), _REST).bitwiseOR(F.least(F.shiftrightunsigned(x, 64 - _REST), F.lit(_NONE - 1)))
    hashes = F.transform(words_of(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    none = F.expr(f"transform(sequence(0L, {BINS - 1}L), b -> shiftleft(b, {_REST}) | {_NONE}L)")
    least = lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))
    return let(F.sort_array(F.concat(let(hashes, lambda h: F.transform(shingle_hashes(h), keyed)), none)), least)


def densified(minima: Column) -> Column:
    """The minima (a lambda variable) with each empty bin's borrowed from the first filled bin that it probes."""
    starts, strides = _probes()

    def attempt(acc: Column, n: Column) -> Column:
        at = lambda i: (F.get(starts, i) + n * F.get(strides, i)).bitwiseAND(F.lit(BINS - 1))
        return F.transform(acc, lambda x, i: F.when(_empty(x), F.get(minima, at(i))).otherwise(x))

    def rounds(acc: Column, done: int = 0) -> Column:
        """Twice as many attempts each time, as long as a bin is empty; BINS attempts reach every bin."""
        if done >= BINS:
            return acc
        more = max(2, done)
        return F.when(F.exists(acc, _empty), let(F.aggregate(F.sequence(F.lit(done + 1), F.lit(done + more)), acc, attempt), lambda x: rounds(x, done + more))).otherwise(acc)

    return rounds(minima)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint: BINS * BITS bits as longs; no longs for a text without words.

    A bin's digit hashes its minimum with the number of the bin, so that bins with one and the same borrowed
    minimum agree by chance independently of each other."""

    def pack(full: Column) -> Column:
        digit = lambda i: F.xxhash64(F.get(full, i).bitwiseAND(F.lit(_NONE)), i).bitwiseAND(F.lit((1 << BITS) - 1))
        group = lambda g: F.aggregate(F.sequence(F.lit(0), F.lit(_DIGITS - 1)), F.lit(0).cast("long"), lambda acc, j: F.shiftleft(acc, BITS).bitwiseOR(digit(g * _DIGITS + j)))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // _DIGITS - 1)), group)

    some = lambda minima: F.when(F.forall(minima, _empty), F.array().cast("array<long>")).otherwise(let(densified(minima), pack))
    return let(bin_minima(text), some)


def as_string(fingerprint: Column) -> Column:
    """Hexadecimal digits, BITS bits each, one a bin; empty for a text without words."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, without chance agreements, in 0..1."""
    def agreeing(x: Column) -> Column:  # digits of the exclusive or that are 0
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.lit(_DIGITS) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    same = F.aggregate(F.zip_with(a, b, lambda x, y: agreeing(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    chance = 2.0**-BITS
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)))


def with_next(docs: DataFrame, carried: list[str], rows_per_range: int = 500) -> DataFrame:
    """doc_id, text, carried columns, and next_<c> of text and those: the document after it in ascending doc_id.

    The last document is followed by the first; null ids come last; rows that share an id follow each other by text.
    Documents are dealt to ranges of ids.  Each range starts at an id that occurs, and whatever has that id
    is also sent, marked, to the range before, so that no order over all rows is needed."""
    bounds = cluster.id_bounds(docs, math.ceil(docs.count() / rows_per_range))
    n, key = len(bounds), cluster.id_order(F.col("doc_id"))
    at = cluster.range_of(key, bounds)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried, key.alias("key"), at.alias("range"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("after"))
    before = F.struct(((F.col("range") + n - 1) % n).alias("range"), F.lit(1).alias("after"))
    places = F.when(F.col("key") == F.element_at(F.lit(bounds), F.col("range") + 1), F.array(own, before)).otherwise(F.array(own))
    dealt = keyed.withColumn("place", F.explode(places)).select("doc_id", "text", *carried, "key", "place.*")
    order = Window.partitionBy("range").orderBy("after", "key", "text")
    return dealt.select("doc_id", "text", *carried, "after", *[F.lead(c).over(order).alias(f"next_{c}") for c in ["text", *carried]]).filter("after = 0").drop("after")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text, whose last half is the start of the next document, and their likeness."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(texts.withColumn("own", fingerprint(F.col("text"))), ["own"])
    half = F.floor(F.length("text") / 2).cast("int")
    near = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    near = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", "edited")
    return near.withColumn("changed", fingerprint(F.col("edited"))).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
