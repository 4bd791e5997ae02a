"""Fill-in-the-middle: a text is cut at two of its unit borders, and its pieces are put in another order.

Each text is decoded to an array of UTF-32 code points.  Every code point has a class (newline, other white space, anything
else); a unit ends between two neighbours whose classes are a pair of UNITS, and at the end of the text.  The positions of
these ends come from one comparison of the array with itself moved by one place; two ranks, drawn by a hash of
seed and doc_id, choose two of them, and the three slices are encoded again.  A map without a shuffle; memory is a few times
the longest text.

Of n units the prefix holds the smaller, prefix and middle the larger of two ranks out of 0 .. n.  A text stays plain where it
is empty, holds one of the marks `<P>`, `<S>`, `<M>`, or is not drawn (`rate` of 100 are); else it becomes
`<S>`suffix`<P>`prefix`<M>`middle (`spm` of 100) or `<P>`prefix`<S>`suffix`<M>`middle.  Since no piece holds a mark,
and no mark begins with what another ends in, `restored` finds the pieces again.

Defined results: a null text counts as empty: no unit, plain, its output is empty; a null doc_id is drawn for as `null`; rows of one doc_id and text
are cut alike; white space alone is a text like any other; columns of docs stay as they are, a new column of a name that
docs has gets an underscore more; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import cluster
from .textarrays import tidy

MARKS = ("<P>", "<S>", "<M>")
_OTHER, _SPACE, _NEWLINE = range(3)
#: of each kind of unit, the pairs of neighbouring classes between which a unit ends
UNITS = {
    "lines": [(_NEWLINE, _OTHER), (_NEWLINE, _SPACE), (_NEWLINE, _NEWLINE)],
    "words": [(_SPACE, _OTHER), (_NEWLINE, _OTHER)],
    "characters": [(a, b) for a in range(3) for b in range(3)],
}
ADDED = ("__units", "__form", "__prefix", "__middle", "__suffix")


def _classes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint8)
    out[(codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))] = _SPACE
    out[codes == 0x0A] = _NEWLINE
    return out


def unit_ends(codes: np.ndarray, unit: str = "lines") -> np.ndarray:
    """How many code points each unit and those before it take."""
    if not len(codes):
        return np.zeros(0, np.int64)
    between = np.zeros(9, bool)
    between[[3 * a + b for a, b in UNITS[unit]]] = True
    classes = _classes(codes)
    return np.append(np.flatnonzero(between[3 * classes[:-1] + classes[1:]]) + 1, len(codes))


def draws(doc_id: str | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(text: str | None, doc_id: str | None, unit: str = "lines", rate: int = 100, spm: int = 50, seed: int = 7) -> tuple[int, str, str | None, str | None, str]:
    """(units, form, prefix, middle, suffix); of a plain text only the suffix, which is all of it."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = unit_ends(codes, unit)
    one, two, chance, order = draws(doc_id, seed)
    n = len(ends)
    if not n or chance % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    stops = np.concatenate([[0], ends])[[low, high]]
    pieces = (codes[: stops[0]], codes[stops[0] : stops[1]], codes[stops[1] :])
    return n, "spm" if order % 100 < spm else "psm", *(p.tobytes().decode("utf-32-le") for p in pieces)


def transformed(docs: DataFrame, unit: str = "lines", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """docs with __units, __form (psm, spm, plain), __prefix, __middle (null if plain) and __suffix."""
    place, id_place = docs.columns.index("text"), docs.columns.index("doc_id")
    added = [cluster.free_name(docs.columns, c) for c in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(id_place), batch.column(place)
            for i in range(0, batch.num_rows, 256):
                some = zip(texts.slice(i, 256).to_pylist(), ids.slice(i, 256).to_pylist(), strict=True)
                rows = [cut(t, None if d is None else str(d), unit, rate, spm, seed) for t, d in some]
                new = [pa.array([r[k] for r in rows], pa.string() if k else pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 256).columns, *new], names=[*batch.schema.names, *added])
        tidy()

    if docs.schema["text"].dataType != StringType():
        docs = docs.withColumn("text", F.col("text").cast("string"))
    new = [StructField(c, StringType() if i else LongType()) for i, c in enumerate(added)]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *new]))


def output(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The training text."""
    p, s, m = (F.lit(x) for x in MARKS)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(suffix)


def restored(form: Column, text: Column) -> Column:
    """The text that `output` was made of: from the form and the output alone."""
    between = lambda a, b: F.substring_index(F.substring_index(text, a, -1), b, 1)
    p, s, m = MARKS
    tail = F.substring_index(text, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), tail, between(s, m))).when(form == "spm", F.concat(between(p, m), tail, between(s, p))).otherwise(text)


ORACLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, 'null')) as h from documents),
u as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
  ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from t),
c as (select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form = 'plain' then null else length(prefix) end as prefix_chars, case when form = 'plain' then null else length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
