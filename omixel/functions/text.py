"""Column functions on names: routing, classification, symbols, key words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V


def is_immunoglobulin(name: Column) -> Column:
    """A null name is none, so that this and its negation split a table in two."""
    return F.coalesce(name.rlike(f"(?i){V.IMMUNOGLOBULIN}"), F.lit(False))


def category(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for label, words in V.CATEGORIES:
        hit = low.rlike("|".join(w.replace(".", r"\.") for w in words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Other")


def immunoglobulin_subtype(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.rlike("ighv|heavy chain variable|_heavy_"), "Heavy Variable").when(low.rlike("iglv|igkv|light chain variable|_light_"), "Light Variable").otherwise("Other Ig")


def v_gene(name: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(name, r"(?i)(IG[HKL]V\d+-\d+)", 1)), F.lit(""))


def gene_symbol(name: Column) -> Column:
    """A leading symbol, else the first bracketed one, that is no common abbreviation."""
    leading = F.nullif(F.regexp_extract(F.trim(name), r"^([A-Z][A-Z0-9]{1,14})\b", 1), F.lit(""))
    bracketed = F.filter(F.regexp_extract_all(name, F.lit(r"\(([A-Z][A-Z0-9]{1,14})\)"), 1), lambda s: ~s.isin(*V.NOT_A_BRACKETED_SYMBOL))
    return F.coalesce(F.when(~leading.isin(*V.NOT_A_LEADING_SYMBOL), leading), F.get(bracketed, 0))


def before_bracket(name: Column) -> Column:
    return F.trim(F.regexp_extract(name, r"^([^(]+)", 1))


def first_token(text: Column) -> Column:
    return F.get(F.split(F.trim(text), r"\s+"), 0)


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def matched_keywords(name: Column, words: tuple[str, ...] = V.DISEASE_KEYWORDS) -> Column:
    """The words that occur in the name, in the order of the list, joined by commas; empty if none does."""
    return F.array_join(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(name), w)), ", ")


def label(value: Column) -> Column:
    return F.lower(value.cast("string")).isin("ad", "1", "patient", "true").cast("int")


def shortened(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def usable_symbols(rows: DataFrame, column: str, least: int = 2) -> DataFrame:
    """The distinct symbols of two characters or more, without nulls."""
    return rows.filter(F.length(column) >= least).select(column).distinct()
