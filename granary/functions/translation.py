"""Checks of a translated text against its source, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

IDENTIFIER = r"\b(?:[A-Z]{2,}[A-Z0-9_-]*[0-9]*|[A-Za-z]+[0-9][A-Za-z0-9_-]*|[a-z]+_[a-z_]+)\b"


def same_quantities(src: Column, dst: Column) -> Column:
    """The same numbers, as often, on both sides."""
    return T.quantities(src) == T.quantities(dst)


def entities(c: Column) -> Column:
    """Identifiers of a text, sorted: acronyms, codes and snake-case names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({IDENTIFIER})"), 1)))


def kept_entities(src: Column, dst: Column) -> Column:
    """Share of the source's identifiers that the translation has; 1 where there are none."""
    e = entities(src)
    return F.when(F.size(e) == 0, 1.0).otherwise(F.size(F.filter(e, lambda x: F.contains(dst, x))) / F.size(e))


def length_ratio(src: Column, dst: Column) -> Column:
    return F.length(dst) / F.greatest(F.length(src), F.lit(1))


def markup(c: Column) -> Column:
    """Tags, code spans and placeholders of a text, sorted."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(r"(<[^<>]{1,40}>|`[^`]+`|\{[a-z_]+\})"), 1))


def verdict(src: Column, dst: Column, *, low: float = 0.4, high: float = 2.5, entity_share: float = 1.0) -> Column:
    """The first check that fails: empty, length, quantities, entities, markup; else ok."""
    r = length_ratio(src, dst)
    return (
        F.when(dst.isNull() | (F.length(F.trim(dst)) == 0), "empty").when((r < low) | (r > high), "length").when(~same_quantities(src, dst), "quantities")
        .when(kept_entities(src, dst) < entity_share, "entities").when(markup(src) != markup(dst), "markup").otherwise("ok")
    )


def detokenized(c: Column) -> Column:
    """Undoes split punctuation and elisions of French texts."""
    x = F.regexp_replace(c, r" ([.,)\]])", "$1")
    x = F.regexp_replace(x, r"([(\[]) ", "$1")
    return F.regexp_replace(x, r"\b([dlcjmnst]|qu|D|L|C|J|M|N|S|T|Qu) ?' ?(?=\p{L})", "$1'")


def sentences(c: Column) -> Column:
    """Sentences of a line, cut after a stop, question or exclamation mark before white space."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")
