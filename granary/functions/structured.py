"""Structured values as text: states, criteria, tools, JSON whose strings are exchanged.  Functions named *_udf run in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType

_TOKEN = re.compile(r"\w+|[^\w\s]")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?')


@F.pandas_udf(StringType())
def rendered_state_udf(s: pd.Series) -> pd.Series:
    """JSON text laid out with an indent of one; plain text, and what doesn't parse, as it is."""

    def one(x: str | None) -> str | None:
        if x is None or not x.lstrip().startswith(("{", "[")):
            return x
        try:
            return json.dumps(json.loads(x), indent=1, ensure_ascii=False)
        except ValueError:
            return x

    return s.map(one)


def substituted_udf(table: dict[str, str]) -> object:
    """A function of JSON texts: string values (no keys) that table has are exchanged; all else stays byte for byte.  table is sent to each task."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        def swap(m: re.Match) -> str:
            if m[1] is not None:  # a key
                return m[0]
            new = table.get(json.loads(m[0]))
            return m[0] if new is None else json.dumps(new, ensure_ascii=False)

        return s.map(lambda x: None if x is None else _STRING.sub(swap, x))

    return run


def token_distance(x: list[str], y: list[str]) -> int:
    """The least number of tokens put in, taken out or exchanged that turns x into y.

    One bit for each token of x: a step for each token of y moves all rows of the table of
    distances at once, by an addition.  What both begin and end with is left out first.
    """
    a = 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        a += 1
    z = 0
    while z < min(len(x), len(y)) - a and x[-1 - z] == y[-1 - z]:
        z += 1
    x, y = x[a : len(x) - z], y[a : len(y) - z]
    if not x or not y:
        return len(x) + len(y)
    at: dict[str, int] = {}
    for i, t in enumerate(x):
        at[t] = at.get(t, 0) | 1 << i
    full, last = (1 << len(x)) - 1, 1 << len(x) - 1
    more, less, out = full, 0, len(x)  # steps of +1 and -1 down the column
    for t in y:
        eq = at.get(t, 0)
        same = (((eq & more) + more) ^ more) | eq | less
        right = less | (full & ~(same | more))
        down = more & same
        out += bool(right & last) - bool(down & last)
        right = right << 1 | 1
        less = right & same & full
        more = (down << 1 | ~(same | right)) & full
    return out


@F.pandas_udf(IntegerType())
def edit_words_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    """token_distance of two texts' words and signs."""
    cut = _TOKEN.findall
    return pd.Series([None if a is None or b is None else 0 if a == b else token_distance(cut(a), cut(b)) for a, b in zip(old, new, strict=True)], dtype="Int32")


def edited_line(old: Column, new: Column) -> Column:
    """struct<old,new> of the one line that differs between two texts; null where another number of lines does, or their numbers differ."""
    pair = F.arrays_zip(F.split(old, "\n", -1).alias("old"), F.split(new, "\n", -1).alias("new"))
    found = F.filter(pair, lambda p: ~p["old"].eqNullSafe(p["new"]))
    return F.when((F.size(F.split(old, "\n", -1)) == F.size(F.split(new, "\n", -1))) & (F.size(found) == 1), F.get(found, F.lit(0)))


def leaked(form: Column, rest: Column) -> Column:
    """Whether a surface form stands in a text as words of its own; an empty form never does."""
    quoted = F.concat(F.lit("\\Q"), F.replace(form, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    sign = r"[\p{L}\p{N}_]"
    found = F.regexp_like(rest, F.concat(F.lit(f"(?<!{sign})"), quoted, F.lit(f"(?!{sign})")))
    return F.coalesce((F.length(form) > 0) & found, F.lit(False))


def criterion_text(head: Column, parts: Column) -> Column:
    """'head: main; Key: other' of a map of parts: its `main` first, the others by key, capitals first."""
    rest = F.filter(F.array_sort(F.map_entries(parts)), lambda e: e["key"] != "main")
    named = F.transform(rest, lambda e: F.concat(F.initcap(e["key"]), F.lit(": "), e["value"]))
    return F.concat(head, F.lit(": "), F.array_join(F.concat(F.array_compact(F.array(F.element_at(parts, "main"))), named), "; "))


def tool_text(name: Column, description: Column, params: Column, *, description_chars: int = 200, param_chars: int = 60) -> Column:
    """name(params): description; params: array<struct<name,type,required,description>>, required ones first, texts cut at a number of characters."""
    clip = lambda c, n: F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)
    ordered = F.concat(F.filter(params, lambda p: p["required"]), F.filter(params, lambda p: ~p["required"]))
    one = F.transform(ordered, lambda p: F.concat(p["name"], F.when(p["required"], "").otherwise("?"), F.lit(": "), p["type"], F.when(F.length(p["description"]) > 0, F.concat(F.lit(" – "), clip(p["description"], param_chars))).otherwise("")))
    return F.concat(name, F.lit("("), F.array_join(one, ", "), F.lit("): "), clip(description, description_chars))


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a camel or snake case name that have three letters or more, without 'tool'."""
    parts = F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), 1)
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda t: (F.length(t) > 2) & (t != "tool")))


def dissimilar(gold: Column, others: Column, *, limit: float = 0.2) -> Column:
    """Of others (array<struct<name,description>>) the names that share no name token with gold, and no more than limit of the description's words (Jaccard), sorted."""
    words = lambda d: F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(d), r"[^\p{L}\p{N}_]+", " ")), " "), lambda w: F.length(w) > 3))
    far = lambda a, b: F.size(F.array_intersect(words(a), words(b))) <= limit * F.size(F.array_union(words(a), words(b)))
    fits = F.filter(others, lambda o: (o["name"] != gold["name"]) & ~F.arrays_overlap(name_tokens(o["name"]), name_tokens(gold["name"])) & far(o["description"], gold["description"]))
    return F.array_sort(F.transform(fits, lambda o: o["name"]))


def post_edited(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Glossary rules (pattern, replacement) one after another."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text
