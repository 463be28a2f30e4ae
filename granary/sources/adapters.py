"""Adapters: raw rows to decision items, declared as column expressions.

An adapter is a function of a DataFrame that gives the item columns (id, state, type,
instructions, labels, descriptions, target, source, family, lang).  What differs between
data sets is which columns hold what; the shapes below cover them: a class among named
ones, a menu with distractors, yes or no, a rating on levels, a preference of two sides,
answerable or not, a window around a span.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.text import norm_key

Adapter = Callable[[DataFrame], DataFrame]
ITEM = ("id", "state", "type", "instructions", "labels", "descriptions", "target")


def _items(df: DataFrame, ident: Column, state: Column, kind: str, instructions: Column | str, labels: Column, target: Column, descriptions: Column | None = None) -> DataFrame:
    said = F.lit(instructions) if isinstance(instructions, str) else instructions
    blank = F.transform(labels, lambda _: F.lit(""))
    return df.select(ident.cast("string").alias("id"), state.alias("state"), F.lit(kind).alias("type"), said.alias("instructions"), labels.alias("labels"), (blank if descriptions is None else descriptions).alias("descriptions"), target.alias("target"))


def _texts(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def classified(ident: str, state: Column, label: Column, names: tuple[str, ...], instructions: str, *, drop: Column | None = None) -> Adapter:
    """A choice among all names; label is the number of the right one.  Rows with another number are left out."""

    def adapt(df: DataFrame) -> DataFrame:
        rows = df.where(label.between(0, len(names) - 1))
        rows = rows if drop is None else rows.where(~drop)
        return _items(rows, F.col(ident), state, "choice", instructions, _texts(names), P.one_hot(label, F.lit(len(names))))

    return adapt


def menu(ident: str, state: Column, gold: Column, names: Column, instructions: str, *, size: int, other: str = "", seed: int = 0) -> Adapter:
    """A choice of the gold name among `size` of names (an array), by hash; with `other`, a last option that is right where gold is null."""

    def adapt(df: DataFrame) -> DataFrame:
        ranked = F.transform(F.array_except(names, F.array(gold)), lambda x: F.struct(F.md5(F.concat_ws("|", F.col(ident).cast("string"), x, F.lit(str(seed)))).alias("h"), x.alias("x")))
        others = F.transform(F.slice(F.array_sort(ranked), 1, size - 1), lambda s: s["x"])
        shown = F.transform(F.array_sort(F.transform(F.array_compact(F.concat(F.array(gold), others)), lambda x: F.struct(F.md5(F.concat_ws("|", x, F.col(ident).cast("string"))).alias("h"), x.alias("x")))), lambda s: s["x"])
        labels = F.concat(shown, F.array(F.lit(other))) if other else shown
        right = F.coalesce(gold, F.lit(other)) if other else gold
        rows = df if other else df.where(gold.isNotNull())
        return _items(rows, F.col(ident), state, "choice", instructions, labels, F.transform(labels, lambda x: F.when(x == right, 1.0).otherwise(0.0)))

    return adapt


def yes_no(ident: str, state: Column, yes: Column, instructions: Column | str) -> Adapter:
    """yes: a boolean, or a probability of yes.  Null rows are left out."""

    def adapt(df: DataFrame) -> DataFrame:
        p = yes.cast("double")
        return _items(df.where(p.isNotNull()), F.col(ident), state, "noul", instructions, _texts(("no", "yes")), F.array(1.0 - p, p))

    return adapt


def rating(ident: str, state: Column, mean: Column, levels: tuple[str, ...], instructions: str) -> Adapter:
    """A mean rating from 0 to len(levels) - 1 as a distribution on its two levels."""

    def adapt(df: DataFrame) -> DataFrame:
        k = len(levels)
        return _items(df.where(mean.isNotNull()), F.col(ident), state, "score", instructions, _texts(tuple(map(str, range(k)))), P.interpolated(mean.cast("double"), k), _texts(levels))

    return adapt


def preference(ident: str, prompt: Column, first: Column, second: Column, counts: Column, instructions: str, *, ties: bool = True, alpha: float = 0.5) -> Adapter:
    """Two replies to a prompt, side by side; counts (array of votes for each option) are smoothed to a target."""

    def adapt(df: DataFrame) -> DataFrame:
        state = F.concat_ws("\n\n", prompt, F.concat(F.lit("Reply A:\n"), first), F.concat(F.lit("Reply B:\n"), second))
        names = ("A", "B", "tie") if ties else ("A", "B")
        return _items(df, F.col(ident), state, "choice", instructions, _texts(names), P.vote_target(counts, alpha))

    return adapt


def answerable(ident: str, context: Column, question: Column, answers: Column) -> Adapter:
    """Does the text answer the question: no answers (an array) is no."""

    def adapt(df: DataFrame) -> DataFrame:
        return yes_no(ident, context, F.size(answers) > 0, F.concat(F.lit("Does the text answer this question? "), question))(df)

    return adapt


def negated(adapter: Adapter, negate: Callable[[Column], Column]) -> Adapter:
    """The twin of a yes-no adapter: negated instructions, swapped target; rows whose instructions don't change are left out."""

    def adapt(df: DataFrame) -> DataFrame:
        x = adapter(df).withColumn("__n", negate(F.col("instructions"))).where((F.col("__n") != F.col("instructions")) & (F.col("type") == "noul"))
        return x.withColumn("instructions", F.col("__n")).withColumn("target", F.reverse("target")).withColumn("id", F.concat("id", F.lit("-not"))).drop("__n")

    return adapt


def window(text: Column, start: Column, length: Column, around: int) -> Column:
    """The text from `around` characters before a span (start from 0) to as many after it."""
    lo = F.greatest(start - around, F.lit(0))
    return F.substring(text, lo + 1, F.least(start + length + around, F.length(text)) - lo)


@dataclass(frozen=True)
class Source:
    """A catalogue entry: where rows come from and what they become."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    adapter: Adapter
    family: str = "unknown"
    lang: str = "en"
    license: str = ""
    license_use: str = ""
    cap: int | None = None
    group: str | None = None
    block: str = ""


@dataclass
class Catalogue:
    sources: dict[str, Source] = field(default_factory=dict)

    def register(self, source: Source) -> None:
        if source.name in self.sources:
            raise ValueError(f"source {source.name} is there already")
        self.sources[source.name] = source

    def select(self, names: list[str] | None = None, blocks: list[str] | None = None) -> list[Source]:
        unknown = set(names or ()) - set(self.sources)
        if unknown:
            raise ValueError(f"unknown sources {sorted(unknown)}")
        return [s for s in self.sources.values() if (names is None or s.name in names) and (blocks is None or s.block in blocks)]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        """A source's items with the catalogue's fields; ids get the source's name."""
        s = self.sources[name]
        x = s.adapter(s.read(spark)).withColumn("id", F.concat(F.lit(f"{name}-"), "id"))
        x = x.withColumn("source", F.lit(name)).withColumn("family", F.lit(s.family)).withColumn("lang", F.lit(s.lang)).withColumn("license", F.lit(s.license)).withColumn("license_use", F.lit(s.license_use)).withColumn("block", F.lit(s.block))
        x = x.where(F.length(F.regexp_replace("state", r"[^\p{L}\p{N}_]", "")) >= 3)
        if s.cap:
            from ..operators.sampling import cap_per_group

            x = cap_per_group(x, "source", s.cap)
        return x


# ---- generators: labels that follow from what was drawn

def drawn(spark: SparkSession, n: int, seed: int, **ranges: tuple[int, int]) -> DataFrame:
    """n rows with an integer in [lo, hi] for each name, from a hash of (seed, name, row): the same on any cluster."""
    x = spark.range(n)
    for name, (lo, hi) in ranges.items():
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
        x = x.withColumn(name, F.lit(lo) + h % (hi - lo + 1))
    return x


def return_window(rows: DataFrame, bought: str, returned: str, days: str) -> DataFrame:
    """yes iff returned within `days` days of bought (dates)."""
    took = F.datediff(F.col(returned), F.col(bought))
    state = F.concat(F.lit("Bought on "), F.date_format(bought, "yyyy-MM-dd"), F.lit(". Returned on "), F.date_format(returned, "yyyy-MM-dd"), F.lit(". Returns are taken within "), F.col(days).cast("string"), F.lit(" days."))
    return yes_no("id", state, took <= F.col(days), "Is the return in time?")(rows)


def within_budget(rows: DataFrame, cents: Column, discount: Column, budget: Column) -> DataFrame:
    """yes iff the items' cents (an array), less a discount in percent, are within the budget; integer arithmetic only."""
    total = F.aggregate(cents, F.lit(0).cast("long"), lambda s, c: s + c)
    net = total - F.floor(total * discount / 100)
    state = F.concat(F.lit("Items: "), F.array_join(F.transform(cents, lambda c: F.format_number(c / 100, 2)), ", "), F.lit(". Discount: "), discount.cast("string"), F.lit(" %. Budget: "), F.format_number(budget / 100, 2))
    return yes_no("id", state, net <= budget, "Is the total within the budget?")(rows)


def table_argmax(rows: DataFrame, names: Column, values: Column, largest: Column) -> DataFrame:
    """The name with the largest (or smallest) of distinct values; rows with a tie are left out."""
    best = F.when(largest, F.array_max(values)).otherwise(F.array_min(values))
    x = rows.where(F.size(F.array_distinct(values)) == F.size(values))
    lines = F.array_join(F.zip_with(names, values, lambda n, v: F.concat(n, F.lit(": "), v.cast("string"))), "\n")
    ask = F.when(largest, "Which is largest?").otherwise("Which is smallest?")
    return _items(x, F.col("id"), lines, "choice", ask, names, F.transform(values, lambda v: F.when(v == best, 1.0).otherwise(0.0)))


def urn(rows: DataFrame, a: Column, b: Column, draws: int) -> DataFrame:
    """P(all of `draws` draws without replacement are of the first kind), exactly, as the target of yes."""
    p = F.lit(1.0)
    for i in range(draws):
        p = p * F.greatest(a - i, F.lit(0)) / (a + b - i)
    state = F.concat(F.lit("An urn holds "), a.cast("string"), F.lit(" red and "), b.cast("string"), F.lit(f" blue balls. {draws} are drawn."))
    return yes_no("id", state, p, "Are all of them red?")(rows)


def first_of_key(items: DataFrame) -> DataFrame:
    """One row of each (state, instructions) key, the smallest id."""
    key = F.md5(F.concat_ws("\u001f", norm_key("state"), norm_key("instructions")))
    return items.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("id"))).where("__r = 1").drop("__r")
