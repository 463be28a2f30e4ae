"""Restores what was thinned out of a file of lines, by aligning the thinned file with another build of the whole one.

thinned says of each of its lines which place it had in the original whole file (`at`).
full is a later build of that file: a few lines more or fewer, some moved.  Lines that are
unique in both are matched; of the matches a longest chain that is in order in both
files is kept (moved lines fall out), and pins the alignment.  Between two neighbours of
the chain the original and the later build have as many lines, or not.  If so, and all
thinned lines there stand where the later build has them, the lines between are the
original's and those that were thinned out are restored.  If not, an extra or a missing
line is among them: nothing there can be told, and nothing is restored.

Running values over a file's order are taken in parts: files are dealt by ranges of
places, a part's total goes into a table of a row for each part, and windows stay within
parts.  The chain is found in stretches: matches between two places that no match
crosses are chained on their own, so a task gets as many matches as lines were moved
across each other.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written


def in_parts(df: DataFrame, order: str) -> DataFrame:
    """df with `part`, numbered along order: ranges of it, each in one file of a written table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "parts")


def running(df: DataFrame, order: str, name: str, value: Column, kind: str, *, back: bool = False) -> DataFrame:
    """df (of in_parts) with name: the last, max, min or sum of value up to each row, itself included, or from it on (back)."""
    total = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order))) if not back else F.min_by(c, F.when(c.isNotNull(), F.col(order))), "max": F.max, "min": F.min, "sum": F.sum}[kind]
    over = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "min": F.min, "sum": F.sum}[kind]
    rows = df.withColumn("__v", value)
    along = W.orderBy(F.desc("part") if back else F.asc("part")).rowsBetween(W.unboundedPreceding, -1)  # over a row for each part
    before = rows.groupBy("part").agg(total(F.col("__v")).alias("__t")).withColumn("__before", over(F.col("__t")).over(along)).select("part", "__before")
    within = W.partitionBy("part").orderBy(F.desc(order) if back else F.asc(order)).rowsBetween(W.unboundedPreceding, 0)
    own, before_ = over(F.col("__v")).over(within), F.col("__before")
    both = {"last": F.coalesce(own, before_), "max": F.greatest(own, before_), "min": F.least(own, before_), "sum": F.coalesce(own, F.lit(0)) + F.coalesce(before_, F.lit(0))}[kind]
    return rows.join(F.broadcast(before), "part", "left").withColumn(name, both).drop("__v", "__before")


def longest_chain(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        before[i] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(v)
            last.append(i)
        else:
            ends[k], last[k] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def chained(pairs: DataFrame) -> DataFrame:
    """Of pairs (at, i), both unique, a longest chain that rises in both."""
    x = in_parts(pairs.select("at", "i"), "at")
    x = running(x, "at", "upto", F.col("i"), "max")
    x = running(x, "at", "least", F.col("i"), "min", back=True)
    # the smallest i from here on is larger than all before: nothing crosses here
    x = written(x.withColumn("opens", (F.col("least") == F.col("i")) & (F.col("upto") == F.col("i"))), "crossings")
    x = running(x, "at", "stretch", F.col("opens").cast("long"), "sum")  # an uncrossed match is a stretch's first
    sizes = x.groupBy("stretch").agg(F.count("*").alias("n"))
    x = written(x.join(sizes, "stretch"), "stretches")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pdf.iloc[longest_chain(pdf["i"].tolist())][["at", "i"]]

    alone = x.where("n = 1").select("at", "i")
    return alone.union(x.where("n > 1").select("stretch", "at", "i").groupBy("stretch").applyInPandas(chain, "at long, i long"))


def realigned(full: DataFrame, thinned: DataFrame, *, key: Column | None = None) -> DataFrame:
    """at, line, restored: thinned's lines as they are, and those of full that are restored.

    full: i (place), line.  thinned: at (place in the original file, unique), line.  key: what
    has to be equal of a line (the line itself).  Lines before the first match and after
    the last are told by the files' beginnings alone, and their ends not at all.
    """
    k = F.xxhash64(key if key is not None else F.col("line"))
    a, b = written(full.select(F.col("i").cast("long").alias("i"), "line", k.alias("k")), "full"), written(thinned.select(F.col("at").cast("long").alias("at"), "line", k.alias("k")), "thinned")
    once = lambda df, place: df.groupBy("k").agg(F.count("*").alias("n"), F.min(place).alias(place)).where("n = 1").drop("n")
    chain = written(chained(once(a, "i").join(once(b, "at"), "k")), "chain")
    ends = chain.sparkSession.createDataFrame([(-1, -1)], "at long, i long")  # both files begin at 0
    chain = in_parts(chain.union(ends), "i")
    nexts = running(chain, "i", "after_i", F.lit(None).cast("long"), "last")  # the part's order is that of i, and of at as well
    step = W.partitionBy("part").orderBy("i")
    first = chain.groupBy("part").agg(F.min_by(F.struct("i", "at"), "i").alias("f")).withColumn("next_part", F.lag("part").over(W.orderBy("part"))).where("next_part is not null").select(F.col("next_part").alias("part"), "f")
    gaps = nexts.withColumn("n", F.lead(F.struct("i", "at")).over(step)).join(F.broadcast(first), "part", "left").withColumn("n", F.coalesce("n", "f"))
    gaps = written(gaps.where("n is not null").select(F.col("i").alias("i0"), F.col("at").alias("at0"), (F.col("n.i") - F.col("i")).alias("size"), (F.col("n.i") - F.col("i") == F.col("n.at") - F.col("at")).alias("even")), "gaps")
    # lines of full find the gap that they stand in
    placed = in_parts(a.join(gaps.select(F.col("i0").alias("i"), F.col("i0").alias("own")), "i", "left"), "i")
    placed = running(placed, "i", "i0", F.col("own"), "last").withColumn("i0", F.coalesce("i0", F.lit(-1)))
    moved = written(placed.join(gaps.where("even and size > 1"), "i0").where("i < i0 + size").select((F.col("at0") + F.col("i") - F.col("i0")).alias("at"), "line", "k", "i0"), "moved")
    # a thinned line that stands elsewhere in full spoils its gap
    wrong = moved.join(b.select("at", F.col("k").alias("kb")), "at").where("k <> kb").select("i0").distinct()
    restored = moved.join(wrong, "i0", "left_anti").join(b.select("at"), "at", "left_anti")
    return b.select("at", "line", F.lit(False).alias("restored")).union(restored.select("at", "line", F.lit(True)))
