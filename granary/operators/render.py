"""Prompts: option order, rotations, lettered texts, token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.keys import sha_int


def shown_order(labels: Column, ident: Column, kind: Column, seed: int = 0) -> Column:
    """Option numbers in the order shown: as they are for score, by a hash of (id, label, seed) else."""
    plain = F.sequence(F.lit(0), F.size(labels) - 1)
    keyed = F.transform(plain, lambda i: F.struct(F.md5(F.concat_ws("|", ident.cast("string"), F.get(labels, i), F.lit(str(seed)))).alias("h"), i.alias("i")))
    return F.when(kind == "score", plain).otherwise(F.transform(F.array_sort(keyed), lambda s: s["i"]))


def rotations(order: Column, k: int) -> Column:
    """k rotations of an order, evenly spread."""
    n = F.size(order)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: P.rotate(order, F.floor(j * n / k).cast("int")))


def prompt(state: Column, instructions: Column, labels: Column, order: Column) -> Column:
    """State, instructions and lettered options, a line each."""
    lines = F.transform(order, lambda i, at: F.concat(F.char(at + 65), F.lit(") "), F.get(labels, i)))
    return F.concat_ws("\n", state, instructions, F.array_join(lines, "\n"))


def numbered(names: DataFrame) -> DataFrame:
    """name and number (from 0) of the distinct names, in order of (the first two signs of its MD5, name): 256 parts are numbered apart."""
    p = names.select("name").distinct().withColumn("part", F.substring(F.md5("name"), 1, 2))
    before = p.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("lo"))  # 256 rows
    return p.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("name")) - 1).join(before, "part").select("name", (F.col("lo") + F.col("r")).alias("number"))


def distractors(items: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """items (id, name) with `others`: the first k names of the numbered pool, from a place that a hash of the id gives on, that aren't the item's own.

    An item meets k + 1 names whatever the pool's size.
    """
    p = numbered(pool)
    x = items.select("id", "name", p.agg(F.count("*")).scalar().alias("size"))
    start = x.select("id", "name", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.when(j < F.col("size"), (sha_int(F.col("id")) + j) % F.col("size")))).alias("j", "number"))
    met = start.join(p.withColumnRenamed("name", "other"), "number").where("other <> name")
    others = met.groupBy("id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("j", "other"))), 1, k), lambda s: s["other"]).alias("others"))
    return items.join(others, "id")
