"""Caps, stratified and balanced samples, quotas.  Rows are drawn in the order of a hash of (id, seed), so a draw is the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import SEP


def draw_order(ident: str = "id", seed: int = 0) -> Column:
    return F.md5(F.concat(F.col(ident).cast("string"), F.lit(f"{SEP}{seed}")))


def cap_per_group(df: DataFrame, group: str, k: int, *, ident: str = "id", seed: int = 0, salts: int = 16) -> DataFrame:
    """At most k rows of each group.  Ranked within salted parts first, so a hot group meets in one task with salts * k rows at most."""
    rows = df.withColumn("__o", draw_order(ident, seed)).withColumn("__s", F.pmod(F.xxhash64(ident), F.lit(salts)))
    part = rows.withColumn("__r", F.row_number().over(W.partitionBy(group, "__s").orderBy("__o", ident))).where(F.col("__r") <= k)
    return part.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy("__o", ident))).where(F.col("__r") <= k).drop("__o", "__s", "__r")


def take_quota(df: DataFrame, quota: DataFrame, keys: list[str], *, ident: str = "id", seed: int = 0, salts: int = 16) -> DataFrame:
    """The first `take` rows (of quota: keys, take) of each stratum in draw order; ranked within salted parts first."""
    rows = df.join(quota, keys).withColumn("__o", draw_order(ident, seed)).withColumn("__s", F.pmod(F.xxhash64(ident), F.lit(salts)))
    part = rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__s").orderBy("__o", ident))).where(F.col("__r") <= F.col("take"))
    return part.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("__o", ident))).where(F.col("__r") <= F.col("take")).drop("__o", "__s", "__r", "take")


def largest_remainder(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, n, take: k shared out in proportion to n, what floors leave to the largest remainders."""
    one = W.partitionBy()  # a row for each stratum
    want = k * F.col("n") / F.sum("n").over(one)
    q = counts.withColumn("want", want).withColumn("base", F.floor("want").cast("long")).withColumn("rest", F.lit(k) - F.sum(F.floor(want)).over(one))
    r = q.withColumn("r", F.row_number().over(W.orderBy(F.desc(F.round(F.col("want") - F.col("base"), 9)), *keys)))
    return r.select(*keys, "n", (F.col("base") + (F.col("r") <= F.col("rest")).cast("long")).alias("take"))


def stratified(df: DataFrame, keys: list[str], k: int, *, ident: str = "id", seed: int = 0) -> DataFrame:
    """k rows, each stratum in proportion."""
    quota = largest_remainder(df.groupBy(*keys).agg(F.count("*").alias("n")), keys, k).drop("n")
    return take_quota(df, quota, keys, ident=ident, seed=seed)


def rebalance_quota(counts: DataFrame, *, hi: float = 0.7, max_loss: float = 0.6) -> DataFrame:
    """Of (source, yes, no): the rows to keep of each answer so that the larger has a share of hi, no more than max_loss of the source dropped."""
    p, n = F.col("yes") / (F.col("yes") + F.col("no")), F.col("yes") + F.col("no")
    minor, major = F.least("yes", "no"), F.greatest("yes", "no")
    keep = F.bround(minor * hi / (1 - hi)).cast("long")
    drop = F.when((p > hi) | (p < 1 - hi), F.greatest(F.least(major - keep, F.floor(n * max_loss)), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return counts.select("source", "yes", "no", (F.col("yes") - F.when(p > hi, drop).otherwise(0)).alias("keep_yes"), (F.col("no") - F.when(p < 1 - hi, drop).otherwise(0)).alias("keep_no"))


def sqrt_quotas_grid(counts: DataFrame, total: int, *, share: float = 0.15, steps: int = 4096, top: float = 64.0) -> DataFrame:
    """(key, n, quota): min(n, c * sqrt(n), share * total), c the least of a grid with which the quotas reach total."""
    grid = counts.sparkSession.range(1, steps + 1).select((F.col("id") * (top / steps)).alias("c"))
    each = F.least(F.col("n").cast("double"), F.col("c") * F.sqrt("n"), F.lit(share * total))
    # counts has a row for each source and the grid a fixed number: the product is bounded by the sources
    best = counts.select("n").withColumn("g", F.lit(1)).join(F.broadcast(grid.withColumn("g", F.lit(1))), "g").groupBy("c").agg(F.sum(each).alias("s")).where(F.col("s") >= total).agg(F.coalesce(F.min("c"), F.lit(top)).alias("c"))
    c = best.first().c
    return counts.withColumn("quota", F.floor(F.least(F.col("n").cast("double"), c * F.sqrt("n"), F.lit(share * total)) + 1e-9).cast("long"))


def epoch_quota(sources: DataFrame, *, least: float, below: float = 0.9) -> DataFrame:
    """Adds keep to (source, n, epochs): n * epochs / least rows where epochs are under below * least (one at least), else n."""
    k = F.greatest(F.bround(F.col("n") * F.col("epochs") / least).cast("long"), F.lit(1))
    return sources.withColumn("keep", F.when((F.col("epochs") < below * least) & (F.col("n") > 1), k).otherwise(F.col("n")))
