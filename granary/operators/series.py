"""Step-indexed series: full windows, paired differences, rolling medians, runs, curve fits, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def full_windows(df: DataFrame, run: str, step: str, value: str, size: int) -> DataFrame:
    """run, upto, mean: means over disjoint windows that end at multiples of size and have every step."""
    w = (F.ceil(F.col(step) / size) * size).cast("long")
    return df.groupBy(run, w.alias("upto")).agg(F.countDistinct(step).alias("n"), F.avg(value).alias("mean")).where(F.col("n") == size).drop("n")


def paired_delta(a: DataFrame, b: DataFrame, *, least: int = 3) -> DataFrame:
    """delta, se, n over windows (upto, mean) that both have."""
    d = a.join(b.select("upto", F.col("mean").alias("base")), "upto").select((F.col("mean") - F.col("base")).alias("d"))
    return d.agg(F.avg("d").alias("delta"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n")).where(F.col("n") >= least)


def median(a: Column) -> Column:
    """Median of an array without nulls, the mean of the middle two for an even number."""
    return F.transform(F.array(F.sort_array(a)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)[0]


def rolling_median(df: DataFrame, run: str, step: str, value: str, last: int = 20) -> DataFrame:
    """Adds median and mad over the last rows up to each; frames are bounded, the arrays too."""
    w = W.partitionBy(run).orderBy(step).rowsBetween(-(last - 1), 0)
    x = df.withColumn("__v", F.collect_list(value).over(w)).withColumn("median", median(F.col("__v")))
    return x.withColumn("mad", median(F.transform("__v", lambda v: F.abs(v - F.col("median"))))).drop("__v")


def longest_run(df: DataFrame, run: str, step: str, holds: Column) -> DataFrame:
    """run, longest: the longest stretch of consecutive rows that hold (gaps and islands)."""
    w = W.partitionBy(run).orderBy(step)
    x = df.withColumn("__h", holds.cast("int")).withColumn("__i", F.sum(F.when(F.col("__h") == 1, 0).otherwise(1)).over(w))
    return x.groupBy(run, "__i").agg(F.sum("__h").alias("n")).groupBy(run).agg(F.max("n").alias("longest"))


def parabola(points: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """groups, a, b, c, vertex of y = a + b x + c x^2 by least squares: sums, then the normal equations by Cramer's rule."""
    p = lambda k: F.sum(F.pow(F.col(x), F.lit(float(k))))
    s = points.groupBy(*groups).agg(F.count("*").alias("s0"), *[p(k).alias(f"s{k}") for k in (1, 2, 3, 4)], F.sum(y).alias("t0"), F.sum(F.col(x) * F.col(y)).alias("t1"), F.sum(F.pow(F.col(x), F.lit(2.0)) * F.col(y)).alias("t2"))

    def det(m: list[list[str]]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = [[F.col(v) for v in r] for r in m]
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    base = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]
    swap = lambda k: [[f"t{r}" if c == k else base[r][c] for c in range(3)] for r in range(3)]
    full = det(base)
    out = s.select(*groups, *[(det(swap(k)) / full).alias(n) for k, n in enumerate("abc")])
    return out.withColumn("vertex", -F.col("b") / (2 * F.col("c")))


def bucketed_range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """points (with at) joined to intervals with start <= at < end: intervals are laid on buckets of `width`, so the join is an equality on bucket (and keys)."""
    keys = keys or []
    b = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    return p.join(b, [*keys, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """left with the latest row of right (key, at) at or before its own at: one pass over both, sorted by key."""
    names = [c for c in right.columns if c not in (key, at)]
    r = right.select(key, at, F.struct(F.col(at).alias("at"), *names).alias("__r"), F.lit(0).alias("__side"), *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (key, at)])
    x = left.select(key, at, F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__side"), *[c for c in left.columns if c not in (key, at)])
    w = W.partitionBy(key).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    return r.unionByName(x).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1").select(*left.columns, F.col("__last.at").alias("found_at"), *[F.col(f"__last.{c}").alias(f"found_{c}") for c in names])
