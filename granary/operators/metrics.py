"""Decision metrics: grouped reports, calibration errors, typed scores, bootstrap, temperature fits.

Frames have id, type, p (probabilities), target, and where named conf (the largest
probability) and hit (1.0 or 0.0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import probs as P


def per_item(df: DataFrame) -> DataFrame:
    """Adds nll, kl, brier, correct (expected correctness of the most likely option) and conf."""
    t, p = F.col("target"), F.col("p")
    return df.withColumn("nll", P.nll(t, p)).withColumn("kl", F.col("nll") - P.entropy(t)).withColumn("brier", P.brier(t, p)).withColumn("correct", P.expected_correct(t, p)).withColumn("conf", F.array_max(p))


def bin_right_closed(conf: Column, bins: int) -> Column:
    """Bin of (lo, hi], from 0."""
    return F.least(F.greatest(F.ceil(F.round(conf * bins, 12)) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")


def bin_left_closed(conf: Column, bins: int) -> Column:
    """Bin of [lo, hi), the last closed."""
    return F.least(F.floor(F.round(conf * bins, 12)), F.lit(bins - 1)).cast("int")


def ece(df: DataFrame, groups: Sequence[str], bin_: Column, conf: str = "conf", hit: str = "hit") -> DataFrame:
    """groups and ece: the mean over bins, by their rows, of |mean conf - mean hit|."""
    b = df.groupBy(*groups, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(hit).alias("h"))
    return b.groupBy(*groups).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))


def grouped_report(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """grp, value, n, accuracy, nll, kl, brier, conf over all rows and each value of each grouping column.

    The columns are unpivoted beside an 'all' row, which is one aggregation with partial sums.
    """
    rows = per_item(df)
    sets = F.array(F.struct(F.lit("all").alias("grp"), F.lit("all").alias("value")), *[F.struct(F.lit(g).alias("grp"), F.col(g).cast("string").alias("value")) for g in groups])
    flat = rows.select(F.explode(sets).alias("g"), "correct", "nll", "kl", "brier", "conf").select("g.*", "correct", "nll", "kl", "brier", "conf")
    return flat.groupBy("grp", "value").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("nll").alias("nll"), F.avg("kl").alias("kl"), F.avg("brier").alias("brier"), F.avg("conf").alias("conf"))


def typed_scores(df: DataFrame, *, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Adds score and chance: choice by argmax; noul by a band with abstention; score by normalised distance (smaller is better, chance its mean)."""
    p, gold, k = F.col("p"), F.col("gold"), F.col("k")
    yes = F.get(p, F.lit(1))
    noul = F.when((yes >= high) & (gold == 1), 1.0).when((yes <= low) & (gold == 0), 1.0).otherwise(0.0)
    level = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda s, i: s + i * F.get(p, i))
    away = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda s, i: s + F.abs(i - gold)) / (k * (k - 1))
    kind = F.col("type")
    return df.withColumn("score", F.when(kind == "choice", F.col("hit")).when(kind == "noul", noul).otherwise(F.abs(level - gold) / (k - 1))).withColumn("chance", F.when(kind == "choice", 1.0 / k).when(kind == "noul", 0.5).otherwise(away))


def chance_corrected(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, n, cc: 100 (acc - c) / (1 - c), for score 100 (1 - mean distance / mean chance)."""
    g = df.groupBy("type", *groups).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("chance").alias("c"))
    return g.withColumn("cc", F.when(F.col("type") == "score", 100 * (1 - F.col("s") / F.col("c"))).otherwise(100 * (F.col("s") - F.col("c")) / (1 - F.col("c")))).drop("s", "c")


TIER_WEIGHTS = {"easy": 0.1, "standard": 0.2, "judge": 0.3, "hard": 0.4}


def intelligence(df: DataFrame) -> DataFrame:
    """type, cc (tiers weighted over those present) for each type."""
    cells = chance_corrected(df, ["tier"])
    w = F.lit(1.0)
    for name, value in TIER_WEIGHTS.items():
        w = F.when(F.col("tier") == name, value).otherwise(w)
    return cells.withColumn("w", w).groupBy("type").agg((F.sum(F.col("w") * F.col("cc")) / F.sum("w")).alias("cc"), F.sum("n").alias("n"))


def ranked(df: DataFrame, groups: Sequence[str], *, conf: str = "conf", ident: str = "id", descending: bool = False, slices: int = 1024, ends: str = "hit") -> DataFrame:
    """Adds rank (from 0, by conf, ties by ident) and before (the sum of `ends` over the rows before), both within each group, and rows, the group's size.

    conf lies in 0 to 1 and is cut into slices; a slice is ranked by itself, and what comes
    before it is added from the slices' counts, so that no group meets in one task.
    """
    at = F.least(F.floor(F.col(conf) * slices), F.lit(slices - 1)).cast("int")
    rows = df.withColumn("__slice", -at if descending else at)
    counts = rows.groupBy(*groups, "__slice").agg(F.count("*").alias("n"), F.sum(ends).alias("s"))
    earlier = W.partitionBy(*groups).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)  # over at most `slices` rows of a group
    counts = counts.select(*groups, "__slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("__s"), F.sum("n").over(W.partitionBy(*groups)).alias("rows"))
    own = W.partitionBy(*groups, "__slice").orderBy(F.desc(conf) if descending else conf, ident)
    upto = own.rowsBetween(W.unboundedPreceding, -1)
    j = rows.join(counts, [*groups, "__slice"])
    return j.withColumn("rank", F.col("__n") + F.row_number().over(own) - 1).withColumn("before", F.col("__s") + F.coalesce(F.sum(ends).over(upto), F.lit(0.0))).drop("__slice", "__n", "__s")


def equal_mass(df: DataFrame, groups: Sequence[str], bins: int, conf: str = "conf", ident: str = "id") -> DataFrame:
    """Adds bin, from 1: `bins` bins of equal size by conf within each group (the first bins get what is over)."""
    r = ranked(df, groups, conf=conf, ident=ident)
    small, over = F.floor(F.col("rows") / bins), F.col("rows") % bins
    large = over * (small + 1)
    bin_ = F.when(F.col("rank") < large, F.floor(F.col("rank") / (small + 1))).otherwise(over + F.floor((F.col("rank") - large) / F.greatest(small, F.lit(1))))
    return r.withColumn("bin", (bin_ + 1).cast("int")).drop("rank", "before", "rows")


def brier_parts(binned: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Murphy's parts from bins: reliability, resolution, uncertainty."""
    b = binned.groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("hit").alias("h"), F.sum("hit").alias("hits"))
    base = b.groupBy(*groups).agg((F.sum("hits") / F.sum("n")).alias("rate"), F.sum("n").alias("all"))
    j = b.join(base, list(groups))
    return j.groupBy(*groups).agg(
        F.sum(F.col("n") / F.col("all") * F.pow(F.col("c") - F.col("h"), 2)).alias("reliability"),
        F.sum(F.col("n") / F.col("all") * F.pow(F.col("h") - F.col("rate"), 2)).alias("resolution"),
        F.first(F.col("rate") * (1 - F.col("rate"))).alias("uncertainty"),
    )


def aurc(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, aurc, e_aurc: the mean over k of the error rate of the k most confident, less that of a perfect order."""
    hits = df.groupBy(*groups).agg(F.sum("hit").alias("hits"))
    r = ranked(df, groups, descending=True).join(hits, list(groups))
    k = F.col("rank") + 1
    # a perfect order has its errors last
    r = r.withColumn("risk", (k - F.col("before") - F.col("hit")) / k).withColumn("ideal", F.greatest(k - F.col("hits"), F.lit(0.0)) / k)
    return r.groupBy(*groups).agg(F.avg("risk").alias("aurc"), (F.avg("risk") - F.avg("ideal")).alias("e_aurc"))


def smooth_ece(df: DataFrame, *, bandwidth: float = 0.05, grid: int = 1001) -> DataFrame:
    """smece: residuals smoothed by a Gaussian kernel reflected at 0 and 1, over a grid; exact conf values are pre-summed."""
    pre = df.groupBy(F.round("conf", 6).alias("f")).agg(F.sum(F.col("hit") - F.col("conf")).alias("r"), F.count("*").alias("n"))
    g = pre.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: i / F.lit(float(grid - 1)))).alias("t"))
    kernel = lambda c: F.exp(-0.5 * F.pow((F.col("t") - c) / bandwidth, 2))
    k = kernel(F.col("f")) + kernel(-F.col("f")) + kernel(2 - F.col("f"))
    s = g.groupBy("t").agg(F.sum(k * F.col("r")).alias("a"), F.sum(k * F.col("n")).alias("b"))
    return s.agg((F.sum(F.abs("a")) / F.sum("b")).alias("smece"))


def poisson_weight(ident: Column, draw: Column) -> Column:
    """A Poisson(1) count from a hash of id and draw: resampling weights that any engine and any partition gets alike."""
    u = F.conv(F.substring(F.md5(F.concat(ident.cast("string"), F.lit("|"), draw.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    out, cumulative, step = F.lit(7), 0.0, 0.36787944117144233
    cuts = []
    for k in range(7):
        cumulative += step
        cuts.append(cumulative)
        step /= k + 1
    for k in reversed(range(7)):
        out = F.when(u < cuts[k], k).otherwise(out)
    return out


POISSON_CUTS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]


def bootstrap_mean(df: DataFrame, value: str, *, draws: int = 200) -> DataFrame:
    """draw, mean of each resample; weighted sums, so each task sends a row for each draw."""
    w = poisson_weight(F.col("id"), F.col("draw"))
    x = df.select("id", F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", w)
    return x.groupBy("draw").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))


def interval(samples: DataFrame, *groups: str, value: str = "mean") -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    g = samples.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), q.alias("q"))
    return g.select(*groups, "mean", "se", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def temperature_grid(df: DataFrame, groups: Sequence[str], *, steps: int = 24, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """groups, t, nll: the mean NLL at temperatures spaced evenly in the log."""
    ratio = (high / low) ** (1.0 / steps)
    ts = F.array(*[F.lit(low * ratio**i) for i in range(steps + 1)])
    g = df.select(*groups, "logits", "gold", F.explode(ts).alias("t"))
    lse = F.transform(F.array(F.transform("logits", lambda x: x / F.col("t"))), lambda z: F.array_max(z) + F.log(P.total(F.transform(z, lambda x: F.exp(x - F.array_max(z))))))[0]
    return g.groupBy(*groups, "t").agg(F.avg(lse - F.get("logits", F.col("gold").cast("int")) / F.col("t")).alias("nll"))


def best_temperature(grid: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, t, nll at the least NLL (ties to the smaller t)."""
    return grid.groupBy(*groups).agg(F.min(F.struct(F.round("nll", 9).alias("nll"), "t")).alias("b")).select(*groups, F.col("b.t").alias("t"), F.col("b.nll").alias("nll"))


def fit_temperature(df: DataFrame, *, low: float = 0.05, high: float = 20.0, rounds: int = 4, steps: int = 12) -> float:
    """The temperature of the least mean NLL, by zooming grids; each probe is an aggregate.  1.0 where nothing is better."""
    lo, hi = low, high
    base = temperature_grid(df, [], steps=1, low=1.0, high=1.0000001).orderBy("t").first()
    if base is None:
        return 1.0
    best = (base.nll, 1.0)
    for _ in range(rounds):
        r = best_temperature(temperature_grid(df, [], steps=steps, low=lo, high=hi), []).first()
        ratio = (hi / lo) ** (1.0 / steps)
        lo, hi = max(low, r.t / ratio), min(high, r.t * ratio)
        if r.nll < best[0]:
            best = (r.nll, r.t)
    return best[1]


def isotonic(points: DataFrame, groups: Sequence[str], *, bins: int = 200) -> DataFrame:
    """Pool-adjacent-violators of hit on conf, by group; points are pre-summed to `bins` bins, so a group's list is bounded."""
    import pandas as pd

    b = points.groupBy(*groups, F.floor(F.col("conf") * bins).alias("bin")).agg(F.avg("conf").alias("x"), F.avg("hit").alias("y"), F.count("*").cast("double").alias("w"))

    def pav(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        blocks: list[list[float]] = []
        for y, w in zip(pdf.y, pdf.w, strict=True):
            blocks.append([y, w, 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                y2, w2, n2 = blocks.pop()
                y1, w1, n1 = blocks.pop()
                blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
        fit = [y for y, _, n in blocks for _ in range(int(n))]
        return pdf.assign(fit=fit)[[*groups, "x", "fit"]]

    kinds = ", ".join(f"{g} {points.schema[g].dataType.simpleString()}" for g in groups)
    return b.groupBy(*groups).applyInPandas(pav, f"{kinds}, x double, fit double")
