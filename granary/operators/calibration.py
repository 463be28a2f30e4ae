"""Calibrators on a prediction dump: histogram bins, Platt scaling, cells shrunk to their type, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import fingerprint
from . import metrics as M


def histogram_bins(df: DataFrame, groups: Sequence[str], *, bins: int = 10, prior: float = 1.0) -> DataFrame:
    """groups, bin, n, value: each bin's smoothed rate of hits, pulled to the group's rate by `prior` rows."""
    b = df.groupBy(*groups, M.bin_left_closed(F.col("conf"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    rate = b.groupBy(*groups).agg((F.sum("hits") / F.sum("n")).alias("rate"))
    return b.join(rate, list(groups)).select(*groups, "bin", "n", ((F.col("hits") + prior * F.col("rate")) / (F.col("n") + prior)).alias("value"))


def platt(df: DataFrame, score: str, y: str, *, rounds: int = 25, ridge: float = 1e-3) -> tuple[float, float]:
    """a, b of sigmoid(a * score + b) by Newton steps; each step is one aggregate of six sums."""
    a, b = 1.0, 0.0
    s, t = F.col(score), F.col(y).cast("double")
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-(F.lit(a) * s + F.lit(b))))
        w = p * (1 - p)
        r = df.agg(F.avg((p - t) * s).alias("ga"), F.avg(p - t).alias("gb"), F.avg(w * s * s).alias("haa"), F.avg(w * s).alias("hab"), F.avg(w).alias("hbb")).first()
        if r.ga is None:
            return 1.0, 0.0
        ga, gb, haa, hbb = r.ga + ridge * (a - 1), r.gb + ridge * b, r.haa + ridge, r.hbb + ridge
        det = haa * hbb - r.hab**2
        da, db = (hbb * ga - r.hab * gb) / det, (haa * gb - r.hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def shrunk_cells(grid: DataFrame, types: DataFrame, *, tau: float, least: int = 50) -> DataFrame:
    """type, lang, t of (type, lang, t, nll, n): the least n * nll + tau * (ln t - ln t of the type)^2; cells under `least` rows take the type's."""
    j = grid.join(types.select("type", F.col("t").alias("t0")), "type")
    cost = F.col("n") * F.col("nll") + tau * F.pow(F.log(F.col("t")) - F.log(F.col("t0")), 2.0)
    best = j.groupBy("type", "lang").agg(F.min(F.struct(F.round(cost, 9).alias("cost"), "t")).alias("b"), F.max("n").alias("n"), F.first("t0").alias("t0"))
    return best.select("type", "lang", "n", F.when(F.col("n") >= least, F.col("b.t")).otherwise(F.col("t0")).alias("t"))


def cell_grid(df: DataFrame, *, steps: int = 24, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """type, lang, t, nll, n over a grid of temperatures."""
    n = df.groupBy("type", "lang").agg(F.count("*").alias("n"))
    return M.temperature_grid(df, ["type", "lang"], steps=steps, low=low, high=high).join(n, ["type", "lang"])


def cross_validated(df: DataFrame, fold: Column, folds: int, *, steps: int = 24) -> DataFrame:
    """fold, t, nll: each fold's NLL at the temperature that is best on the others; sums over the grid, so no refit."""
    g = M.temperature_grid(df.withColumn("fold", fold), ["fold"], steps=steps)
    n = df.groupBy(fold.alias("fold")).agg(F.count("*").alias("n"))
    s = g.join(n, "fold").withColumn("sum", F.col("nll") * F.col("n"))
    total = s.groupBy("t").agg(F.sum("sum").alias("all"), F.sum("n").alias("m"))
    rest = s.join(total, "t").withColumn("rest", (F.col("all") - F.col("sum")) / (F.col("m") - F.col("n")))
    return rest.groupBy("fold").agg(F.min(F.struct(F.round("rest", 9).alias("r"), "t", "nll")).alias("b")).select("fold", F.col("b.t").alias("t"), F.col("b.nll").alias("nll"))


def mixed_target(target: Column, teacher: Column, mix: float) -> Column:
    """(1 - mix) * target + mix * teacher; the target alone without a teacher."""
    return F.when(teacher.isNull(), target).otherwise(F.zip_with(target, teacher, lambda t, q: (1 - mix) * t + mix * q))


def smoothed_target(target: Column, eps: float) -> Column:
    k = F.size(target)
    return F.transform(target, lambda t: (1 - eps) * t + eps / k)


LOG_T = (-3.0, 3.0)


def fit_features(df: DataFrame, features: str, *, ridge: float = 1.0, rounds: int = 12) -> dict:
    """log T = u + w . x with x the standardized features (an array): u, w, mean, std, start and nll (mean NLL without and with it).

    Gauss-Newton steps: each is one aggregate of a gradient and a matrix, whose size is
    that of the features, and a step that doesn't lower the loss is halved.
    """
    import numpy as np

    d = df.select(F.size(features)).first()
    if d is None:
        return {"u": 0.0, "w": [], "mean": [], "std": [], "start": 0.0, "nll": 0.0}
    d = d[0]
    x = [F.get(features, F.lit(i)) for i in range(d)]
    m = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    mean, std = [m[f"m{i}"] for i in range(d)], [m[f"s{i}"] if m[f"s{i}"] > 1e-9 else 1.0 for i in range(d)]
    xs = [F.lit(1.0), *[(c - mean[i]) / std[i] for i, c in enumerate(x)]]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        log_t = F.lit(0.0)
        for c, v in zip(theta, xs, strict=True):
            log_t = log_t + F.lit(float(c)) * v
        z = F.transform("logits", lambda v: v / F.exp(F.least(F.greatest(F.col("__t"), F.lit(LOG_T[0])), F.lit(LOG_T[1]))))
        r = df.withColumn("__t", log_t).withColumn("__z", z).withColumn("__m", F.array_max("__z")).withColumn("__e", F.transform("__z", lambda v: F.exp(v - F.col("__m")))).withColumn("__s", total(F.col("__e")))
        r = r.withColumn("__mu", total(F.zip_with("__e", "__z", lambda e, v: e * v)) / F.col("__s")).withColumn("__v", total(F.zip_with("__e", "__z", lambda e, v: e * v * v)) / F.col("__s") - F.pow("__mu", 2.0))
        gold = F.get("__z", F.col("gold").cast("int"))
        slope = gold - F.col("__mu")
        g = r.agg(F.sum(F.col("__m") + F.log("__s") - gold).alias("loss"), F.count("*").alias("n"), *[F.sum(slope * a).alias(f"g{i}") for i, a in enumerate(xs)], *[F.sum(F.col("__v") * a * b).alias(f"h{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if j <= i]).first()
        h = np.array([[g[f"h{max(i, j)}_{min(i, j)}"] for j in range(d + 1)] for i in range(d + 1)])
        return g.loss, np.array([g[f"g{i}"] for i in range(d + 1)]), h, g.n

    pen = np.array([0.0] + [ridge] * d)
    theta = np.zeros(d + 1)
    loss, grad, h, n = sums(theta)
    start, step = loss, 1.0
    for _ in range(rounds):
        move = np.linalg.solve(h + np.diag(2 * pen + 1e-6), grad + 2 * pen * theta)
        new = theta - step * move
        l2, g2, h2, _ = sums(new)
        if l2 + (pen * new**2).sum() < loss + (pen * theta**2).sum():
            done = loss - l2 < 1e-9 * n
            theta, loss, grad, h, step = new, l2, g2, h2, 1.0
            if done:
                break
        else:
            step /= 2
    return {"u": float(theta[0]), "w": theta[1:].tolist(), "mean": mean, "std": std, "start": start / n, "nll": loss / n}


#: What a calibration is bound to besides its temperatures.
READOUT = ("checkpoint", "data", "template_version", "backend", "orders", "noul_order")


def artifact(temperatures: dict[str, float], **readout: object) -> dict:
    """A calibration as a record with an identity: the fingerprint of all else in it."""
    if missing := set(READOUT) - set(readout):
        raise ValueError(f"missing {sorted(missing)}")
    body = {"temperatures": temperatures, **{k: readout[k] for k in READOUT}}
    return body | {"identity": fingerprint(body)}


def validated(record: dict, **readout: object) -> dict[str, float]:
    """The record's temperatures; ValueError if it was changed, or made for something else."""
    if fingerprint({k: v for k, v in record.items() if k != "identity"}) != record.get("identity"):
        raise ValueError("the calibration was changed")
    for name, want in readout.items():
        if record.get(name) != want:
            raise ValueError(f"the calibration is for {name} {record.get(name)!r}, not {want!r}")
    return record["temperatures"]
