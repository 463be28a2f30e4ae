"""Calibrators with several parameters, fitted by a quasi-Newton method whose loss and gradient are one aggregate.

Many fits share a pass: each problem (a type, a left-out source) has its own point, tasks
evaluate all problems over their batches, and only sums (a row for each task and problem,
with a number for each parameter) leave them.  What the driver holds is a few vectors for
each problem.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

Loss = Callable[[np.ndarray, pd.DataFrame], tuple[float, np.ndarray]]  # parameters and rows to a sum and its gradient
Member = Callable[[str, pd.DataFrame], np.ndarray]  # which rows a problem is fitted on


def evaluated(rows: DataFrame, points: dict[str, np.ndarray], loss: Loss, member: Member) -> dict[str, tuple[float, np.ndarray, int]]:
    """Each problem's loss, gradient and number of rows at its point, in one pass."""
    size = max(map(len, points.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {name: (0.0, np.zeros(size), 0) for name in points}
        for pdf in batches:
            for name, x in points.items():
                mine = pdf[member(name, pdf)]
                if len(mine):
                    f, g = loss(x, mine)
                    a, b, n = total[name]
                    total[name] = (a + f, b + g, n + len(mine))
        yield pd.DataFrame([(name, f, g.tolist(), n) for name, (f, g, n) in total.items()], columns=["problem", "loss", "grad", "n"])

    parts = rows.mapInPandas(run, "problem string, loss double, grad array<double>, n long")
    got = parts.groupBy("problem").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"), F.array(*[F.sum(F.get("grad", F.lit(i))) for i in range(size)]).alias("grad")).collect()
    out = {r.problem: (r.loss, np.array(r.grad), r.n) for r in got}
    return {name: out.get(name, (0.0, np.zeros(size), 0)) for name in points}


@dataclass
class _Fit:
    x: np.ndarray
    f: float
    g: np.ndarray
    n: int
    moves: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # steps, and what they did to the gradient
    direction: np.ndarray | None = None
    step: float = 1.0

    def aim(self) -> None:
        """The two-loop product of the inverse Hessian's approximation and the gradient."""
        q, back = self.g.copy(), []
        for s, y in reversed(self.moves):
            a = s @ q / (s @ y)
            q -= a * y
            back.append(a)
        q *= (self.moves[-1][0] @ self.moves[-1][1]) / (self.moves[-1][1] @ self.moves[-1][1]) if self.moves else 1 / max(np.linalg.norm(self.g), 1.0)
        for (s, y), a in zip(self.moves, reversed(back), strict=True):
            q += s * (a - y @ q / (s @ y))
        self.direction, self.step = -q, 1.0


def minimized(rows: DataFrame, starts: dict[str, np.ndarray], loss: Loss, member: Member, *, rounds: int = 200, tolerance: float = 1e-7, memory: int = 8) -> dict[str, tuple[np.ndarray, float, int]]:
    """Each problem's parameters, mean loss and rows; problems without rows keep their start.  A gradient of a mean under tolerance ends one."""
    if not starts:
        return {}
    at = evaluated(rows, starts, loss, member)
    fits = {k: _Fit(starts[k], *at[k]) for k in starts}
    live = {k for k, v in fits.items() if v.n}
    for v in fits.values():
        v.aim()
    for _ in range(rounds):
        live = {k for k in live if np.abs(fits[k].g).max() > tolerance * fits[k].n and fits[k].step > 1e-12}
        if not live:
            break
        tried = evaluated(rows, {k: fits[k].x + fits[k].step * fits[k].direction for k in sorted(live)}, loss, member)
        for k, (f, g, _) in tried.items():
            v = fits[k]
            s = v.step * v.direction
            if np.isfinite(f) and f <= v.f + 1e-4 * (v.g @ s):
                if s @ (g - v.g) > 1e-14 * (s @ s):
                    v.moves = [*v.moves, (s, g - v.g)][-memory:]
                v.x, v.f, v.g = v.x + s, f, g
                v.aim()
                if v.direction @ v.g >= 0:  # no descent any more: begin anew
                    v.moves = []
                    v.aim()
            else:
                v.step /= 2
    return {k: (v.x, v.f / v.n if v.n else 0.0, v.n) for k, v in fits.items()}


# ---- calibrators

def _matrix(lists: pd.Series, fill: float) -> np.ndarray:
    width = max(map(len, lists))
    return np.array([[*x, *[fill] * (width - len(x))] for x in lists], float)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def vector_loss(x: np.ndarray, rows: pd.DataFrame) -> tuple[float, np.ndarray]:
    """NLL of target under softmax(logits / T + bias of each place); x: log T, and the biases of places from the second on, the last shared by all beyond."""
    z, y = _matrix(rows["logits"], -np.inf), _matrix(rows["target"], 0.0)
    place = np.minimum(np.arange(z.shape[1]), len(x) - 1)
    scaled = z / np.exp(x[0])
    p = _softmax(scaled + np.r_[0.0, x[1:]][place])
    off = p * y.sum(1, keepdims=True) - y
    real = np.isfinite(z)
    grad = np.zeros(len(x))
    grad[0] = -(off * np.where(real, scaled, 0.0)).sum()
    np.add.at(grad, place[1:], off.sum(0)[1:])
    return float(-(y[real] * np.log(np.maximum(p[real], 1e-300))).sum()), grad


def beta_loss(x: np.ndarray, rows: pd.DataFrame) -> tuple[float, np.ndarray]:
    """NLL of y (a share of yes) under logit q = a ln p - b ln(1 - p) + c, of p; x: a, b, c."""
    p, y = np.clip(rows["p"].to_numpy(float), 1e-6, 1 - 1e-6), rows["y"].to_numpy(float)
    v = np.stack([np.log(p), -np.log1p(-p), np.ones(len(p))])
    z = x @ v
    return float((np.logaddexp(0, z) - y * z).sum()), v @ (1 / (1 + np.exp(-z)) - y)


def by_group(column: str) -> Member:
    """A problem is fitted on its own group."""
    return lambda name, pdf: (pdf[column] == name).to_numpy()


def without_group(column: str) -> Member:
    """A problem, named after a group, is fitted on all rows but that group's."""
    return lambda name, pdf: (pdf[column] != name).to_numpy()


def _names(rows: DataFrame, column: str) -> list[str]:
    return [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]  # a row for each group


def vector_scaling(rows: DataFrame, group: str, *, places: int = 8, left_out: bool = False) -> DataFrame:
    """group, t, bias, nll, n: vector scaling of each group, or (left_out) of all others.  rows: group, logits, target (arrays)."""
    rows = written(rows.select(group, "logits", "target").where(F.size("logits") > 0), "fitted")
    fits = minimized(rows, {k: np.zeros(places) for k in _names(rows, group)}, vector_loss, (without_group if left_out else by_group)(group))
    return rows.sparkSession.createDataFrame([(k, float(np.exp(x[0])), x[1:].tolist(), f, n) for k, (x, f, n) in fits.items()], f"{group} string, t double, bias array<double>, nll double, n long")


def scaled(logits: Column, t: Column, bias: Column) -> Column:
    """Vector-scaled logits."""
    last = F.size(bias)
    return F.transform(logits, lambda z, i: z / t + F.when(i == 0, 0.0).otherwise(F.get(bias, F.least(i, last) - 1)))


def beta_scaling(rows: DataFrame, group: str, *, left_out: bool = False) -> DataFrame:
    """group, a, b, c, nll, n of beta calibration.  rows: group, p, y."""
    rows = written(rows.select(group, "p", "y").dropna(), "fitted")
    fits = minimized(rows, {k: np.array([1.0, 1.0, 0.0]) for k in _names(rows, group)}, beta_loss, (without_group if left_out else by_group)(group))
    return rows.sparkSession.createDataFrame([(k, *map(float, x), f, n) for k, (x, f, n) in fits.items()], f"{group} string, a double, b double, c double, nll double, n long")


def batch_calibrated(rows: DataFrame, *, least: int = 20, kinds: tuple[str, ...] = ("choice", "noul")) -> DataFrame:
    """rows (type, logits) with debiased logits: less the log of the mean probability that their place gets among rows of the same type and number of options; groups under `least` rows, and other types, stay."""
    from ..functions import probs as P

    n = F.size("logits")
    p = rows.where(F.col("type").isin(*kinds)).select("type", n.alias("k"), F.posexplode(P.softmax(F.col("logits"))).alias("place", "p"))
    mean = p.groupBy("type", "k", "place").agg(F.avg("p").alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    table = mean.groupBy("type", "k").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("m"))  # a row for each type and number
    joined = rows.withColumn("k", n).join(table, ["type", "k"], "left")
    less = F.transform("logits", lambda z, i: z - F.log(F.greatest(F.get("m", i)["m"], F.lit(1e-12))))
    return joined.withColumn("logits", F.when(F.col("m").isNull(), F.col("logits")).otherwise(less)).select(*rows.columns)
