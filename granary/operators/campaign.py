"""Runs and jobs: dependency queues, checkpoint retention, combined effects, gated composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written


def ready(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """Jobs (job, status) not begun all of whose needs (job, after) are done."""
    open_ = needs.join(jobs.select(F.col("job").alias("after"), "status"), "after", "left").where("status is null or status <> 'done'").select("job").distinct()
    return jobs.where("status = 'new'").join(open_, "job", "left_anti")


def closure(needs: DataFrame) -> DataFrame:
    """(job, after) with all indirect needs; level by level, each a written table, until nothing is new, which a cycle also comes to."""
    out = frontier = written(needs.select("job", "after").distinct(), "needs")
    while True:
        step = frontier.join(needs.select(F.col("job").alias("after"), F.col("after").alias("next")), "after").select("job", F.col("next").alias("after"))
        frontier = written(step.distinct().join(out, ["job", "after"], "left_anti"), "needs")
        if frontier.isEmpty():
            return out
        out = out.union(frontier)


def retained(checkpoints: DataFrame, keep: int, protect: Column) -> DataFrame:
    """The latest `keep` checkpoints (run, step) of each run, and the protected ones."""
    r = F.row_number().over(W.partitionBy("run").orderBy(F.desc("step")))
    return checkpoints.withColumn("r", r).where((F.col("r") <= keep) | protect).drop("r")


def combined(effects: DataFrame, *groups: str) -> DataFrame:
    """groups, effect, se of (effect, se): the mean, and the root of the summed squares by n."""
    return effects.groupBy(*groups).agg(F.avg("effect").alias("effect"), (F.sqrt(F.sum(F.pow("se", F.lit(2.0)))) / F.count("*")).alias("se"))


def adopted(effect: Column, se: Column, floor: float = 0.007) -> Column:
    """An arm is taken over where its effect is below minus the larger of the floor and two standard errors."""
    return effect < -F.greatest(F.lit(floor), 2 * se)


def gated_harmonic(axes: list[Column], weights: list[float], gates: list[float]) -> Column:
    """sum(w) / sum(w / v) times (v / gate)^2 for each axis under its gate; null if an axis is, 0 if one is 0 or less."""
    missing, dead = F.lit(False), F.lit(False)
    parts, penalty = F.lit(0.0), F.lit(1.0)
    for v, w, g in zip(axes, weights, gates, strict=True):
        missing, dead = missing | v.isNull(), dead | (v <= 0)
        parts = parts + w / v
        penalty = penalty * F.when(v < g, F.pow(v / g, F.lit(2.0))).otherwise(1.0)
    return F.when(missing, F.lit(None).cast("double")).when(dead, 0.0).otherwise(sum(weights) / parts * penalty)
