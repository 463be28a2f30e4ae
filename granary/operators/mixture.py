"""Weights of sources: block and group shares, language targets, caps.  Source tables are small; rows are never moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def _block() -> WindowSpec:
    return W.partitionBy("block")


def block_weights(sources: DataFrame, *, power: float = 0.5) -> DataFrame:
    """sources (source, block, share, n): weight = share of the present blocks * n^power over its block's sum."""
    first = F.row_number().over(W.partitionBy("block").orderBy("source")) == 1
    s = sources.withColumn("s", F.pow(F.col("n").cast("double"), power)).withColumn("first", first)
    total = F.sum(F.when(F.col("first"), F.col("share"))).over(W.partitionBy())
    return s.withColumn("weight", F.col("share") / total * F.col("s") / F.sum("s").over(_block())).drop("s", "first")


def lang_target(weighted: DataFrame, *, target: float, partly: str = "fr_share") -> DataFrame:
    """Rescales sources that are wholly of the language so that its share of each block's mass is target; the rest make room."""
    only = F.col(partly) >= 1.0
    s = (
        weighted.withColumn("mass", F.sum("weight").over(_block()))
        .withColumn("only_mass", F.sum(F.when(only, F.col("weight")).otherwise(0.0)).over(_block()))
        .withColumn("fixed", F.sum(F.when(only, 0.0).otherwise(F.col("weight") * F.col(partly))).over(_block()))
        .withColumn("want", F.greatest(target * F.col("mass") - F.col("fixed"), F.lit(0.0)))
    )
    ok = (F.col("want") > 0) & (F.col("want") < F.col("mass")) & (F.col("only_mass") > 0) & (F.col("only_mass") < F.col("mass"))
    scaled = F.when(only, F.col("weight") * F.col("want") / F.col("only_mass")).otherwise(F.col("weight") * (F.col("mass") - F.col("want")) / (F.col("mass") - F.col("only_mass")))
    return s.withColumn("weight", F.when(ok, scaled).otherwise(F.col("weight"))).drop("mass", "only_mass", "fixed", "want")


def capped(weighted: DataFrame, cap: float) -> DataFrame:
    """Weights at most cap, what is cut off shared by the others of the block in proportion; one pass."""
    over = F.col("weight") > cap
    s = weighted.withColumn("cut", F.sum(F.when(over, F.col("weight") - cap).otherwise(0.0)).over(_block())).withColumn("room", F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).over(_block()))
    return s.withColumn("weight", F.when(over, cap).when(F.col("room") > 0, F.col("weight") * (1 + F.col("cut") / F.col("room"))).otherwise(F.col("weight"))).drop("cut", "room")


def cap_epochs(weights: dict[str, float], rows: dict[str, int], draws: int, *, most: float, blocks: dict[str, str], rounds: int = 12) -> dict[str, float]:
    """Weights under which no source is drawn more than `most` times its rows: capped sources are fixed, the others of their block (then all) take the rest."""
    w = dict(weights)
    fixed: set[str] = set()
    for _ in range(rounds):
        over = {s for s in w if s not in fixed and w[s] * draws > most * rows[s] * (1 + 1e-9)}
        if not over:
            break
        for s in over:
            w[s] = most * rows[s] / draws
        fixed |= over
        for block in set(blocks.values()):
            members = [s for s in w if blocks[s] == block]
            mass = sum(weights[s] for s in members)
            free = [s for s in members if s not in fixed]
            rest = mass - sum(w[s] for s in members if s in fixed)
            base = sum(weights[s] for s in free)
            for s in free:
                w[s] = weights[s] * max(rest, 0.0) / base
        short = 1.0 - sum(w.values())
        free = [s for s in w if s not in fixed]
        if free and abs(short) > 1e-12:
            base = sum(w[s] for s in free)
            for s in free:
                w[s] += short * w[s] / base
    return w
