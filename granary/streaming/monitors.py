"""Stateful monitors: loss spikes by rolling median and MAD, in batch and on a stream from one fold, and the verdict of a run, by window functions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series import median as median_of


@dataclass(frozen=True)
class SpikeRule:
    """A value is a spike if it isn't finite, or above median + k * max(1.4826 * MAD, 1e-6) of the last `history` values that were none."""

    k: float = 5.0
    history: int = 50
    least: int = 10

    def step(self, kept: list[float], value: float) -> bool:
        """Whether value is a spike; kept, the history, gets it if it is none."""
        spike = False
        if len(kept) >= self.least:
            m = median(kept)
            # at or under the median it is no spike, whatever the MAD
            spike = not math.isfinite(value) or value > m and value > m + self.k * max(1.4826 * median([abs(v - m) for v in kept]), 1e-6)
        if not spike and math.isfinite(value):
            kept.append(value)
            del kept[: -self.history]
        return spike


def spikes(df: DataFrame, key: str, step: str, value: str, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """key, step, value, spike in batch.  A key's rows lie one after another in a task, in order; a batch has rows of many keys, and only the last one's history goes on to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = (), []
        for batch in batches:
            found = []
            for k, v in zip(batch[key].to_pylist(), batch[value].to_pylist(), strict=True):
                if last != (k,):
                    last, kept = (k,), []
                found.append(rule.step(kept, math.nan if v is None else v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=[*batch.schema.names, "spike"])

    kinds = {c: t for c, t in df.dtypes}
    rows = df.select(key, step, F.col(value).cast("double").alias(value)).repartition(key).sortWithinPartitions(key, step)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, {step} {kinds[step]}, {value} double, spike boolean")


def spike_stream(stream: DataFrame, key: str, step: str, value: str, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """The same on a stream: the history is the key's state."""
    kinds = {c: t for c, t in stream.dtypes}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(step)
        yield pdf.assign(spike=[rule.step(kept, float(v)) for v in pdf[value]])[[key, step, value, "spike"]]
        state.update((json.dumps(kept),))

    return stream.select(key, step, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {step} {kinds[step]}, {value} double, spike boolean", "kept string", "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class HealthRules:
    """Thresholds of a run's verdict (fixed values)."""

    window: int = 20
    spikes_warn: int = 3
    spikes_kill_share: float = 0.05
    rejected_kill: int = 3
    blowup_warn: float = 3.0
    blowup_kill: float = 10.0
    cos_negative_warn: int = 50
    regress_warn: float = 0.5
    regress_kill: float = 0.75


def fired(df: DataFrame, run: str, step: str, loss: str, grad: str, rules: HealthRules = HealthRules(), spike_rule: SpikeRule = SpikeRule(), *, cosine: str | None = None, warmup: int = 0) -> DataFrame:
    """run, rule, level, at, value: what fired in each run, and at which of its steps (counted from 1).

    A rule's first kill counts, else its first warning.  Each rule is a condition on
    running values of the run (window functions over its steps; frames of medians are
    bounded).  Medians leave out values that aren't finite; spikes are those of spikes().
    cosine: of momentum and gradient, whose run of negative values is watched.
    """
    flags = spikes(df, run, step, loss, spike_rule).select(run, step, "spike")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = df.select(run, step, F.col(loss).cast("double").alias("loss"), F.col(grad).cast("double").alias("grad"), (F.col(cosine) if cosine else F.lit(None)).cast("double").alias("cos")).join(flags, [run, step])
    by, w = W.partitionBy(run).orderBy(step), rules.window
    upto, last = by.rowsBetween(W.unboundedPreceding, 0), lambda n: by.rowsBetween(-(n - 1), 0)
    every = W.partitionBy(run)
    mid = lambda c, frame: median_of(F.collect_list(F.when(finite(c), c)).over(frame))
    i = F.row_number().over(by)
    x = x.withColumn("i", i).withColumn("kept", ~F.col("spike") & finite(F.col("loss")))
    # noise of the values that were no spikes, carried on to those that were
    history = x.where("kept").withColumn("h", F.collect_list("loss").over(last(spike_rule.history))).withColumn("m", median_of(F.col("h")))
    history = history.select(run, step, (1.4826 * median_of(F.transform("h", lambda v: F.abs(v - F.col("m"))))).alias("noise"))
    x = x.join(history, [run, step], "left").withColumn("noise", F.coalesce(F.last("noise", ignorenulls=True).over(upto), F.lit(0.0)))
    x = x.withColumn("spiked", F.sum(F.col("spike").cast("int")).over(upto)).withColumn("rejected", F.sum((~finite(F.col("loss"))).cast("int")).over(upto))
    forward = F.last(F.when(~(F.col("cos") < 0), F.col("i")), ignorenulls=True).over(upto)
    x = x.withColumn("against", F.when(F.col("cos").isNotNull(), F.col("i") - F.coalesce(forward, F.lit(0))))
    x = x.withColumn("recent", F.when(F.col("i") >= w, mid(F.col("loss"), last(w)))).withColumn("grads", mid(F.col("grad"), last(w))).withColumn("long", mid(F.col("grad"), last(2 * w)))
    x = x.withColumn("best", F.min("recent").over(upto)).withColumn("start", F.max(F.when(F.col("i") == w, F.col("recent"))).over(every)).withColumn("start_grad", F.max(F.when(F.col("i") == 2 * w, F.col("long"))).over(every))
    settled = (F.col("i") >= 2 * w) & (F.col("i") > warmup + w)
    lost = F.when((F.col("start") > F.col("best")) & (F.col("recent") - F.col("best") > F.col("noise")), (F.col("recent") - F.col("best")) / (F.col("start") - F.col("best")))
    ratio = F.when(F.col("i") >= 3 * w, F.col("grads") / F.greatest(F.col("start_grad"), F.lit(1e-12)))
    share = F.col("spiked") / F.col("i")
    checks = [
        ("non_finite", "kill", F.col("rejected") >= rules.rejected_kill, F.col("rejected")),
        ("momentum_against_gradient", "warn", F.col("against") >= rules.cos_negative_warn, F.col("against")),
        ("loss_spikes", "warn", F.col("spiked") >= rules.spikes_warn, F.col("spiked")),
        ("loss_spikes", "kill", (F.col("i") >= 100) & (share > rules.spikes_kill_share), share),
        ("loss_above_start", "kill", settled & (F.col("recent") > F.col("start")), F.col("recent")),
        ("loss_regression", "warn", settled & (lost > rules.regress_warn), lost),
        ("loss_regression", "kill", settled & (lost > rules.regress_kill), lost),
        ("grad_blowup", "warn", ratio > rules.blowup_warn, ratio),
        ("grad_blowup", "kill", ratio > rules.blowup_kill, ratio),
    ]
    each = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"), F.col("i").cast("long").alias("at"), value.cast("double").alias("value"))) for name, level, holds, value in checks]))
    first = x.select(run, F.explode(each).alias("f")).groupBy(run, F.col("f.rule").alias("rule")).agg(F.min(F.struct("f.level", "f.at", "f.value")).alias("f"))  # kill comes before warn
    return first.select(run, "rule", "f.level", "f.at", "f.value")


def health(df: DataFrame, run: str, step: str, loss: str, grad: str, rules: HealthRules = HealthRules()) -> DataFrame:
    """run, status (kill, warn or ok), rules (JSON of level by rule) of each run."""
    found = fired(df, run, step, loss, grad, rules).groupBy(run).agg(F.min("level").alias("status"), F.sort_array(F.collect_list(F.struct("rule", "level"))).alias("found"))
    runs = df.select(run).distinct().join(found, run, "left")
    return runs.select(run, F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce(F.to_json(F.map_from_entries("found")), F.lit("{}")).alias("rules"))


def microbatches(df: DataFrame, order: str, size: int, seconds: int, at: str, shard: str) -> DataFrame:
    """shard, batch, n: rows grouped by count or by time since the batch's first, whichever comes first; per shard, in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, order])
        out: list[int] = []
        number, n, began = -1, size, None
        for t in pdf[at]:
            if n >= size or (t - began).total_seconds() > seconds:
                number, n, began = number + 1, 0, t
            n += 1
            out.append(number)
        g = pdf.assign(batch=out).groupby("batch").size()
        return pd.DataFrame({shard: pdf[shard].iloc[0], "batch": g.index, "n": g.values})

    kind = dict(df.dtypes)[shard]
    return df.select(shard, order, at).groupBy(shard).applyInPandas(run, f"{shard} {kind}, batch long, n long")


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Tumbling event-time windows by type, for a batch or a stream with a watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events no more than gap apart."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def dedup_events(events: DataFrame, keys: list[str], *, late: str = "1 hour") -> DataFrame:
    """The first event of each key; on a stream within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
