"""Packing variable-length segments into rows of fixed lengths; order decides, so a shard is one sequential group.

Shards are independent streams: parallelism is their number.  A shard's segments meet in
one task, as numbers only (16 bytes each), never their tokens.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import hash01, stable_hash

PLACED = "shard long, idx long, bucket int, micro int, slot_row int, slot int, start int"


@dataclass
class Micro:
    """An open microbatch: `rows` rows of `length` tokens with `slots` segments at most."""

    number: int
    length: int
    rows: int
    slots: int
    used: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.used = self.used or [0] * self.rows
        self.count = self.count or [0] * self.rows

    def room(self, row: int, n: int) -> int:
        """What row would have left after n more tokens; negative if they don't fit."""
        return -1 if self.count[row] >= self.slots else self.length - n - self.used[row]

    def first(self, n: int) -> int | None:
        return next((r for r in range(self.rows) if self.room(r, n) >= 0), None)

    def put(self, row: int, n: int) -> tuple[int, int]:
        at = self.count[row], self.used[row]
        self.count[row] += 1
        self.used[row] += n
        return at

    def fill(self) -> float:
        return sum(self.used) / (self.length * self.rows)


class Packer:
    """Places segments one by one; state() and restore() carry it over a break."""

    def __init__(self, buckets: tuple[int, ...], budget: int, slots: int, *, bins: int = 1, labels: int = 26, best_fit: bool = False, full: float = 0.99) -> None:
        self.buckets, self.budget, self.slots, self.bins, self.labels, self.best_fit, self.full = tuple(sorted(buckets)), budget, slots, bins, labels, best_fit, full
        self.open: list[Micro] = []
        self.closed: list[int] = []
        self.made = 0

    def bucket_of(self, n: int) -> int | None:
        return next((b for b in self.buckets if n <= b), None)

    def place(self, n: int, labels: int = 0) -> tuple[int, int, int, int, int] | None:
        """(bucket, microbatch, row, slot, start) of a segment of n tokens; None if it is dropped."""
        bucket = self.bucket_of(n)
        if bucket is None or labels > self.labels:
            return None
        found = self._tightest(n, bucket) if self.best_fit else self._earliest(n, bucket)
        if found is None:
            mine = [m for m in self.open if m.length == bucket]
            if len(mine) >= self.bins:
                self._close(max(mine, key=lambda m: (m.fill(), -m.number)))
            micro = Micro(self.made, bucket, max(1, self.budget // bucket), self.slots)
            self.made += 1
            self.open.append(micro)
            found = micro, 0
        micro, row = found
        slot, start = micro.put(row, n)
        if self.bins > 1 and micro.fill() >= self.full:
            self._close(micro)
        return micro.length, micro.number, row, slot, start

    def _earliest(self, n: int, bucket: int) -> tuple[Micro, int] | None:
        for m in self.open:
            if m.length == bucket and (r := m.first(n)) is not None:
                return m, r
        return None

    def _tightest(self, n: int, bucket: int) -> tuple[Micro, int] | None:
        """The row with the least room left, of this bucket or a longer one; a new row of this bucket if that would have less."""
        rows = [(m.room(r, n), m.length, m.number, r, m) for m in self.open if m.length >= bucket for r in range(m.rows)]
        rows = [x for x in rows if x[0] >= 0]
        if not rows:
            return None
        best = min(rows, key=lambda x: x[:4])
        return None if bucket - n < best[0] else (best[4], best[3])

    def _close(self, micro: Micro) -> None:
        self.open.remove(micro)
        self.closed.append(micro.number)

    def state(self) -> str:
        return json.dumps({"made": self.made, "closed": self.closed, "open": [[m.number, m.length, m.rows, m.slots, m.used, m.count] for m in self.open]})

    def restore(self, state: str) -> None:
        s = json.loads(state)
        self.made, self.closed, self.open = s["made"], s["closed"], [Micro(*m) for m in s["open"]]


def pack(segments: DataFrame, *, buckets: tuple[int, ...], budget: int, slots: int, bins: int = 1, best_fit: bool = False, longest_first: bool = False) -> DataFrame:
    """shard, idx, bucket, micro, slot_row, slot, start of segments (shard, idx, n); dropped ones have nulls from bucket on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "idx"], ascending=[False, True]) if longest_first else pdf.sort_values("idx")
        packer = Packer(buckets, budget, slots, bins=bins, best_fit=best_fit)
        at = [packer.place(int(n)) or (None,) * 5 for n in pdf["n"]]
        out = pd.DataFrame(at, columns=["bucket", "micro", "slot_row", "slot", "start"], dtype="Int32")
        return pd.concat([pdf[["shard", "idx"]].reset_index(drop=True), out], axis=1)

    return segments.select("shard", "idx", "n").groupBy("shard").applyInPandas(run, PLACED)


def pack_part(segments: DataFrame, *, buckets: tuple[int, ...], budget: int, slots: int, bins: int = 1, best_fit: bool = False, state: DataFrame | None = None) -> DataFrame:
    """pack() of a part of each shard's stream, with state: a row without idx that holds what the next part goes on from (shard, state)."""

    def run(key: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(buckets, budget, slots, bins=bins, best_fit=best_fit)
        if len(before):
            packer.restore(before["state"].iloc[0])
        pdf = pdf.sort_values("idx")
        at = [packer.place(int(n)) or (None,) * 5 for n in pdf["n"]]
        out = pd.DataFrame(at, columns=["bucket", "micro", "slot_row", "slot", "start"], dtype="Int32")
        out = pd.concat([pdf[["shard", "idx"]].reset_index(drop=True).astype("Int64"), out], axis=1).assign(state=None)
        return pd.concat([out, pd.DataFrame({"shard": [key[0]], "state": [packer.state()]})], ignore_index=True)

    none = segments.sparkSession.createDataFrame([], "shard long, state string")
    rows = segments.select(F.col("shard").cast("long").alias("shard"), "idx", "n").groupBy("shard")
    return rows.cogroup((none if state is None else state).groupBy("shard")).applyInPandas(run, f"{PLACED}, state string")


def accumulated(placed: DataFrame, accumulation: int) -> DataFrame:
    """shard, bucket, step, micros: steps of `accumulation` microbatches of one bucket, in order of their numbers; what is left waits."""
    m = placed.where("micro is not null").select("shard", "bucket", "micro").distinct()
    step = F.floor((F.row_number().over(W.partitionBy("shard", "bucket").orderBy("micro")) - 1) / accumulation)
    g = m.withColumn("step", step).groupBy("shard", "bucket", "step").agg(F.sort_array(F.collect_list("micro")).alias("micros"))
    return g.where(F.size("micros") == accumulation)


def broken_rows(tokens: DataFrame) -> DataFrame:
    """Of tokens (row, pos, segment) the rows whose segments aren't runs of 1, 2, ... with padding (0) last."""
    before = F.lag("segment").over(W.partitionBy("row").orderBy("pos"))
    x = tokens.withColumn("was", F.coalesce(before, F.lit(0))).withColumn("first", before.isNull())
    ok = F.when(F.col("segment") == 0, True).when(F.col("first"), F.col("segment") == 1).otherwise((F.col("was") > 0) & (F.col("segment") - F.col("was")).isin(0, 1))
    return x.where(~ok).select("row").distinct()


def drawn_segments(lengths: DataFrame, weights: dict[str, float], draws: int, *, seed: int = 0, shards: int = 8, parts: int = 64) -> DataFrame:
    """shard, idx, source, n of `draws` draws: a source by weight, then one of its rows (source, n), both by hash of (seed, draw).

    weights is the mixture, a number for each source; lengths stays dealt.
    """
    total, cumulative = sum(weights.values()), 0.0
    u, upper = hash01(F.col("id"), seed), []
    for source in sorted(weights):
        cumulative += weights[source]
        upper.append((source, cumulative / total))
    pick = F.lit(upper[-1][0])
    for source, edge in reversed(upper[:-1]):
        pick = F.when(u < edge, F.lit(source)).otherwise(pick)
    # rows are numbered within parts of a source, so that no source meets in one task
    others = [c for c in lengths.columns if c != "source"]
    dealt = lengths.withColumn("part", F.pmod(F.xxhash64(*others), F.lit(parts)))
    rows = dealt.withColumn("k", F.row_number().over(W.partitionBy("source", "part").orderBy(*others)) - 1)
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("c"))  # `parts` rows for each source
    edges = counts.select("source", "part", (F.sum("c").over(W.partitionBy("source").orderBy("part")) - F.col("c")).alias("lo"), "c", F.sum("c").over(W.partitionBy("source")).alias("rows"))
    sizes = edges.groupBy("source").agg(F.max("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("lo", "c", "part"))).alias("edges"))
    d = lengths.sparkSession.range(draws).withColumn("source", pick).join(sizes, "source")
    d = d.withColumn("k", F.pmod(stable_hash(F.lit(seed), F.col("id"), F.lit("row")), F.col("rows")))
    d = d.withColumn("e", F.filter("edges", lambda e: (F.col("k") >= e["lo"]) & (F.col("k") < e["lo"] + e["c"]))[0])
    d = d.select("id", "source", F.col("e.part").alias("part"), (F.col("k") - F.col("e.lo")).cast("int").alias("k"))
    return d.join(rows.select("source", "part", "k", "n"), ["source", "part", "k"]).select(F.pmod("id", F.lit(shards)).alias("shard"), F.col("id").alias("idx"), "source", F.col("n").cast("long").alias("n"))
