"""Fixed-size samples of strata in one pass: mergeable bottom-k sketches.

A row's draw is a 64-bit hash of its id and the seed; a stratum's sample are its k rows of
least draw.  A task keeps, batch by batch, no more than k rows of each stratum, and two
sketches merge to the k least of both; so the sample is the same however rows are dealt,
nothing is sorted but sketches, and a stratum that holds most rows sends k a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _least(t: pa.Table, k: int) -> pa.Table:
    """The k rows of least (draw, id) of each stratum."""
    stratum = t["stratum"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    draw, ident = t["draw"].to_numpy(), t["id"].to_numpy()
    order = np.lexsort((ident, draw, stratum))
    s = stratum[order]
    first = np.r_[True, s[1:] != s[:-1]]
    place = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return t.take(pa.array(order[place < k]))


def bottom_k(df: DataFrame, stratum: str, k: int, *, ident: str = "id", seed: int = 0, salts: int = 16) -> DataFrame:
    """stratum, id, draw of k rows of each stratum (all of a smaller one); ident is a unique number.  A null stratum is one."""
    schema = "stratum string, id long, draw long"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = _least(t if held is None else pa.concat_tables([held, t]), k)
        if held is not None:
            yield from held.to_batches()

    rows = df.where(F.col(ident).isNotNull()).select(F.col(stratum).cast("string").alias("stratum"), F.col(ident).cast("long").alias("id"), F.xxhash64(F.lit(seed), F.col(ident).cast("long")).alias("draw"))
    parts = rows.mapInArrow(sketch, schema).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    merged = parts.groupBy("stratum", "salt").applyInArrow(lambda t: _least(t.drop_columns(["salt"]), k), schema)
    return merged.groupBy("stratum").applyInArrow(lambda t: _least(t, k), schema)


def thinned(df: DataFrame, kept: Column, share: float, *, ident: str = "id", seed: int = 0) -> DataFrame:
    """All rows where kept holds, and of the others a share, by hash."""
    u = F.pmod(F.xxhash64(F.lit(f"thin {seed}"), F.col(ident)), F.lit(1 << 20)) / (1 << 20)
    return df.where(F.coalesce(kept, F.lit(False)) | (u < share))


def reservoir(df: DataFrame, k: int, *, kept: Column, share: float, ident: str = "id", seed: int = 0) -> DataFrame:
    """k rows of df with all columns, after the rows that aren't kept were thinned to a share."""
    few = bottom_k(thinned(df, kept, share, ident=ident, seed=seed).withColumn("__all", F.lit("")), "__all", k, ident=ident, seed=seed)
    return df.join(F.broadcast(few.select(F.col("id").alias("__id"))), F.col(ident) == F.col("__id"), "left_semi")
