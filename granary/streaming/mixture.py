"""A training mixture as an endless, order-checked, resumable stream.

The order is a random-access map: from a position alone follow the source, its epoch and
the row, so a reader may begin anywhere and two readers agree.  Positions come in blocks;
of the first b blocks, the sources up to s have floor(b * block * W_s) positions (W_s:
their share), which gives each source's draws before any block; within a block positions
are permuted, and so is each source's order of rows in each epoch, by keyed permutations
of whole numbers.

The format "mixture" streams positions: its offsets are positions, its latest one is what
the file `released` allows, so whoever consumes sets the pace; batches are cut into ranges
of `range` positions.  checked() keeps the next expected position as state and tells gaps
and repeats, whatever was restarted between.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import store


def permuted(i: np.ndarray, n: int, key: str) -> np.ndarray:
    """The places of i in a permutation of 0 .. n - 1: four rounds of a Feistel network over the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}|{r}".encode(), digest_size=8).digest(), "little")) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    x = once(i.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


@dataclass(frozen=True)
class Mixture:
    """sources: name -> (rows, weight).  Each weight's share of a block is a position at least."""

    sources: dict[str, tuple[int, float]]
    seed: int = 0
    block: int = 1024

    def _before(self, b: np.ndarray) -> np.ndarray:
        """[blocks, sources + 1]: positions of the sources up to each in the first b blocks."""
        w = np.array([self.sources[s][1] for s in sorted(self.sources)], float)
        share = np.r_[0.0, np.cumsum(w) / w.sum()]
        share[-1] = 1.0
        return np.floor(b[:, None].astype(np.float64) * self.block * share[None, :] + 1e-6).astype(np.int64)

    def at(self, positions: np.ndarray) -> pd.DataFrame:
        """position, source, epoch, row (its number in the source)."""
        names = sorted(self.sources)
        out = []
        for b in np.unique(positions // self.block).tolist():
            mine = positions[positions // self.block == b]
            before, after = self._before(np.array([b, b + 1]))
            place = permuted(mine - b * self.block, self.block, f"{self.seed}|block|{b}")
            n = np.diff(after) - np.diff(before)  # of each source in this block
            edge = np.r_[0, np.cumsum(n)]
            s = np.searchsorted(edge, place, "right") - 1
            draw = np.diff(before)[s] + place - edge[s]
            rows = np.array([self.sources[x][0] for x in names])[s]
            epoch, row = draw // rows, draw % rows
            for k in np.unique(s).tolist():
                for e in np.unique(epoch[s == k]).tolist():
                    some = (s == k) & (epoch == e)
                    row[some] = permuted(row[some], int(self.sources[names[k]][0]), f"{self.seed}|{names[k]}|{e}")
            out.append(pd.DataFrame({"position": mine, "source": [names[k] for k in s], "epoch": epoch, "row": row}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"position": [], "source": [], "epoch": [], "row": []})


@dataclass
class _Range(InputPartition):
    begin: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, mixture: Mixture, released: str, step: int) -> None:
        self.mixture, self.released, self.step = mixture, released, step

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": 0}

    def latestOffset(self, *_: object) -> dict:  # noqa: N802
        fs, at = store(self.released)
        with fs.open_input_file(at) as f:
            return {"position": int(f.read().decode().strip() or 0)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        a, z = int(start["position"]), int(end["position"])
        return [_Range(b, min(b + self.step, z)) for b in range(a, z, self.step)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pandas(self.mixture.at(np.arange(part.begin, part.end)), _ROWS, preserve_index=False)


_ROWS = pa.schema([("position", pa.int64()), ("source", pa.string()), ("epoch", pa.int64()), ("row", pa.int64())])


class MixtureStream(DataSource):
    """Format "mixture": position, source, epoch, row.  Options: mixture (JSON), released (a file with a number), range."""

    @classmethod
    def name(cls) -> str:
        return "mixture"

    def schema(self) -> str:
        return "position long, source string, epoch long, row long"

    def streamReader(self, schema) -> _Reader:  # noqa: ANN001, N802
        m = json.loads(self.options["mixture"])
        return _Reader(Mixture({k: tuple(v) for k, v in m["sources"].items()}, m["seed"], m["block"]), self.options["released"], int(self.options.get("range", 4096)))


def stream(spark: SparkSession, mixture: Mixture, released: str, *, step: int = 4096) -> DataFrame:
    """The mixture's positions up to what the file `released` says, now and later."""
    spark.dataSource.register(MixtureStream)
    how = json.dumps({"sources": mixture.sources, "seed": mixture.seed, "block": mixture.block})
    return spark.readStream.format("mixture").option("mixture", how).option("released", released).option("range", str(step)).load()


def checked(positions: DataFrame, lane: str) -> DataFrame:
    """lane, first, last, n, fault of each batch of a lane (a consumer's share of positions, by range or whole): fault is `gap` or `repeat` where
    its positions aren't those that follow the ones before."""

    class Next(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.next = handle.getValueState("next", "position long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            got = np.sort(np.concatenate([r["position"].to_numpy() for r in rows]))
            want = self.next.get()[0] if self.next.exists() else 0
            fault = "repeat" if got[0] < want or (np.diff(got) == 0).any() else "gap" if got[0] > want or (np.diff(got) > 1).any() else None
            self.next.update((int(got[-1]) + 1,))
            yield pd.DataFrame({lane: [key[0]], "first": [int(got[0])], "last": [int(got[-1])], "n": [len(got)], "fault": [fault]})

        def close(self) -> None:
            pass

    kind = dict(positions.dtypes)[lane]
    return positions.select(lane, "position").groupBy(lane).transformWithStateInPandas(Next(), f"{lane} {kind}, first long, last long, n long, fault string", "Append", "None")
