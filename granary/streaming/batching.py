"""Requests on a stream, answered in batches: by count or by time since a batch's first, whichever comes first.

Each key (a shard of requests) holds its waiting requests as state.  The one that fills a
batch sets it off at once; else a processing-time timer, set when a batch's first request
came, does.  A call that fails gives its error to every request of its batch, and to no
other.  Requests and answers are rows, so a restart from the checkpoint loses none.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWER = "batch long, size long, by string, answer string, error string"


def batched(stream: DataFrame, shard: str, ident: str, payload: str, call: Callable[[list[str]], list[str]], *, size: int, millis: int) -> DataFrame:
    """shard, ident, ANSWER of a stream of requests; by is `count` or `time`."""
    kinds = dict(stream.dtypes)

    class Batches(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", "requests string, batch long")

        def _state(self) -> tuple[list, int]:
            if not self.waiting.exists():
                return [], 0
            requests, batch = self.waiting.get()
            return json.loads(requests), batch

        def _answered(self, key: tuple, requests: list, batch: int, by: str) -> pd.DataFrame:
            try:
                answers, error = call([r[1] for r in requests]), None
                if len(answers) != len(requests):
                    raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
            except Exception as e:  # noqa: BLE001  whatever it was, those who wait must know
                answers, error = [None] * len(requests), f"{type(e).__name__}: {e}"
            return pd.DataFrame({shard: key[0], ident: [r[0] for r in requests], "batch": batch, "size": len(requests), "by": by, "answer": answers, "error": error})

        def _timers(self, first: int | None) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if first is not None:
                self.handle.registerTimer(first + millis)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            waiting, batch = self._state()
            had = len(waiting)
            out = []
            for pdf in rows:
                for r in zip(pdf[ident].tolist(), pdf[payload].tolist(), strict=True):
                    waiting.append(r)
                    if len(waiting) >= size:
                        out.append(self._answered(key, waiting, batch, "count"))
                        waiting, batch, had = [], batch + 1, 0
            self.waiting.update((json.dumps(waiting), batch))
            if not waiting:
                self._timers(None)
            elif not had:  # a batch that began now; one that waits already has its timer
                self._timers(timerValues.getCurrentProcessingTimeInMs())
            yield from out

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            waiting, batch = self._state()
            if waiting:
                self.waiting.update((json.dumps([]), batch + 1))
                yield self._answered(key, waiting, batch, "time")

        def close(self) -> None:
            pass

    schema = f"{shard} {kinds[shard]}, {ident} {kinds[ident]}, {ANSWER}"
    return stream.select(shard, ident, payload).groupBy(shard).transformWithStateInPandas(Batches(), schema, "Append", "ProcessingTime")
