"""Events of traces that are one huge JSON text ({"traceEvents": [...]} or a bare list), read in byte ranges.

A range can't tell whether it begins inside a string, after a backslash, or how deep.  So a
first job scans all ranges at once, each from every state that it may begin in, and
gives the state and the change of depth that each leads to; put one after another these
tell every range's true beginning.  Then the data source reads the ranges, each task its
own: it parses the objects that begin there, follows the last one over the range's end,
and passes on those whose fields are asked for.  Memory is bounded by BLOCK and the
longest event.

A gzip stream has no ranges; it is unpacked once, block by block, into the shared folder.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.tables import work_path
from .files import listed, store

#: Bytes that are scanned or read at once.
BLOCK = 4 << 20
OUT, IN, ESCAPED = 0, 1, 2
FIELDS = ("ph", "name", "pid", "tid")
SCHEMA = "file string, at long, ph string, name string, pid string, tid string, ts double, dur double, args string"


def _structure(block: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places outside strings where brackets open (+1) or close (-1), and the state after the block."""
    b = np.frombuffer(block, np.uint8)
    n = len(b)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), state
    slash = b == 0x5C
    last = np.maximum.accumulate(np.where(slash, -1, np.arange(n)))  # the last sign before or at each place that is no backslash
    run = np.r_[0, np.arange(n - 1) - last[:-1]]  # backslashes right before each place
    run[run > np.arange(n)] = 0
    first = np.flatnonzero(~slash)
    lead = int(first[0]) if len(first) else n
    if state == ESCAPED:
        run[: lead + 1] += 1  # the one before the block counts
    quote = np.flatnonzero((b == 0x22) & (run[:n] % 2 == 0))
    inside = np.zeros(n + 1, np.int8)
    inside[quote + 1] = 1
    inside = (np.cumsum(inside) + (state != OUT)) % 2  # before each place
    opens = np.flatnonzero(((b == 0x7B) | (b == 0x5B) | (b == 0x7D) | (b == 0x5D)) & (inside[:n] == 0))
    step = np.where((b[opens] == 0x7B) | (b[opens] == 0x5B), 1, -1)
    end = int(inside[n])
    tail = n - 1 - int(last[-1]) if last[-1] >= 0 else n + (state == ESCAPED)
    return opens, step, ESCAPED if end and tail % 2 else end


def scanned(f, begin: int, end: int, state: int) -> tuple[int, int, int]:  # noqa: ANN001
    """State and change of depth after a range, and the least change within it."""
    depth = least = 0
    for at in range(begin, end, BLOCK):
        _, step, state = _structure(f.read_at(min(BLOCK, end - at), at), state)
        if len(step):
            level = depth + np.cumsum(step)
            least, depth = min(least, int(level.min())), int(level[-1])
    return state, depth, least


def _first_event(f, key: bytes, size: int) -> int:  # noqa: ANN001
    """The place behind the array's bracket; the key stands at the object's own level, within the first 4 blocks."""
    head = f.read_at(min(4 * BLOCK, size), 0)
    if head.lstrip()[:1] == b"[":
        return head.index(b"[") + 1
    at = head.find(key)
    while at >= 0:
        rest = head[at + len(key) :].lstrip()
        _, step, state = _structure(head[:at], OUT)
        if state == OUT and int(step.sum()) == 1 and rest[:1] == b":" and rest[1:].lstrip()[:1] == b"[":
            return head.index(b"[", at) + 1
        at = head.find(key, at + 1)
    raise ValueError(f"no array {key.decode()}")


@dataclass
class _Range(InputPartition):
    file: str
    begin: int
    end: int
    size: int
    state: int
    depth: int  # at the beginning, of the array's own depth: 0 is between events


class _Events(DataSourceReader):
    def __init__(self, ranges: list[list], where: dict[str, list[str]]) -> None:
        self.ranges, self.wanted = ranges, [(k, set(v)) for k, v in where.items()]

    def partitions(self) -> list[_Range]:
        return [_Range(*r) for r in self.ranges]

    def read(self, part: _Range | None) -> Iterator[tuple]:
        if part is None:
            return
        fs, path = store(part.file)
        with fs.open_input_file(path) as f:
            for at, text in _objects(f, part):
                e = json.loads(text)
                said = {k: None if e.get(k) is None else str(e[k]) for k in FIELDS}
                if all(said[k] in v for k, v in self.wanted):
                    number = lambda k: None if e.get(k) is None else float(e[k])  # noqa: B023, E731
                    yield (part.file, at, *said.values(), number("ts"), number("dur"), json.dumps(e["args"], ensure_ascii=False, sort_keys=True) if e.get("args") is not None else None)


def _objects(f, part: _Range) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """The objects that begin in a range, whole; those of the array alone."""
    state, depth, begin, held = part.state, part.depth, None, []
    at = part.begin
    while at < part.size and (at < part.end or begin is not None):
        block = f.read_at(min(BLOCK, part.size - at), at)
        places, step, state = _structure(block, state)
        level = depth + np.cumsum(step)
        over = np.flatnonzero(level < 0)
        stop = int(over[0]) if len(over) else len(step)  # the array's end
        # an object begins where the depth becomes 1 and ends where it is 0 again
        starts, ends = places[:stop][(level[:stop] == 1) & (step[:stop] == 1)], places[:stop][(level[:stop] == 0) & (step[:stop] == -1)]
        taken = 0
        if begin is not None and len(ends):
            yield begin, b"".join([*held, block[: ends[0] + 1]])
            begin, held, taken = None, [], 1
        elif begin is None and len(ends) and (not len(starts) or ends[0] < starts[0]):
            taken = 1  # of one that began in the range before
        if begin is not None:
            held.append(block)
        for i, s in enumerate(starts.tolist()):
            if at + s >= part.end:
                return
            if taken + i < len(ends):
                if block[s : s + 1] == b"{":
                    yield at + s, block[s : ends[taken + i] + 1]
            else:
                begin, held = at + s, [block[s:]]
        if stop < len(step):
            return
        depth = int(level[-1]) if len(level) else depth
        at += len(block)


class TraceEvents(DataSource):
    """Format "trace_events": the events of the ranges (JSON, as of trace_ranges) whose ph, name, pid and tid are among those of `where` (JSON).

    An option and no pushed filter: Spark keeps what the first use of a frame pushes into a
    Python source, and would use it for the frame's other uses, too.
    """

    @classmethod
    def name(cls) -> str:
        return "trace_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Events:  # noqa: ANN001
        return _Events(json.loads(self.options["ranges"]), json.loads(self.options.get("where", "{}")))


def unpacked(spark: SparkSession, path: str) -> str:
    """path, or for gzip files a folder in the shared one with each file unpacked; a task for each file, a block at a time."""
    files = [i.path for i in listed(path, (".gz",))]
    if not files:
        return path
    root, to = path.split("://")[0] + "://" if "://" in path else "", work_path(spark, "unpacked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in zip(batch["id"].to_pylist(), batch["file"].to_pylist(), strict=True):
                fs, at = store(root + name)
                out_fs, out = store(f"{to}/{i:06d}-{name.rsplit('/', 1)[-1][:-3]}")
                out_fs.create_dir(out.rsplit("/", 1)[0], recursive=True)
                with fs.open_input_stream(at, compression=None) as raw, gzip.open(raw) as text, out_fs.open_output_stream(out) as sink:
                    while block := text.read(BLOCK):
                        sink.write(block)
                yield pa.RecordBatch.from_pydict({"file": [name]})

    rows = spark.createDataFrame(list(enumerate(files)), "id long, file string").repartition(len(files))
    rows.mapInArrow(run, "file string").count()
    return to


def trace_ranges(spark: SparkSession, path: str, *, key: str = "traceEvents", range_bytes: int = 64 << 20, suffixes: tuple[str, ...] = (".json", ".txt")) -> list[list]:
    """[file, begin, end, size, state, depth] of each range of each file that holds events."""
    root = path.split("://")[0] + "://" if "://" in path else ""
    infos = [(root + i.path, i.size) for i in listed(path, suffixes) if i.size]
    cuts = [(i, f, b, min(b + range_bytes, size), size) for i, (f, size) in enumerate(infos) for b in range(0, size, range_bytes)]
    named = json.dumps(key).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = store(r["file"])
                with fs.open_input_file(at) as f:
                    first = _first_event(f, named, r["size"]) if r["begin"] < 4 * BLOCK else 0
                    found = [scanned(f, max(r["begin"], first), r["end"], s) for s in (OUT, IN, ESCAPED)]
                yield pa.RecordBatch.from_pylist([{"file": r["file"], "begin": r["begin"], "end": r["end"], "size": r["size"], "first": first, "found": [list(x) for x in found]}])

    if not cuts:
        return []
    rows = spark.createDataFrame([c[1:] for c in cuts], "file string, begin long, end long, size long").repartition(min(len(cuts), 10 * spark.sparkContext.defaultParallelism))
    scans = rows.mapInArrow(run, "file string, begin long, end long, size long, first long, found array<array<long>>").collect()  # a row for each range
    out, file, state, depth, over = [], None, OUT, 0, False
    for r in sorted(scans, key=lambda r: (r.file, r.begin)):
        if r.file != file:
            file, state, depth, over = r.file, OUT, 0, False
        if over:
            continue
        out.append([r.file, max(r.begin, r.first), r.end, r.size, state, depth])
        after, change, least = r.found[state]
        over = depth + least < 0
        state, depth = after, depth + change
    return [x for x in out if x[1] < x[2]]


def read_ranges(spark: SparkSession, ranges: list[list], where: dict[str, list[str]] | None = None) -> DataFrame:
    """The events of trace_ranges, where ph, name, pid or tid is among some values."""
    if unknown := set(where or ()) - set(FIELDS):
        raise ValueError(f"no field of an event: {sorted(unknown)}")
    spark.dataSource.register(TraceEvents)
    return spark.read.format("trace_events").option("ranges", json.dumps(ranges)).option("where", json.dumps(where or {})).load()


def trace_events(spark: SparkSession, path: str, where: dict[str, list[str]] | None = None, **options) -> DataFrame:  # noqa: ANN003
    """file, at (the byte where it begins), ph, name, pid, tid, ts, dur, args (JSON) of the events of the traces in path."""
    return read_ranges(spark, trace_ranges(spark, unpacked(spark, path), **options), where)


def device_events(events: DataFrame, *, device: str = r"TPU:0", threads: tuple[str, ...] = ("XLA Ops", "Steps", "XLA Modules"), step: str = "train") -> DataFrame:
    """Complete events (ph X) of the device's named threads, and the host's step marks; process and thread names are those of the trace's metadata."""
    meta = events.where("ph = 'M'").select("file", "pid", "tid", "name", F.get_json_object("args", "$.name").alias("label"))
    processes = meta.where("name = 'process_name'").groupBy("file", "pid").agg(F.max("label").alias("process"))
    lanes = meta.where("name = 'thread_name'").groupBy("file", "pid", "tid").agg(F.max("label").alias("thread"))
    x = events.where("ph = 'X'").join(processes, ["file", "pid"], "left").join(lanes, ["file", "pid", "tid"], "left")
    mark = (F.col("name") == step) & F.get_json_object("args", "$.step_num").isNotNull()
    return x.where(mark | (F.col("process").rlike(device) & F.col("thread").isin(*threads)))
