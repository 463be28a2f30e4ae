"""One-line traces in byte ranges against json.loads, whatever the borders cut."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from granary.sources import traces


def planted(rng, n):
    strange = ['a"b', "back\\slash", "\\", '\\"', "{[", "]}", "é🎉", "", "\n\t", '"traceEvents": [', "\\\\"]
    events = [{"ph": "M", "pid": p, "name": "process_name", "args": {"name": f"/device:TPU:{p}"}} for p in range(2)]
    events += [{"ph": "M", "pid": p, "tid": t, "name": "thread_name", "args": {"name": ["XLA Ops", "Other"][t]}} for p in range(2) for t in range(2)]
    for i in range(n):
        args = {rng.choice(strange): rng.choice([rng.choice(strange), i, None, [1, {"x": "]"}], {"y": {}}]) for _ in range(rng.randrange(3))}
        events.append({"ph": rng.choice("XXBE"), "pid": rng.randrange(2), "tid": rng.randrange(2), "ts": i * 1.5, "dur": i, "name": rng.choice([*strange, "op", "train"]), "args": args | ({"step_num": i} if i % 9 == 0 else {})})
    return events


def as_rows(events):
    text = lambda x: None if x is None else str(x)
    return [(text(e.get("ph")), text(e.get("name")), text(e.get("pid")), text(e.get("tid")), e.get("ts"), e.get("dur"), json.dumps(e["args"], ensure_ascii=False, sort_keys=True)) for e in events]


@pytest.mark.parametrize(("range_bytes", "wrap", "ascii_only"), [(7, "object", True), (64, "object", False), (1000, "list", False), (1 << 20, "object", True)])
def test_ranges(spark, tmp_path, range_bytes, wrap, ascii_only):
    rng = random.Random(range_bytes)
    events = planted(rng, 60 if range_bytes < 50 else 300)
    dump = lambda x: json.dumps(x, ensure_ascii=ascii_only)
    text = dump(events) if wrap == "list" else '{"note": "\\"traceEvents\\": [{}]", "m": {"traceEvents": [{"ph": "no"}]}, "traceEvents" : ' + dump(events) + ', "after": [{"ph": "no"}], "z": "]"}'
    (tmp_path / "a.json").write_text(text)
    got = traces.trace_events(spark, str(tmp_path), range_bytes=range_bytes).orderBy("at").collect()
    assert [tuple(r)[2:] for r in got] == as_rows(events)


def test_blocks_cut_anywhere(tmp_path, monkeypatch):
    rng = random.Random(1)
    events = planted(rng, 40)
    raw = json.dumps(events).encode()
    (tmp_path / "a.json").write_bytes(raw)
    fs, at = traces.store(str(tmp_path / "a.json"))
    for block in (1, 2, 3, 5, 17, 100, 10_000):
        monkeypatch.setattr(traces, "BLOCK", block)
        with fs.open_input_file(at) as f:
            cuts = [1, *sorted(rng.sample(range(2, len(raw)), 5)), len(raw)]
            state, depth, found = traces.OUT, 0, []
            for b, e in zip(cuts, cuts[1:], strict=False):
                found += [json.loads(x) for _, x in traces._objects(f, traces._Range("", b, e, len(raw), state, depth))]
                state, change, _ = traces.scanned(f, b, e, state)
                depth += change
        assert found == events


def test_gzip_filters_and_device(spark, tmp_path):
    events = planted(random.Random(3), 400)
    with gzip.open(tmp_path / "t.json.gz", "wt", encoding="utf-8") as f:
        json.dump({"traceEvents": events}, f)
    read = traces.trace_events(spark, str(tmp_path), range_bytes=500)
    ops = traces.trace_events(spark, str(tmp_path), {"ph": ["X"], "name": ["op", "train"]}, range_bytes=500)
    assert ops.count() == read.where("ph = 'X' and name in ('op', 'train')").count() == sum(e["ph"] == "X" and e["name"] in ("op", "train") for e in events)
    with pytest.raises(ValueError, match="dur"):
        traces.read_ranges(spark, [], {"dur": ["1"]})
    kept = traces.device_events(read)
    want = [e for e in events if e["ph"] == "X" and ((e["name"] == "train" and e["args"].get("step_num") is not None) or (e["pid"] == 0 and e["tid"] == 0))]
    assert sorted(r.ts for r in kept.collect()) == sorted(e["ts"] for e in want)


def test_odd_traces(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"traceEvents": []}')
    assert traces.trace_events(spark, str(tmp_path)).count() == 0
    (tmp_path / "bad.json").write_text('{"other": [1]}')
    with pytest.raises(Exception, match="no array"):
        traces.trace_events(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        traces.trace_events(spark, str(tmp_path / "absent"))
    assert traces.trace_events(spark, str(tmp_path / "none.json")).select(F.col("args")).count() == 0
