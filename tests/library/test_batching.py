"""Requests in batches by count or time on a stream, errors for all that wait, restarts."""

import time

import pytest

from granary.streaming.batching import batched


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_count_time_errors_and_restart(rocks, tmp_path):
    spark = rocks

    def shout(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    put = lambda n, rows: spark.createDataFrame(rows, "shard long, id long, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    read = lambda: spark.read.schema("shard long, id long, batch long, size long, by string, answer string, error string").parquet(str(tmp_path / "out"))

    def start():
        s = spark.readStream.schema("shard long, id long, text string").json(str(tmp_path / "in"))
        return batched(s, "shard", "id", "text", shout, size=4, millis=3_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()

    def wait(n):
        until = time.time() + 60
        while time.time() < until:
            if (tmp_path / "out/_spark_metadata").exists() and read().count() >= n:
                return {r.id: r for r in read().collect()}
            time.sleep(0.5)
        raise AssertionError(f"{read().count()} answers")

    put(0, [(1, i, f"t{i}") for i in range(9)] + [(2, 100 + i, "bad" if i == 2 else f"u{i}") for i in range(5)])
    q = start()
    got = wait(14)  # three full batches, and two left over that time sets off
    q.stop()
    assert {got[i].by for i in range(8)} == {"count"} and (got[8].by, got[8].size, got[8].answer) == ("time", 1, "T8")
    assert [got[i].answer for i in range(8)] == [f"T{i}" for i in range(8)]
    failed = [r for r in got.values() if r.error]
    assert len(failed) == 4 and {r.error for r in failed} == {"RuntimeError: no answer"} and {r.batch for r in failed} == {0} and got[104].answer == "U4"
    put(1, [(1, 200, "a"), (1, 201, "b")])
    q = start()
    time.sleep(1)
    q.stop()  # whether these were taken or not, a restart answers each once
    put(2, [(1, 202, "c"), (1, 203, "d")])
    q = start()
    got = wait(18)
    q.stop()
    assert read().count() == 18 and [got[i].answer for i in range(200, 204)] == ["A", "B", "C", "D"]


def test_spikes_keep_each_history_across_batches(spark):
    """Many keys in one task, in batches of 7 rows, against one fold for each key."""
    from granary.streaming import monitors

    value = lambda k, s: {0: 90.0, 3: None, 5: float("nan")}.get((s * s + (k or 5)) % 11, 1 + 0.01 * s)
    rows = [(k, s, value(k, s)) for k in (None, 1, 2, 3) for s in range(40)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "run long, step int, loss double").repartition(3)
        frame = monitors.spikes(df, "run", "step", "loss")
        got = {(r.run, r.step): r.spike for r in frame.collect()}
        plan = frame._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    rule, want = monitors.SpikeRule(), {}
    for key in (None, 1, 2, 3):
        kept = []
        want |= {(k, s): rule.step(kept, float("nan") if v is None else v) for k, s, v in rows if k == key}
    assert got == want and {True, False} == set(want.values())
    assert "FlatMapGroups" not in plan  # no call for each key
