"""The mixture's random-access order, and its stream killed and restarted."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.streaming.mixture import Mixture, checked, permuted, stream

M = Mixture({"a": (50, 0.5), "b": (7, 0.2), "c": (1, 0.3)}, seed=3, block=64)


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        p = permuted(np.arange(n), n, "k")
        assert sorted(p.tolist()) == list(range(n)) and (n < 60 or p.tolist() != permuted(np.arange(n), n, "other").tolist())


def test_order_is_random_access():
    whole = M.at(np.arange(31 * 64))
    for cut in (np.arange(700, 701), np.arange(63, 130), np.array([1983, 5, 640])):
        assert M.at(cut).sort_values("position").values.tolist() == whole[whole.position.isin(cut)].values.tolist()
    share = Counter(whole.source)
    assert abs(share["a"] - 992) <= 2 and abs(share["b"] - 397) <= 2
    for name, (rows, _) in M.sources.items():
        mine = whole[whole.source == name]
        for epoch, part in mine.groupby("epoch"):
            assert part.row.is_unique and (epoch == mine.epoch.max() or len(part) == rows)  # an epoch has each row once
    assert Mixture(M.sources, seed=4, block=64).at(np.arange(100)).row.tolist() != whole.row[:100].tolist()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_stream_restarts_in_order(rocks, tmp_path):
    spark, released = rocks, tmp_path / "released"
    ends = [100, 100, 333, 333, 1000]  # the fourth start runs the third batch again
    for k, end in enumerate(ends):
        released.write_text(str(end))
        q = stream(spark, M, str(released), step=37).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        if k == 2:  # as if killed before the batch was committed: it is run again, and its rows come once
            last = max((tmp_path / "check/commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        assert spark.read.parquet(str(tmp_path / "out")).count() == end
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("position").toPandas()
    assert got.values.tolist() == M.at(np.arange(1000)).values.tolist()


def test_positions_are_checked(rocks, tmp_path):
    spark, released = rocks, tmp_path / "released"
    for end in (50, 120, 121):
        released.write_text(str(end))
        lanes = stream(spark, M, str(released), step=20).withColumn("lane", F.lit("all"))
        checked(lanes, "lane").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("first").collect()
    assert [(r.first, r.last, r.n, r.fault) for r in [type("R", (), {"first": x["first"], "last": x["last"], "n": x["n"], "fault": x["fault"]}) for x in got]] == [(0, 49, 50, None), (50, 119, 70, None), (120, 120, 1, None)]
    released.write_text("200")
    holes = stream(spark, M, str(released)).where("position <> 150").withColumn("lane", F.lit("all"))
    checked(holes, "lane").writeStream.format("parquet").option("path", str(tmp_path / "holes")).option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start().awaitTermination()
    assert [x["fault"] for x in spark.read.parquet(str(tmp_path / "holes")).collect()] == ["gap"]
