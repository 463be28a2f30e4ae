"""Bottom-k samples: the same for any dealing, the k least draws of each stratum."""

import pytest
from pyspark.sql import functions as F

from granary.operators import reservoir as R


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "big").when(F.col("id") % 100 > 0, "small").alias("s"), F.col("id").cast("string").alias("text"))


def test_bottom_k(spark, rows):
    draws = {r.id: (r.d, r.id, r.s) for r in rows.select("id", "s", F.xxhash64(F.lit(3), "id").alias("d")).collect()}
    want = sorted(i for s in ("big", "small", None) for _, i, _ in sorted(x for x in draws.values() if x[2] == s)[:50])
    for dealt in (rows.repartition(7), rows.coalesce(1), rows.repartition(2, "s")):
        got = R.bottom_k(dealt, "s", 50, seed=3)
        assert sorted(r.id for r in got.collect()) == want and len(want) == 50 + 50 + 30
    assert R.bottom_k(rows, "s", 50, seed=4).join(R.bottom_k(rows, "s", 50, seed=3), "id").count() < 80
    assert R.bottom_k(rows.limit(0), "s", 5).count() == 0


def test_reservoir(spark, rows):
    plan = R.reservoir(rows, 200, kept=F.col("s") == "small", share=1 / 33)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "rangepartitioning" not in plan
    got = R.reservoir(rows, 200, kept=F.col("s") == "small", share=1 / 33).collect()
    small = sum(r.s == "small" for r in got)
    assert len(got) == 200 and got[0].text == str(got[0].id) and 120 < small < 200
    assert R.reservoir(rows, 10**6, kept=F.lit(False), share=0.0).count() == 0
