"""Repositories of files: splits, pushed filters, pruned columns, JSON columns, files skipped by statistics."""

import json

import pytest
from pyspark.sql import functions as F

from granary.sources.repos import Registry, Repository


@pytest.fixture
def registry(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 0.5).alias("x"), F.concat(F.lit("name "), "id").alias("name"), F.array("id", "id").alias("list"), F.struct(F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).alias("deep"))
    rows = rows.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")))
    rows.repartitionByRange(10, "id").write.parquet(f"{tmp_path}/repo/main/train")
    rows.where("id < 10").select(F.lit(None).cast("long").alias("id"), "x").coalesce(1).write.parquet(f"{tmp_path}/repo/main/nulls")
    rows.where("id < 3").select("id", "deep", "list").write.json(f"{tmp_path}/lines/v1")
    r = Registry()
    r.register(Repository("repo", f"{tmp_path}/repo", {"main": {"train": "main/train/*", "none": "absent/*", "nulls": "main/nulls/*"}}))
    r.register(Repository("lines", f"file://{tmp_path}/lines", {"v1": {"test": "v1/*"}}, "json", "id long, deep string, list string"))
    return r


def test_plan_and_json_columns(spark, registry):
    df = registry.load(spark, "repo", "main", "train", columns=["id", "deep"], where=F.col("id") > 990)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,990)]" in plan and "ReadSchema: struct<id:bigint,deep:struct<a:bigint,b:string>>" in plan
    assert {(r.id, r.deep) for r in df.collect()} == {(i, json.dumps({"a": i}).replace(" ", "")) for i in range(991, 1000)}
    lines = registry.load(spark, "lines", "v1", "test").orderBy("id").collect()
    assert [(r.id, json.loads(r.deep), json.loads(r.list)) for r in lines] == [(i, {"a": i}, [i, i]) for i in range(3)]


def test_files_are_skipped(spark, registry):
    import datetime

    registry.index(spark, "repo", ["id", "name", "day", "absent", "list"])
    for between, want in (({"id": (250, 349)}, 100), ({"id": (None, 5)}, 6), ({"id": (2000, None)}, 0), ({"day": (datetime.date(2020, 1, 11), datetime.date(2020, 1, 12))}, 2), ({"id": (1, 1), "name": ("name 1", "name 1")}, 1)):
        read, gone = registry.skipped("repo", "main", "train", between)
        df = registry.load(spark, "repo", "main", "train", between=between)
        assert df.count() == want and read + gone == 10 and gone >= 7
    assert registry.skipped("repo", "main", "train", {"absent": (1, 2)}) == (10, 0)
    assert registry.skipped("repo", "main", "nulls", {"id": (1, 2)}) == (0, 1)


def test_wrong_names(spark, registry):
    for wrong in (("repo", "other", "train"), ("repo", "main", "dev")):
        with pytest.raises(ValueError, match="has no"):
            registry.load(spark, *wrong)
    with pytest.raises(FileNotFoundError):
        registry.load(spark, "repo", "main", "none")
    with pytest.raises(ValueError, match="index"):
        registry.load(spark, "repo", "main", "train", between={"id": (1, 2)})
    with pytest.raises(ValueError, match="already"):
        registry.register(registry.repositories["repo"])
    with pytest.raises(ValueError, match="schema"):
        registry.register(Repository("x", "/x", {}, "csv"))
