"""Dumps, logs, stages and manifests: what a run writes and reads again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces: equal values give equal texts."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file, hashed where it lies."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_dump(df: DataFrame, path: str) -> None:
    """A prediction dump as compressed JSON lines; logits and probabilities rounded."""
    kinds = dict(df.dtypes)
    digits = {"logits": 6, "probs": 4, "p": 4}
    rounded = lambda c: F.transform(c, lambda x: F.round(x, digits[c])) if kinds[c] == "array<double>" else F.col(c)
    df.select(*[rounded(c).alias(c) if c in digits else F.col(c) for c in df.columns]).write.option("compression", "gzip").json(path)


def read_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stage(spark: SparkSession, folder: str, name: str, arguments: object, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage, built once for each (name, arguments) and then read."""
    path = f"{folder.rstrip('/')}/{name}-{fingerprint([name, arguments])[:16]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")  # noqa: SLF001
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):  # noqa: SLF001
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def flattened(metrics: dict, prefix: str = "") -> dict[str, float]:
    """Nested metrics as a/b/c names."""
    out: dict[str, float] = {}
    for k, v in metrics.items():
        name = f"{prefix}/{k}" if prefix else k
        if isinstance(v, dict):
            out |= flattened(v, name)
        else:
            out[name] = float(v)
    return out


def latest_metrics(log: DataFrame, resume: Column | None = None) -> DataFrame:
    """run, step, name, value: the last write of each, of an append-only log (run, step, name, value, seq); rows after the resume step are void."""
    x = log if resume is None else log.where(F.col("step") <= resume)
    return x.groupBy("run", "step", "name").agg(F.max_by("value", "seq").alias("value"))


def manifest(rows: DataFrame) -> dict:
    """Rows, languages and licences by source, and the fingerprint of the whole; a row for each source reaches the driver."""
    r = rows.groupBy("source", "lang").agg(F.count("*").alias("n")).collect()
    out: dict[str, dict] = {}
    for x in sorted(r, key=lambda y: (y.source or "", y.lang or "")):
        s = out.setdefault(x.source or "", {"rows": 0, "lang": {}})
        s["rows"] += x.n
        s["lang"][x.lang or ""] = x.n
    return {"sources": out, "rows": sum(s["rows"] for s in out.values()), "fingerprint": fingerprint(out)}
