"""A registry of repositories of data files: configurations and splits as file patterns, a schema for each, files skipped by their statistics.

A Repository says where its files are; load() reads those of a configuration and split
with Spark's own readers, so filters and columns that are asked for reach the scan
(PushedFilters and ReadSchema in the plan).  Columns of a deeper type come as JSON text:
schemas of different configurations then agree, and nothing in them is lost.

index() makes a table of the smallest and largest value of some columns in each Parquet
file, from the footers, one task for some files.  With it load(between=...) leaves out
files that can't hold a row in a range, before the scan lists them; skipped() counts them.
A file without statistics for a column, or with nulls alone, is never left out wrongly: the
first is always read, the second holds no row in any range.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..operators.tables import written
from .files import listed, store

SUFFIXES = {"parquet": (".parquet",), "json": (".json", ".jsonl", ".json.gz", ".jsonl.gz"), "csv": (".csv", ".csv.gz", ".tsv")}


@dataclass(frozen=True)
class Repository:
    """root: a folder in any store.  configs: name -> {split: pattern of paths under root}.  schema: DDL, needed by all but Parquet."""

    name: str
    root: str
    configs: dict[str, dict[str, str]]
    format: str = "parquet"
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def files(self, config: str, split: str) -> list[str]:
        """The files of a split, by name; at least one."""
        if config not in self.configs:
            raise ValueError(f"{self.name} has no configuration {config!r}: {sorted(self.configs)}")
        if split not in self.configs[config]:
            raise ValueError(f"{self.name} / {config} has no split {split!r}: {sorted(self.configs[config])}")
        found = self.matching([self.configs[config][split]])
        if not found:
            raise FileNotFoundError(f"{self.name} / {config} / {split}: no file matches {self.configs[config][split]!r}")
        return found

    def matching(self, patterns: list[str]) -> list[str]:
        """The files that match a pattern, by name; the store is listed once."""
        scheme = self.root.split("://")[0] + "://" if "://" in self.root else ""
        _, at = store(self.root)
        return [scheme + i.path for i in listed(self.root, SUFFIXES[self.format]) if any(fnmatch.fnmatch(i.path[len(at) :].lstrip("/"), p) for p in patterns)]


@dataclass
class Registry:
    """Repositories by name, and the footer tables of those that were indexed."""

    repositories: dict[str, Repository] = field(default_factory=dict)
    indexes: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, repository: Repository) -> None:
        if repository.name in self.repositories:
            raise ValueError(f"repository {repository.name} is there already")
        if repository.format not in SUFFIXES:
            raise ValueError(f"no reader for {repository.format}")
        if repository.format != "parquet" and not repository.schema:
            raise ValueError(f"{repository.name}: {repository.format} needs a schema")
        self.repositories[repository.name] = repository

    def index(self, spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
        """file, rows, column, low, high (as text), known of all Parquet files of a repository."""
        r = self.repositories[name]
        paths = r.matching([p for splits in r.configs.values() for p in splits.values()])
        self.indexes[name] = written(footers(spark, paths, columns), "footers")
        return self.indexes[name]

    def _kept(self, name: str, config: str, split: str, between: dict[str, tuple]) -> tuple[list[str], int]:
        files = self.repositories[name].files(config, split)
        if not between:
            return files, 0
        if name not in self.indexes:
            raise ValueError(f"{name} has no index: call index() first")
        out = F.lit(False)
        for column, (low, high) in between.items():
            kind = _kind(low if low is not None else high)
            under = F.lit(False) if low is None else F.coalesce(F.col("high").cast(kind) < F.lit(low), F.lit(True))
            over = F.lit(False) if high is None else F.coalesce(F.col("low").cast(kind) > F.lit(high), F.lit(True))
            out = out | ((F.col("column") == column) & F.col("known") & (under | over))
        gone = {f.file for f in self.indexes[name].where(out).select("file").distinct().collect()}  # files, not rows
        return [f for f in files if f not in gone], len(set(files) & gone)

    def skipped(self, name: str, config: str, split: str, between: dict[str, tuple]) -> tuple[int, int]:
        """(files read, files left out) of a load with these ranges."""
        kept, gone = self._kept(name, config, split, between)
        return len(kept), gone

    def load(self, spark: SparkSession, name: str, config: str, split: str, *, columns: list[str] | None = None, where: Column | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
        """Rows of a split: columns (all), where, and column -> (low, high), both included, None for open."""
        r, between = self.repositories[name], between or {}
        files, _ = self._kept(name, config, split, between)
        reader = spark.read.options(**r.options)
        if r.schema:
            reader = reader.schema(r.schema)
        df = reader.format(r.format).load(files) if files else reader.format(r.format).load(r.files(config, split)).limit(0)
        for column, (low, high) in between.items():
            df = df if low is None else df.where(F.col(column) >= F.lit(low))
            df = df if high is None else df.where(F.col(column) <= F.lit(high))
        df = df if where is None else df.where(where)
        return df.select(*[_flat(f.name, f.dataType) for f in df.schema if columns is None or f.name in columns])


def _kind(value: object) -> str:
    return {bool: "boolean", int: "decimal(38,0)", float: "double", str: "string"}.get(type(value), "timestamp_ntz" if hasattr(value, "hour") else "date")


def _flat(name: str, kind) -> Column:  # noqa: ANN001
    return F.to_json(F.col(name)).alias(name) if isinstance(kind, ArrayType | MapType | StructType | VariantType) else F.col(name)


def footers(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """file, rows, column, low, high, known: what each Parquet file's footer says of columns; null low and high of a known column are nulls alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["file"].to_pylist():
                fs, at = store(file)
                meta = pq.read_metadata(at, filesystem=fs)
                for column in columns:
                    yield pa.RecordBatch.from_pylist([{"file": file, "rows": meta.num_rows, "column": column, **_range(meta, column)}], _FOOTER)

    rows = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, min(len(paths) // 20, 10 * spark.sparkContext.defaultParallelism)))
    return rows.mapInArrow(run, "file string, rows long, column string, low string, high string, known boolean")


_FOOTER = pa.schema([("file", pa.string()), ("rows", pa.int64()), ("column", pa.string()), ("low", pa.string()), ("high", pa.string()), ("known", pa.bool_())])


def _range(meta: pq.FileMetaData, column: str) -> dict:
    low = high = None
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        chunk = next((c for c in (group.column(i) for i in range(group.num_columns)) if c.path_in_schema == column), None)
        stats = chunk.statistics if chunk is not None else None
        if stats is None or not (stats.has_min_max or (stats.has_null_count and stats.null_count == group.num_rows)):
            return {"low": None, "high": None, "known": False}
        if stats.has_min_max:
            low, high = stats.min if low is None else min(low, stats.min), stats.max if high is None else max(high, stats.max)
    text = lambda x: None if x is None else str(x)
    return {"low": text(low), "high": text(high), "known": True}
