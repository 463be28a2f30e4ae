"""Every query of the library runs, and gives what its SQL gives in DuckDB."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from granary.plans import catalog

ORACLE = catalog.oracle_sql()


def rows(frame, columns):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([plain(x) for x in v])
        return str(int(v)) if isinstance(v, bool) else str(v)

    return sorted(tuple(plain(r[c]) for c in columns) for r in frame.to_dict("records"))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


#: Queries that the smallest tables leave empty or nearly so, and what they must have on larger ones.
LARGER = ("text_counters", "german_rows", "conflicting_labels", "artefact_flags_by_source", "damaged_rows", "template_grams", "named_set_hits", "near_hits_vs_benchmark", "near_hits_keyed", "state_elsewhere", "generate_invoice_total", "clean_v7", "trace_scopes", "realigned_lines")


@pytest.mark.parametrize("name", LARGER)
def test_query_on_larger_tables(spark, name):
    at = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for f in os.listdir(at):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}/{f}')")
    got, want = catalog.queries()[name](spark, at).toPandas(), c.sql(ORACLE[name]).df()
    assert len(want) and rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_near_hits_vs_benchmark_writes_little(spark):
    """Signatures of lines that are near no line of the benchmark aren't written: 1 KB each, several times what the documents take."""
    at = "/root/testdata/sf0.01"
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    files = lambda: {p: p.stat().st_size for p in shared.rglob("*.parquet")} if shared.exists() else {}
    before = files()
    assert catalog.queries()["near_hits_vs_benchmark"](spark, at).count() == 28
    assert sum(n for p, n in files().items() if p not in before) < os.path.getsize(f"{at}/documents.parquet") / 2


def test_entry_module():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
