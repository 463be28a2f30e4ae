"""Stores, catalogue, whole jobs and calibrators."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import translation as X
from granary.functions.keys import group_held_out
from granary.operators import calibration, campaign, decontam, hygiene
from granary.plans import build
from granary.sources import adapters, store


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.stage(spark, f"file://{tmp_path}", "s", {"b": 1, "a": 2}, make).count() == 3
    assert len(calls) == 1
    store.stage(spark, f"file://{tmp_path}", "s", {"b": 2}, make)
    assert len(calls) == 2


def test_canonical_fingerprint():
    assert store.canonical({"b": 1, "a": [1, "é"]}) == '{"a":[1,"é"],"b":1}'
    assert store.fingerprint({"a": 1, "b": 2}) == store.fingerprint({"b": 2, "a": 1})
    assert store.flattened({"a": {"b": 1, "c": {"d": 2}}}) == {"a/b": 1.0, "a/c/d": 2.0}


def test_dump_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", [0.123456789, 1.0], [0.25, 0.75])], "id string, logits array<double>, p array<double>")
    store.write_dump(df, f"{tmp_path}/dump")
    assert tuple(store.read_dump(spark, f"{tmp_path}/dump", "id string, logits array<double>, p array<double>").first()) == ("1", [0.123457, 1.0], [0.25, 0.75])
    assert store.file_hashes(spark, f"{tmp_path}/dump/*.gz").count() >= 1


def test_manifest(spark):
    m = store.manifest(spark.createDataFrame([("a", "en"), ("a", "fr"), ("b", None)], "source string, lang string"))
    assert m["rows"] == 3 and m["sources"]["a"]["lang"] == {"en": 1, "fr": 1}


def test_latest_metrics(spark):
    log = spark.createDataFrame([("r", 1, "loss", 2.0, 0), ("r", 1, "loss", 1.5, 1), ("r", 9, "loss", 1.0, 2)], "run string, step long, name string, value double, seq long")
    assert [tuple(r) for r in store.latest_metrics(log, F.lit(5)).collect()] == [("r", 1, "loss", 1.5)]


def test_catalogue(spark):
    c = adapters.Catalogue()
    a = adapters.yes_no("id", F.col("t"), F.col("y"), "Good?")
    c.register(adapters.Source("s", lambda s: s.createDataFrame([(1, "some text", True), (2, "?", True), (3, "more text", None)], "id long, t string, y boolean"), a, block="b"))
    with pytest.raises(ValueError, match="there already"):
        c.register(c.sources["s"])
    with pytest.raises(ValueError, match="unknown"):
        c.select(["nope"])
    got = c.load(spark, "s").collect()
    assert [(r.id, r.target, r.source) for r in got] == [("s-1", [0.0, 1.0], "s")]
    assert [s.name for s in c.select(blocks=["b"])] == ["s"]


def test_menu_other(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, g string")
    names = F.array(*[F.lit(x) for x in "abcdef"])
    got = {r.id: r for r in adapters.menu("id", F.lit("s"), F.col("g"), names, "?", size=3, other="none of these")(df).collect()}
    assert len(got["1"].labels) == 4 and got["1"].labels[got["1"].target.index(1.0)] == "a"
    assert got["2"].labels[-1] == "none of these" and got["2"].target[-1] == 1.0


def test_build_and_extend(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(f"{w}x{k}" for w in words)
    items = spark.createDataFrame([(i, text(i // 2), f"s{i % 3}", "en", i) for i in range(60)], "id long, state string, source string, lang string, ordinal long")
    bench = spark.createDataFrame([(1, text(0))], "id long, state string")
    m = build.build_mix(items, bench, cap=5)
    train, held = m["train"], m["held"]
    assert train.join(held, "state", "left_semi").count() == 0 and train.where(F.col("state") == text(0)).count() == 0
    assert train.groupBy("source").count().agg(F.max("count")).first()[0] <= 5
    more = spark.createDataFrame([(100, text(5) + " tail", "new", "en", 100), (101, text(99), "new", "en", 101), (102, text(0), "new", "en", 102)], items.schema)
    base = items.where("id < 20 and id >= 10")
    assert sorted(r.id for r in build.extend_mix(base, more, bench).where("source = 'new'").collect()) == [101]


def test_build_makes_no_pairs_and_finds_reasons_once(spark):
    # each of 30 frames is in many rows of both parts, and no template: pairs of such rows grow with their square
    frame = lambda k: " ".join(f"f{k}x{j}" for j in range(9))
    rows = [(i, f"{frame(i % 30)} own{i} text{i}", f"s{i % 3}", "en", i) for i in range(600)]
    rows += [(1000 + i, " ".join(f"k{i}x{j}" for j in range(12)), f"s{i % 3}", "en", i) for i in range(300)]
    rows += [(2000, None, "s0", "en", 2000), (2001, "", "s1", "en", 2001), (2002, "\u00c3\u00a9 damaged " + "word " * 20, "s1", "en", None), (2003, "k1x1", "s2", "en", 2003)]
    rows += [(2004, "twice the same id " + "a" * 60, "s0", "en", 2004), (2004, "twice the same id", "s0", "en", 2004), (2004, "twice the same ID! " + "A" * 60, "s0", "en", 2005)]
    items = spark.createDataFrame(rows, "id long, state string, source string, lang string, ordinal long")
    bench = spark.createDataFrame([(1, "an item of a benchmark that no row has, with words enough")], "id long, state string")
    m = build.build_mix(items, bench)
    against = m["held"].select("id", "state").unionByName(bench)
    rest = items.where(~group_held_out(F.col("id"), 100))
    assert m["held"].count() + rest.count() == len(rows)
    limit = max(5, math.ceil(0.01 * against.count()))
    keys = against.select(F.md5(T.norm_key("state")).alias("key")).distinct().withColumn("equal", F.lit(1))
    hit = decontam.gram_hits(rest, decontam.ref_grams(against)).select("id").distinct().withColumn("hit", F.lit(1))
    plain = rest.withColumn("key", F.md5(T.norm_key("state"))).join(keys, "key", "left").join(hit, "id", "left").withColumn("reason", F.expr(
        r"CASE WHEN equal = 1 THEN 'equals_heldout' WHEN hit = 1 THEN 'shares_8gram' WHEN length(regexp_replace(state, r'[^\p{L}\p{N}_]', '')) < 40 THEN 'too_short' WHEN contains(state, '\u00c3\u00a9') THEN 'damaged' END"))
    want = hygiene.without_duplicates(plain).select("id", "state", "source", "reason").collect()
    assert limit == 5 and sum(r.reason == "shares_8gram" for r in want) > 100
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, m["train"].select("id", "state", "source").collect()), key=order) == sorted(((r.id, r.state, r.source) for r in want if r.reason is None), key=order)
    assert {(r.source, r.reason): r.n for r in m["drops"].collect()} == Counter((r.source, r.reason) for r in want if r.reason)
    plan = hygiene.reasons(rest, against)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "ref#" not in plan
    assert m["drops"].inputFiles() and all("/reasons" in f for f in m["drops"].inputFiles())
    counted = hygiene.reasons(rest, against).groupBy("source", "reason").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "state#" not in counted[: counted.index("Join")]


@pytest.mark.parametrize("n", [1, 3, 8])
def test_gram_hashes_are_those_of_arrays(spark, n):
    w = F.split(F.lit("a b c d e f g h i a b c d e f g h i é"), " ")
    got, want = spark.range(1).select(T.gram_hashes(w, n), F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n))))).first()
    assert got == want


def test_short_and_damaged_at_their_edges(spark):
    rows = [("a" * 39,), ("a" * 40,), ("-" * 1000 + "a" * 39,), ("-" * 1000 + "a" * 40,), ("é!" * 40,), ("",), (None,), ("Â word Ã",), ("don\u00e2\u20ac\u2122t",), ("\u00c2\u00a0",), ("\ufffd",)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string")
    got = df.select("i", hygiene.too_short("t", 40), T.damaged("t")).orderBy("i").collect()
    assert [r[1] for r in got] == [True, False, True, False, False, True, None, True, True, True, True]
    assert [r[2] for r in got] == [False] * 6 + [None, False, True, True, True]


def test_platt(spark):
    import random

    rng = random.Random(0)
    rows = [(s, float(rng.random() < 1 / (1 + math.exp(-(0.5 * s + 0.3))))) for s in (rng.gauss(0, 3) for _ in range(4000))]
    a, b = calibration.platt(spark.createDataFrame(rows, "s double, y double"), "s", "y")
    assert a == pytest.approx(0.5, abs=0.06) and b == pytest.approx(0.3, abs=0.1)


def test_closure_and_queue(spark):
    needs = spark.createDataFrame([("c", "b"), ("b", "a")], "job string, after string")
    assert sorted(map(tuple, campaign.closure(needs).collect())) == [("b", "a"), ("c", "a"), ("c", "b")]
    jobs = spark.createDataFrame([("a", "done"), ("b", "new"), ("c", "new"), ("d", "new")], "job string, status string")
    assert sorted(r.job for r in campaign.ready(jobs, needs).collect()) == ["b", "d"]


@pytest.mark.parametrize(("src", "dst", "verdict"), [
    ("Pay 1,200 to ACME now", "Payez 1200 à ACME ici", "ok"), ("Pay 12", "", "empty"), ("Pay 12", "Payez 13", "quantities"), ("Ask ACME today", "Demandez à elle", "entities"),
    ("a <b>bold</b> word", "un mot gras ici", "markup"), ("short", "a very much longer text than before", "length"),
])
def test_translation_gate(spark, src, dst, verdict):
    assert spark.range(1).select(X.verdict(F.lit(src), F.lit(dst))).first()[0] == verdict
