"""Cases of single operators on literal rows."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.functions import keys as K
from granary.functions import probs as P
from granary.functions import text as T
from granary.operators import decontam, hygiene, metrics, mixture, near, packing, sampling, series, votes
from granary.sources import items as I  # noqa: E741
from granary.streaming import monitors


def one(df):
    return df.first()[0]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("text", "key"), [("  Ä-b_c!  D ", "ä b_c d"), ("", ""), ("!!!", "")])
def test_norm_key(spark, text, key):
    assert value(spark, T.norm_key(F.lit(text))) == key


def test_guess_lang(spark):
    en, fr = "the cat is on the mat and that was it", "le chat est sur la table et il ne part pas"
    assert [value(spark, T.guess_lang(F.lit(x))) for x in (en, fr, en + " " + fr, "x y")] == ["en", "fr", None, None]


@pytest.mark.parametrize(("text", "flags"), [("a &amp; b", ["html_entity"]), ("<b>x</b>", ["html_tag"]), ("bad � char", ["replacement_char"]), ("None", ["none_literal"]), ("see {'a': None}", ["none_literal", "python_repr"]), ("plain", [])])
def test_artefacts(spark, text, flags):
    assert value(spark, T.artefact_flags(F.lit(text))) == flags


def test_fixes(spark):
    df = spark.createDataFrame([("&amp;amp; x", "see {'a': None, 'b': [1]}!", "ﬁne  X")], "a string, b string, c string")
    r = df.select(T.unescape_udf("a"), T.repr_to_json_udf("b"), T.norm_text_udf("c"), T.chrf_udf("a", "a")).first()
    assert tuple(r) == ("& x", 'see {"a": null, "b": [1]}!', "fine x", 100.0)


@pytest.mark.parametrize(("text", "number"), [("$1,910", 1910.0), ("(12.5)", -12.5), ("87.04%", 87.04), ("n/a", None)])
def test_parse_number(spark, text, number):
    assert value(spark, T.parse_number(F.lit(text))) == number


def test_arrays(spark):
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    t = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert value(spark, P.argmax(F.array(F.lit(0.5), F.lit(0.5)))) == 0
    assert value(spark, P.nll(t, p)) == pytest.approx(-math.log(0.3))
    assert value(spark, P.brier(t, p)) == pytest.approx(0.04 + 0.25 + 0.49)
    assert value(spark, P.rps(p, F.lit(2))) == pytest.approx((0.2**2 + 0.7**2) / 2)
    assert value(spark, P.tvd(p, t)) == pytest.approx(0.7)
    assert sum(value(spark, P.softmax(F.array(F.lit(1000.0), F.lit(999.0))))) == pytest.approx(1)
    assert value(spark, P.vote_target(F.array(F.lit(3.0), F.lit(1.0)))) == pytest.approx([3.25 / 4.5, 1.25 / 4.5])
    assert value(spark, P.interpolated(F.lit(1.25), 3)) == pytest.approx([0, 0.75, 0.25])
    assert value(spark, P.rotate(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1))) == [2, 3, 1]
    assert value(spark, P.snap_policy(F.lit(0.6))) == pytest.approx(0.8, abs=1e-5)
    assert value(spark, P.snap_policy(F.lit(0.52), margin=0.05)) == 0.52


def test_splits(spark):
    parts = {r[0] for r in spark.range(200).select(K.part_of(F.col("id"))).collect()}
    assert parts == {"validation", "calibration", "test"}
    u = spark.range(2000).select(F.avg(K.hash01(F.col("id")))).first()[0]
    assert abs(u - 0.5) < 0.03


def test_near(spark):
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    changed = [*words[:100], "x", *words[101:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(other)), (4, "")], "id long, state string")
    s = near.signatures(df, "state", "id", perms=128)
    assert s.count() == 3
    pairs = near.near_pairs(s, bands=32)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    assert sorted(map(tuple, near.components(pairs).collect())) == [(1, 1), (2, 1)]


def test_near_work_is_whole(spark):
    """128 permutations in 32 bands by default: pairs at a similarity of 0.5 are candidates, at an error of 0.044."""
    rng = random.Random(0)
    base, other = [], []
    for i in range(100):
        words = [f"w{rng.randrange(10**9)}" for _ in range(160)]
        base.append((i, " ".join(words[:122])))
        other.append((1000 + i, " ".join(words[40:])))  # 80 of 160 shingles
    s, t = (near.signatures(spark.createDataFrame(x, "id long, state string"), "state", "id") for x in (base, other))
    assert s.selectExpr("min(size(sig))").first()[0] == 128
    js = [r.j for r in near.near_hits(t, s, threshold=0.3).where("id = ref + 1000").collect()]
    assert len(js) >= 80 and abs(sum(js) / len(js) - 0.5) < 0.05
    assert near.near_pairs(s.union(t), threshold=0.3).where("b = a + 1000").count() >= 80


def test_band_filter(spark, monkeypatch):
    """Rows that have a band in common with the index are all signed, whatever the filter's size; a filter of enough bits leaves out the others."""
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    index = [(i, text(40)) for i in range(50)]
    edited = [(1000 + i, x.rsplit(" ", i % 12)[0]) for i, x in index]
    others = [(2000 + i, text(1 + i % 40)) for i in range(400)] + [(9000, ""), (9001, None)]
    of = lambda x: spark.createDataFrame(x, "id long, state string")
    held = near.signatures(of(index), "state", "id").cache()
    every = near.signatures(of(edited + others), "state", "id")
    keys = lambda s: s.select("id", F.explode(near.band_keys(F.col("sig"))).alias("k"))
    met = {r.id for r in keys(every).join(keys(held).select("k"), "k").collect()}
    want = sorted(map(tuple, near.near_hits(every, held, threshold=0.5).collect()))
    assert len(met) > 40 and len(want) == 50
    for least, most, few in ((1 << 16, 1 << 22, True), (1, 4, False)):
        monkeypatch.setattr(near, "FILTER_WORDS", (least, most))
        some = near.signatures(of(edited + others), "state", "id", meets=near.band_filter(held))
        got = {r.id: r.sig for r in some.collect()}
        assert met <= set(got) and (len(got) < len(met) + 5) == few
        assert got == {r.id: r.sig for r in every.collect() if r.id in got}
        assert sorted(map(tuple, near.near_hits(some, held, threshold=0.5).collect())) == want
    none = near.band_filter(held.limit(0))
    assert near.signatures(of(edited), "state", "id", meets=none).count() == 0


def test_components_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    got = dict(map(tuple, near.components(pairs).collect()))
    assert {got[i] for i in range(21)} == {0} and got[31] == 30
    assert near.components(pairs.limit(0)).count() == 0


def test_hygiene(spark):
    long = "the quick brown fox jumps over the lazy dog and then it sleeps for a while"
    train = spark.createDataFrame([(1, long.upper()), (2, "different words that are long enough to be kept in the set"), (3, "different words, that are long enough to be kept in the set"), (4, "short"), (5, "damaged � text that is certainly long enough to be kept otherwise"), (6, "before " + long + " after")], "id long, state string").withColumn("ordinal", F.col("id")).withColumn("source", F.lit("s"))
    held = spark.createDataFrame([(1, long)], "id long, state string")
    got = {r.id: r.reason for r in hygiene.clean(train, held).collect()}
    assert got == {1: "equals_heldout", 2: None, 3: "duplicate", 4: "too_short", 5: "damaged", 6: "shares_8gram"}


def test_templates_are_not_hits(spark):
    same = "this exact instruction text is in every single reference row of the set"
    held = spark.createDataFrame([(i, f"{same} number{i}") for i in range(10)], "id long, state string")
    train = spark.createDataFrame([(1, same)], "id long, state string")
    assert decontam.gram_hits(train, decontam.ref_grams(held)).count() == 0


def test_sampling(spark):
    df = spark.range(1000).withColumn("source", F.when(F.col("id") < 900, "big").otherwise("small"))
    got = {r.source: r["count"] for r in sampling.cap_per_group(df, "source", 50).groupBy("source").count().collect()}
    assert got == {"big": 50, "small": 50}
    assert sampling.stratified(df, ["source"], 100).groupBy("source").count().orderBy("source").first()["count"] == 90
    c = spark.createDataFrame([("a", 90, 10), ("b", 50, 50), ("c", 5, 95)], "source string, yes long, no long")
    r = {x.source: (x.keep_yes, x.keep_no) for x in sampling.rebalance_quota(c).collect()}
    assert r["b"] == (50, 50) and r["a"] == (30, 10) and r["c"] == (5, 35)


def test_cap_epochs():
    w = mixture.cap_epochs({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100, most=2.0, blocks={"a": "x", "b": "x", "c": "y"})
    assert w["a"] == pytest.approx(0.2) and sum(w.values()) == pytest.approx(1)


def test_votes(spark):
    v = spark.createDataFrame([("m", "n", "a"), ("n", "m", "b"), ("n", "m", "tie")], "a string, b string, w string")
    assert tuple(votes.canonical_votes(v, "a", "b", F.col("w")).first()) == ("m", "n", 2, 0, 1)
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "node long, parent long")
    assert sorted(tuple(r.path) for r in votes.tree_paths(t).collect()) == [(1,), (1, 2), (1, 2, 3), (1, 4)]


def test_temperature_is_recovered(spark):
    import random

    rng, rows = random.Random(1), []
    for i in range(3000):
        z = [rng.gauss(0, 2) for _ in range(3)]
        e = [math.exp(x / 2.0) for x in z]
        rows.append((i, z, rng.choices(range(3), e)[0]))
    df = spark.createDataFrame(rows, "id long, logits array<double>, gold int")
    assert metrics.fit_temperature(df) == pytest.approx(2.0, rel=0.1)


def test_packing_invariants(spark):
    df = spark.createDataFrame([(i % 2, i, 1 + (i * 37) % 1200) for i in range(300)], "shard long, idx long, n long")
    for best_fit in (False, True):
        p = packing.pack(df, buckets=(256, 1024), budget=2048, slots=8, bins=3, best_fit=best_fit).toPandas().merge(df.toPandas(), on=["shard", "idx"])
        assert p[p.n > 1024].bucket.isna().all() and p[p.n <= 1024].bucket.notna().all()
        q = p.dropna().sort_values(["shard", "micro", "slot_row", "slot"])
        ends = (q.start + q.n).groupby([q.shard, q.micro, q.slot_row]).shift(1).fillna(0)
        assert (q.start == ends).all() and (q.start + q.n <= q.bucket).all()


def test_packer_resumes():
    sizes = [(i * 91) % 900 + 1 for i in range(200)]
    a = packing.Packer((256, 1024), 4096, 8, bins=3, best_fit=True)
    whole = [a.place(n) for n in sizes]
    b = packing.Packer((256, 1024), 4096, 8, bins=3, best_fit=True)
    first = [b.place(n) for n in sizes[:100]]
    c = packing.Packer((256, 1024), 4096, 8, bins=3, best_fit=True)
    c.restore(b.state())
    assert first + [c.place(n) for n in sizes[100:]] == whole


def test_spikes_stay_out_of_history():
    rule, kept = monitors.SpikeRule(), []
    flags = [rule.step(kept, v) for v in [1.0 + 0.01 * (i % 7) for i in range(20)] + [50.0, float("nan"), 1.05]]
    assert flags[-3:] == [True, True, False] and 50.0 not in kept and len(kept) == 21


def test_health(spark):
    falling, ones = [5 - i * 0.02 for i in range(120)], [1.0] * 120
    runs = {
        "falling": (falling, ones), "rising": (falling[::-1], ones), "blowup": (falling, [1.0] * 60 + [30.0] * 60), "nan": (falling[:50] + [float("nan")] * 5 + falling[55:], ones),
        "spiky": ([v + (40 if i % 10 == 9 and i > 20 else 0) for i, v in enumerate(falling)], ones), "back": (falling[:100] + [4.3] * 20, ones), "short": ([1.0, 2.0], [1.0, 1.0]),
    }
    df = spark.createDataFrame([(n, i, x, g, -1.0 if n == "falling" and i >= 60 else 1.0) for n, (xs, gs) in runs.items() for i, (x, g) in enumerate(zip(xs, gs, strict=True))], "run string, step long, loss double, grad double, cos double")
    got = {(r.run, r.rule): (r.level, r["at"]) for r in monitors.fired(df, "run", "step", "loss", "grad", cosine="cos").collect()}
    assert got[("falling", "momentum_against_gradient")] == ("warn", 110)
    assert {k for k in got if k[0] == "falling"} == {("falling", "momentum_against_gradient")}
    assert got[("rising", "loss_above_start")] == ("kill", 40)
    assert got[("blowup", "grad_blowup")] == ("kill", 70)
    assert got[("nan", "non_finite")] == ("kill", 53)
    assert got[("spiky", "loss_spikes")] == ("kill", 100) and got[("back", "loss_regression")][0] == "warn"
    status = {r.run: (r.status, r.rules) for r in monitors.health(df, "run", "step", "loss", "grad").collect()}
    assert status["short"] == status["falling"] == ("ok", "{}") and status["blowup"] == ("kill", '{"grad_blowup":"kill"}')


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k long, t long, name string")
    right = spark.createDataFrame([(1, 2, 10.0), (1, 5, 20.0), (2, 10, 30.0)], "k long, t long, v double")
    got = {r.name: r.found_v for r in series.as_of(left, right, "k", "t", "name").collect()}
    assert got == {"a": 20.0, "b": None, "c": None}


def test_items(spark):
    good = {"id": "1", "state": "s", "question": {"type": "choice", "instructions": "?", "criteria": {"z": "last", "a": "first"}}, "expected": "a"}
    score = {"id": "2", "state": {"k": [1]}, "question": {"type": "score", "criteria": ["low", "high"]}, "target": {"0": 0.25, "1": 0.75}}
    cases = [good, score, good | {"expected": "q"}, good | {"state": " "}, score | {"target": {"0": 0.2, "1": 0.3}}, {"id": "6", "state": "s", "question": {"type": "what"}}, good | {"license_use": "x"}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases] + [("not json",)], "line string")
    got = I.parse_items(df).collect()
    assert [r.reject_reason for r in got] == [None, None, "expected_unknown", "empty_state", "probability_sum", "unknown_type", "license_use", "not_json"]
    assert got[0].labels == ["z", "a"] and got[0].target == [0.0, 1.0] and got[0].descriptions == ["last", "first"]
    assert got[1].labels == ["0", "1"] and got[1].target == [0.25, 0.75] and json.loads(got[1].state) == {"k": [1]}
    assert I.strings_of({"a": '["x", {"b": "y"}]', "c": ["z"]}) == ["x", "y", "z"]


def test_items_round_trip(spark, tmp_path):
    line = json.dumps({"id": "1", "state": "s t", "question": {"type": "noul", "instructions": "?", "criteria": {"false": "n", "true": "y"}}, "expected": True})
    df = I.parse_items(spark.createDataFrame([(line,)], "line string"))
    I.write_lines(df, f"{tmp_path}/out")
    back = I.parse_items(I.read_lines(spark, f"{tmp_path}/out")).first()
    assert back.reject_reason is None and back.target == [0.0, 1.0] and back.state == "s t"


def test_microbatches(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, t + timedelta(seconds=i if i < 70 else 9999)) for i in range(72)], "shard long, id long, ts timestamp")
    got = [r.n for r in monitors.microbatches(df, "id", 64, 60, "ts", "shard").orderBy("batch").collect()]
    assert got == [61, 9, 2]


def test_gram_hashes_of_whole_batches():
    """The vectorized hashes against hashlib, at the edges of a block of MD5, too, and the minima against the formula."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    from granary.operators import near, shingles

    rows = [["a"], [], None, ["a", "b"], ["é" * 9, "ß" * 9, "日本", "x"], *[["y" * n, "z"] for n in range(40, 70)], [f"w{i % 50}" for i in range(20_000)]]
    kind = pa.list_(pa.field("element", pa.string(), nullable=False))
    grams = [[] if not w else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)] for w in rows]
    want = [[int(hashlib.md5(g.encode()).hexdigest()[:7], 16) for g in gs] for gs in grams]
    got, counts = shingles.gram_hashes(pa.array(rows, kind), 3)
    assert counts.tolist() == [len(x) for x in want] and got.tolist() == [h for x in want for h in x]
    part, _ = shingles.gram_hashes(pa.array(rows, kind).slice(3), 3)
    assert part.tolist() == [h for x in want[3:] for h in x]
    least = near.minima(got, counts[counts > 0], 128)
    assert least.tolist() == [[min((a * h + b) % near.PRIME for h in set(x)) for a, b in near.coefficients(128)] for x in want if x]
    assert shingles.gram_hashes(pa.array([[], None], kind), 3)[0].size == 0 and near.minima(np.empty(0, np.uint32), np.empty(0, np.int64), 128).shape == (0, 128)


def test_signatures_of_parts_of_a_batch(spark, monkeypatch):
    from pyspark.sql import functions as F

    from granary.operators import near

    df = spark.createDataFrame([(i, None if i % 7 == 3 else [f"w{(i * j) % 11}" for j in range(i % 9)]) for i in range(50)], "id long, w array<string>").coalesce(1)
    sigs = lambda: {r.id: r.sig for r in df.select("id", near.signature(F.col("w")).alias("sig")).collect()}
    whole = sigs()
    assert all(len(s) == (0 if i % 7 == 3 or i % 9 == 0 else near.PERMS) for i, s in whole.items())
    from granary.operators.shingles import gram_hashes
    import pyarrow as pa

    assert whole[8] == near.minima(*gram_hashes(pa.array([[f"w{(8 * j) % 11}" for j in range(8)]], pa.list_(pa.string())), 3), near.PERMS)[0].tolist()
    assert df.where("false").select(near.signature(F.col("w")).alias("sig")).count() == 0


def test_guess_lang_counts_whole_words(spark):
    """Apostrophes around a word are no part of it, letters beside it are; Arrow batches of tables are bounded by bytes."""
    from granary.sources.tables import table

    texts = ["''the' and the and'' the 'is", "the,the the-l'the the'x is is is is", "le la les et est été", "les lesx xles thé", "'" * 5000]
    assert [value(spark, T.guess_lang(F.lit(x), min_hits=5)) for x in texts] == ["en", "en", "fr", None, None]
    table(spark, "/root/testdata/sf0.001", "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(16 << 20)
    assert T.guess_lang("t")._jc.toString().count("transform") == 0
