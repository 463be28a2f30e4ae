"""Rules, structured texts, packing in parts and calibration records, by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import rules as R
from granary.functions import structured as S
from granary.operators import calibration, decontam, fixes, hygiene, metrics, near, packing, render, votes


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_dates(spark):
    day = F.lit("2024-01-31").cast("date")
    args = lambda n, unit: (day, F.lit(n), F.lit(unit))
    got = one(spark, *[f(*args(n, u)).cast("string") for f in (R.deadline, R.period_end) for n, u in ((1, "month"), (2, "week"), (10, "day"))], R.weekday(day, F.lit(1)))
    assert got == ["2024-02-29", "2024-02-14", "2024-02-10", "2024-02-28", "2024-02-13", "2024-02-09", "Thursday"]


def test_policies(spark):
    base = {"final_sale": False, "days": 10, "window": 30, "bonus": 5, "member": False, "opened": False, "sealed_only": True, "amount": 10, "limit": 100}
    cases = [({}, "approve"), ({"final_sale": True}, "deny"), ({"days": 31}, "deny"), ({"days": 35, "member": True}, "approve"), ({"opened": True}, "deny"), ({"opened": True, "sealed_only": False}, "approve"), ({"amount": 101}, "escalate"), ({"amount": 101, "days": 99}, "deny")]
    assert one(spark, *[R.refund(**{k: F.lit(v) for k, v in (base | c).items()}) for c, _ in cases]) == [w for _, w in cases]
    assert one(spark, R.bag_fee(F.lit("silver"), F.lit("economy"), F.lit(2), F.lit(6)), R.compensation(F.lit("delayed"), F.lit(3)), R.overlap(*map(F.lit, (1, 3, 3, 5))), R.model_size(F.lit("family-7.5B-chat")), R.model_size(F.lit("none"))) == [100, 150, False, "7.5B", None]
    assert one(spark, R.looks_german(F.lit("das ist nicht gut und ich weiß")), R.looks_german(F.lit("this is not german at all"))) == [True, False]


def test_structured(spark):
    raw = '{"a": "x y",  "x y": ["x y", 1.50, "z"]}'
    df = spark.createDataFrame([(raw, "one two three", "one 2 three four"), (None, None, "x"), ("plain", "a b", "b a")], "j string, a string, b string")
    got = df.select(S.substituted_udf({"x y": "neu"})("j"), S.edit_words_udf("a", "b"), S.rendered_state_udf("j")).collect()
    assert got[0][0] == '{"a": "neu",  "x y": ["neu", 1.50, "z"]}' and [r[1] for r in got] == [2, None, 2]
    assert got[0][2] == json.dumps(json.loads(raw), indent=1, ensure_ascii=False) and got[2][2] == "plain" and got[1][2] is None
    line = one(spark, S.edited_line(F.lit("a\nb\nc"), F.lit("a\nx\nc")), S.edited_line(F.lit("a\nb"), F.lit("x\ny")), S.edited_line(F.lit("a"), F.lit("a\nb")))
    assert tuple(line[0]) == ("b", "x") and line[1:] == [None, None]
    tool = lambda n, d: F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"))
    others = F.array(tool("getWeather", "forecast for a city"), tool("getStockPrice", "price of a share"), tool("WeatherTool", "other words"), tool("book_hotel", "reserve rooms near places"))
    assert one(spark, S.dissimilar(tool("fetchWeather", "weather forecast for some city"), others))[0] == ["book_hotel", "getStockPrice"]
    forms = spark.createDataFrame([("30 days", "within 30 days."), ("30", "300 units"), ("", "x"), (None, "x")], "form string, rest string")
    assert [r[0] for r in forms.select(S.leaked(F.col("form"), F.col("rest"))).collect()] == [True, False, False, False]


def test_packing_in_parts(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.randrange(1, 1100)) for s in range(3) for i in range(200)]
    how = {"buckets": (256, 1024), "budget": 4096, "slots": 8, "bins": 3, "best_fit": True}
    df = spark.createDataFrame(rows, "shard long, idx long, n long")
    whole = sorted(map(tuple, packing.pack(df, **how).collect()), key=str)
    a = packing.pack_part(df.where("idx < 77"), **how)
    b = packing.pack_part(df.where("idx >= 77"), state=a.where("state is not null").select("shard", "state"), **how)
    assert sorted((tuple(r)[:-1] for r in a.union(b).collect() if r.state is None), key=str) == whole
    placed = packing.pack(df, **how)
    steps = packing.accumulated(placed, 2).collect()
    assert steps and all(len(r.micros) == 2 for r in steps)
    sizes = {(r.shard, r.bucket): r.n for r in placed.where("micro is not null").groupBy("shard", "bucket").agg(F.countDistinct("micro").alias("n")).collect()}
    assert sum(n // 2 for n in sizes.values()) == len(steps)
    tokens = {1: [1, 1, 2, 0], 2: [1, 3], 3: [0, 1], 4: [2], 5: [0, 0], 6: [1, 2, 1]}
    bad = spark.createDataFrame([(r, i, s) for r, x in tokens.items() for i, s in enumerate(x)], "row long, pos long, segment long")
    assert sorted(r.row for r in packing.broken_rows(bad).collect()) == [2, 3, 4, 6]


def test_feature_temperatures(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        hot = float(i % 2)
        z = [rng.gauss(0, 2) for _ in range(3)]
        p = [math.exp(v / (4.0 if hot else 1.0)) for v in z]
        gold = rng.choices(range(3), p)[0]
        rows.append((z, gold, [hot, rng.random()]))
    df = spark.createDataFrame(rows, "logits array<double>, gold long, x array<double>")
    fit = calibration.fit_features(df, "x", ridge=0.1)
    log_t = lambda hot: fit["u"] + fit["w"][0] * (hot - fit["mean"][0]) / fit["std"][0] - fit["w"][1] * (fit["mean"][1] - 0.5) / fit["std"][1]
    assert fit["nll"] < fit["start"] and math.exp(log_t(1.0)) == pytest.approx(4.0, rel=0.25) and math.exp(log_t(0.0)) == pytest.approx(1.0, rel=0.25)
    assert calibration.fit_features(df.limit(0), "x")["w"] == []


def test_calibration_record():
    what = {"checkpoint": "c1", "data": "d", "template_version": 3, "backend": "b", "orders": 2, "noul_order": "shuffled"}
    a = calibration.artifact({"choice": 1.5}, **what)
    assert calibration.validated(a, checkpoint="c1", orders=2) == {"choice": 1.5}
    for broken, asked in ((a | {"temperatures": {"choice": 1.0}}, {}), (a, {"checkpoint": "c2"})):
        with pytest.raises(ValueError):
            calibration.validated(broken, **asked)
    with pytest.raises(ValueError):
        calibration.artifact({}, checkpoint="c")


def test_ranks_by_slices(spark):
    rng = random.Random(6)
    rows = [(i, "ab"[i % 2], rng.choice([0.0, 0.25, 1.0, rng.random()]), float(rng.random() < 0.5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, type string, conf double, hit double")
    for down in (False, True):
        got = {r.id: (r["rank"], r.before, r.rows) for r in metrics.ranked(df, ["type"], descending=down, slices=7).collect()}
        for t in "ab":
            mine = sorted((r for r in rows if r[1] == t), key=lambda r: (-r[2] if down else r[2], r[0]))
            total = 0.0
            for k, r in enumerate(mine):
                assert got[r[0]] == (k, total, len(mine))
                total += r[3]
    bins = {r.id: r.bin for r in metrics.equal_mass(df, ["type"], 7).collect()}
    assert sorted(sum(b == k for i, b in bins.items() if i % 2 == 0) for k in range(1, 8)) == [35, 35, 36, 36, 36, 36, 36]


def test_deep_trees_and_cycles(spark):
    chain = [(0, None), *[(i, i - 1) for i in range(1, 70)]]
    paths = votes.tree_paths(spark.createDataFrame(chain, "node long, parent long"))
    assert paths.count() == 70 and paths.agg(F.max("depth")).first()[0] == 69
    with pytest.raises(ValueError):
        votes.tree_paths(spark.createDataFrame([(1, None), (2, 1), (3, 2), (2, 3)], "node long, parent long"))


def test_near_reasons(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    edit = lambda t: " ".join("changed" if i == 60 else w for i, w in enumerate(t.split()))
    a, b, h = text(), text(), text()
    rows = [(1, a, "s"), (2, edit(a), "s"), (3, edit(a) + " end", "t"), (4, b, "s"), (5, b, "s"), (6, edit(h), "t"), (7, text() * 3, "t")]
    train = spark.createDataFrame([(i, t, s, i) for i, t, s in rows], "id long, state string, source string, ordinal long")
    held = spark.createDataFrame([(1, h)], "id long, state string")
    got = {r.id: r.reason for r in hygiene.clean_near(train, held, limit=300).collect()}
    assert got == {1: None, 2: "train_near_duplicate", 3: "train_cross_source_state", 4: None, 5: "duplicate", 6: "train_near_heldout", 7: "prompt_too_long"}


def test_exact_jaccard_finds_all(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    texts += [t + " w1" for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, state string")
    grams = lambda t: {tuple(t.split()[i : i + 2]) for i in range(max(len(t.split()) - 1, 1))}
    for threshold in (0.3, 0.8):
        want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if len(grams(a) & grams(b)) >= threshold * len(grams(a) | grams(b)) - 1e-12}
        assert {(r.id, r.ref) for r in near.exact_jaccard(df, df, n=2, threshold=threshold).collect()} == want


def test_named_sets_and_numbering(spark):
    words = " ".join(f"w{i}" for i in range(12))
    train = spark.createDataFrame([(1, words), (2, "other text of more than eight words in all here")], "id long, state string")
    sets = {"one": spark.createDataFrame([(7, words)], "id long, state string"), "two": spark.createDataFrame([(8, "nothing of the kind is in this set of words")], "id long, state string")}
    assert [(r.id, r.set, r.ref, r.shared) for r in decontam.gram_hits(train, decontam.named_ref_grams(sets)).collect()] == [(1, "one", 7, 5)]
    names = spark.createDataFrame([(f"n{i % 40}",) for i in range(80)], "name string")
    got = render.numbered(names).collect()
    assert sorted(r.number for r in got) == list(range(40))
    items = spark.createDataFrame([(1, "n3"), (2, "n9")], "id long, name string")
    for r in render.distractors(items, names, 3).collect():
        assert len(set(r.others)) == 3 and r.name not in r.others
    few = render.distractors(items.withColumn("name", F.lit("n0")), spark.createDataFrame([("n0",), ("n1",)], "name string"), 3)
    assert {tuple(r.others) for r in few.collect()} == {("n1",)}


def test_fixes(spark):
    french = "le chat est dans la maison et il ne veut pas que je sois avec lui pour la nuit"
    rows = [(1, "a\x01b &amp;#39;c&amp;#39;", "en"), (2, "say {'a': None, 'b': [1]} now", "en"), (3, french, "en"), (4, "plain", "en"), (5, None, None)]
    got = {r.id: (r.state, r.lang, r.fixes) for r in fixes.fixed_items(spark.createDataFrame(rows, "id long, state string, lang string"), retag=True).collect()}
    assert got == {1: ("ab 'c'", "en", ["state"]), 2: ('say {"a": null, "b": [1]} now', "en", ["state"]), 3: (french, "fr", ["lang:en->fr"]), 4: ("plain", "en", []), 5: (None, None, [])}
    texts = spark.createDataFrame([("{'level': 'low', 'definition': 'none of it'}",), ("['a', None, 'b']",), ("[not] one",), (None,)], "t string")
    assert [r[0] for r in texts.select(fixes.literal_text_udf("t")).collect()] == ["low: none of it", "a; b", "[not] one", None]
