"""Ordered keep-first among near duplicates against a sequential walk, at once and in batches; the chain built on it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.functions import structured as S
from granary.operators import decontam, hygiene, keepfirst, near
from granary.operators.tables import work_path


@pytest.fixture(scope="module")
def planted(spark):
    """500 rows with chains of edits, copies, several questions on one passage, several origins."""
    rng = random.Random(4)
    pool = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(60)]
    rows = []
    for i in range(500):
        w = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            pool.append(w)
        rows.append((i, " ".join(w), rng.choice(["a", "b", None]), rng.choice(["q1", "q2", None])))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, k // 2) for k, r in enumerate(rows)], "id long, state string, origin string, question string, ord long")  # ties of ord: by id
    sig = near.signatures(df, "state", "id", "origin", "question", "ord").cache()
    kept, verdict = [], {}
    for r in sorted(sig.collect(), key=lambda r: (r.ord, r.id)):
        by = [k for k in kept if sum(x == y for x, y in zip(k.sig, r.sig, strict=True)) >= 0.8 * 128]
        verdict[r.id] = "same" if any(k.question == r.question for k in by) else "cross" if any(k.origin != r.origin for k in by) else None
        if verdict[r.id] is None:
            kept.append(r)
    assert min(Counter(verdict.values()).values()) > 50
    return sig, verdict


@pytest.mark.parametrize("few", [0, 60, 3_000])
def test_decide(planted, few):
    sig, verdict = planted
    assert {r.id: r.near for r in keepfirst.decide(sig, few=few).collect()} == verdict


def test_rounds_stay_few_where_a_bucket_is_not_near(spark, monkeypatch):
    """60 rows share a band and are else unlike but for each fifth, an edit of the one before: a round a row, without links."""
    rng, sigs, rounds = random.Random(5), [], []
    for i in range(60):
        sigs.append([1, 2, 3, 4] + (sigs[-1][4:120] + [rng.randrange(2**31) for _ in range(8)] if i % 5 == 4 else [rng.randrange(2**31) for _ in range(124)]))
    df = spark.createDataFrame([(i, i, x, "q", "o") for i, x in enumerate(sigs)], "id long, ord long, sig array<long>, question string, origin string")
    plain = keepfirst.written
    monkeypatch.setattr(keepfirst, "written", lambda frame, name: (rounds.append(name), plain(frame, name))[1])
    monkeypatch.setattr(keepfirst, "BLOCK", 7)
    got = {r.id: r.near for r in keepfirst.decide(df, few=1).collect()}
    assert got == {i: "same" if i % 5 == 4 else None for i in range(60)}
    assert rounds.count("leaders") < 4 and rounds.count("links") > 0


def _texts(*columns):
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in columns]


def test_decide_in_batches(spark, planted):
    sig, verdict = planted
    index, got = keepfirst.KeptIndex(spark, work_path(spark, "kept")), {}
    for b in range(3):
        part = sig.where(f"ord >= {b * 90} and (ord < {(b + 1) * 90} or {b} = 2)")
        found = {r.id: r.near for r in keepfirst.decide(part, index=index, few=30).collect()}
        got |= found
        index.append(part.where(F.col("id").isin([i for i, v in found.items() if v is None])).select(near.signature_id(F.col("sig")).alias("sid"), "sig", *_texts("question", "origin"), F.lit("").alias("exact")))
    assert got == verdict
    alone = keepfirst.decide(sig.where("ord >= 180"), index=index, within=False).collect()  # all of these rows are in the index or near it
    assert all(r.near is not None or verdict[r.id] is None for r in alone) and keepfirst.decide(sig.limit(0), index=index).count() == 0


def words(rng, n=40):
    return [f"v{rng.randrange(10**6)}" for _ in range(n)]


def test_chain_compares_with_kept_rows_only(spark):
    rng = random.Random(9)
    a, b, c, passage, held = (words(rng) for _ in range(5))
    edit = lambda w, *at: " ".join("new" + str(i) if i in at else x for i, x in enumerate(w))
    rows = [
        (1, edit(a) + " �", "s", "q"), (2, edit(a, 0), "s", "q"),  # the first is damaged: its near copy stays
        (3, edit(b), "s", "q"), (4, edit(b, 0, 39), "s", "q"), (5, edit(b, 0, 1, 38, 39), "s", "q"), (6, edit(b, 0, 1, 2, 37, 38, 39), "s", "q"),
        (7, edit(passage), "s", "q1"), (8, edit(passage), "s", "q2"), (9, edit(passage), "t", "q3"), (10, edit(passage), "t", "q1"), (11, edit(passage, 5), "s", "q2"),
        (12, edit(held), "s", "qh"), (13, edit(held, 0), "s", "qh"), (14, edit(held), "s", "q"), (15, edit(held, 0), "s", "q"),
        (16, "in front " + " ".join(held[:12]) + " " + edit(c), "s", "q"), (17, None, "s", "q"), (18, edit(words(rng, 900)), "s", "q"),
    ]
    train = spark.createDataFrame([(*r, r[0]) for r in rows], "id long, state string, source string, q string, ordinal long")
    against = spark.createDataFrame([(1, edit(held), "qh")], "id long, state string, q string")
    got = {r.id: r.reason for r in hygiene.clean_near(train, against, question="q", limit=800).collect()}
    want = {
        1: "damaged", 2: None, 3: None, 4: "train_near_duplicate", 7: None, 8: None, 9: "train_cross_source_state", 10: "duplicate", 11: "train_near_duplicate",
        12: "equals_heldout", 13: "train_near_heldout", 14: "train_state_in_heldout", 15: "train_state_near_heldout", 16: "shares_8gram", 18: "prompt_too_long",
    }
    assert {k: got[k] for k in want} == want and len(got) == len(rows)
    assert got[6] is None or got[5] is not None  # a chain: what is near a dropped row alone stays


def test_reference_sets_and_frames(spark):
    frame = "this frame of words stands in front of every single row"
    refs = decontam.named_ref_grams({"b": spark.createDataFrame([(1, f"{frame} of the set")], "id long, state string"), "a": spark.createDataFrame([(1, "one two three four five six seven eight nine")], "id long, state string")}, least=5)
    rows = [(i, f"{frame} {i} {i} {i}", "s") for i in range(30)] + [(40, "zero one two three four five six seven eight", "s"), (41, f"{frame} too", "t"), (42, f"{frame} one two three four five six seven eight", "t")]
    train = spark.createDataFrame(rows, "id long, state string, source string")
    assert dict(map(tuple, hygiene.set_hits(train, refs).collect())) == {40: "a", 41: "b", 42: "a"}
    assert dict(map(tuple, hygiene.set_hits(train.where("id < 5"), refs, frames=train).collect())) == {}
    assert len(hygiene.set_hits(train.where("id < 5"), refs).collect()) == 5


def test_own_frames_are_found_once_for_all_batches(spark):
    frame = "this frame of words stands in front of every single row"
    refs = decontam.named_ref_grams({"b": spark.createDataFrame([(1, f"{frame} of the set")], "id long, state string")}, least=5)
    train = spark.createDataFrame([(i, f"{frame} {i} {i} {i}", "s") for i in range(30)] + [(41, f"{frame} too", "t")], "id long, state string, source string")
    own = hygiene.own_frames(train, refs)
    assert dict(map(tuple, hygiene.set_hits(train.where("id < 5 or id = 41"), refs, own=own).collect())) == {41: "b"}


def test_near_hits_with_key_and_tag(spark):
    rng = random.Random(2)
    w = words(rng)
    q = spark.createDataFrame([(1, " ".join(w), "x", "s"), (2, " ".join(w), None, "s"), (3, " ".join(w), "y", None)], "id long, state string, k string, t string")
    i = spark.createDataFrame([(10, " ".join(w[:39] + ["z"]), "x", "s"), (11, " ".join(w), None, None)], "id long, state string, k string, t string")
    a, b = (near.signatures(df, "state", "id", "k", "t") for df in (q, i))
    pairs = lambda **o: sorted((r.id, r.ref) for r in near.near_hits(a, b, **o).collect())
    assert pairs() == [(x, y) for x in (1, 2, 3) for y in (10, 11)]
    assert pairs(key="k") == [(1, 10), (2, 11)] and pairs(tag="t") == [(1, 11), (2, 11), (3, 10)]


def test_token_distance():
    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, old = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        return row[-1]

    rng = random.Random(3)
    for _ in range(500):
        k = rng.choice([2, 3, 30])
        x, y = ([str(rng.randrange(k)) for _ in range(rng.randrange(25))] for _ in range(2))
        assert S.token_distance(x, y) == plain(x, y)
    assert S.token_distance([str(i) for i in range(20_000)], [str(i) for i in range(3, 20_003)]) == 6


def test_leaked(spark):
    rows = [("a.b", "xa.b a.b", True), ("a.b", "axb", False), ("c\\E+", "see c\\E+ here", True), ("é", "été é", True), ("é", "été", False), ("", "x", False), (None, "x", False), ("x", None, False)]
    df = spark.createDataFrame(rows, "form string, rest string, want boolean")
    assert all(r.want == r.got for r in df.select("want", S.leaked(F.col("form"), F.col("rest")).alias("got")).collect())


@pytest.mark.parametrize("n", [1, 3])
def test_exact_jaccard_finds_all(spark, n):
    rng = random.Random(n)
    rows = lambda k: [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(14)))) for i in range(k)]
    left, right = rows(120), rows(60)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}

    for threshold in (0.3, 0.8, 1.0):
        pairs = [(a, b, shingles(t), shingles(u)) for a, t in left for b, u in right]
        want = sorted((a, b) for a, b, x, y in pairs if x and y and len(x & y) / len(x | y) >= threshold)
        got = near.exact_jaccard(*(spark.createDataFrame(x, "id long, state string") for x in (left, right)), n=n, threshold=threshold)
        assert sorted((r.id, r.ref) for r in got.collect()) == want and want
