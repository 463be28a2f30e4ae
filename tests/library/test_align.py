"""Restoring a thinned file against brute force on planted deletions, insertions, moves and repeats."""

import itertools
import random

import pytest

from granary.operators import align


def brute(full, thinned):
    """The same by definition on lists: full of lines, thinned of (at, line)."""
    unique = lambda xs: {x for x in xs if xs.count(x) == 1}
    both = unique(full) & unique([x for _, x in thinned])
    pairs = sorted((at, full.index(x)) for at, x in thinned if x in both)
    chain = [pairs[k] for k in align.longest_chain([i for _, i in pairs])]
    out = {at: (x, False) for at, x in thinned}
    for (a0, i0), (a1, i1) in itertools.pairwise([(-1, -1), *chain]):
        inside = {a0 + n: full[i0 + n] for n in range(1, i1 - i0)}
        if i1 - i0 == a1 - a0 and all(inside[at] == x for at, x in thinned if a0 < at < a1):
            out |= {at: (x, True) for at, x in inside.items() if at not in out}
    return sorted((at, *v) for at, v in out.items())


@pytest.mark.parametrize("seed", range(4))
def test_realigned(spark, seed):
    rng = random.Random(seed)
    original = [f"line {i}" if rng.random() < 0.8 else f"same {rng.randrange(4)}" for i in range(rng.choice([60, 300]))]
    thinned = [(i, x) for i, x in enumerate(original) if rng.random() < 0.5]
    full = list(original)
    for _ in range(rng.randrange(1, 8)):
        k = rng.randrange(len(full))
        what = rng.randrange(3)
        if what == 0:
            full.insert(k, rng.choice(["new " + str(rng.random()), "same 1"]))
        elif what == 1:
            del full[k]
        else:
            full.insert(rng.randrange(len(full)), full.pop(k))
    f = spark.createDataFrame(list(enumerate(full)), "i long, line string").repartition(3)
    t = spark.createDataFrame(thinned, "at long, line string").repartition(2)
    got = sorted(map(tuple, align.realigned(f, t).collect()))
    assert got == brute(full, thinned) and sum(r[2] for r in got) > 5
    assert all(original[at] == line for at, line, restored in got if not restored)


def test_same_build_restores_all_between(spark):
    lines = [f"l{i % 90}" for i in range(100)]
    f = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(lines) if i % 3 == 0 or i == 89], "at long, line string")
    assert sorted((r.at, r.line) for r in align.realigned(f, t).collect() if r.at < 90) == list(enumerate(lines))[:90]
    assert align.realigned(f, t.limit(0)).count() == 0 and align.realigned(f.limit(0), t).count() == t.count()


def test_longest_chain():
    rng = random.Random(5)
    for _ in range(200):
        v = rng.sample(range(30), rng.randrange(9))
        best = max((len(c) for n in range(len(v) + 1) for c in itertools.combinations(v, n) if list(c) == sorted(c)), default=0)
        got = [v[i] for i in align.longest_chain(v)]
        assert got == sorted(got) and len(got) == best


def test_running_values_over_parts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    v = [rng.choice([None, rng.randrange(100)]) for _ in range(200)]
    x = align.in_parts(spark.createDataFrame(list(enumerate(v)), "o long, v long").repartition(5), "o")
    assert x.select("part").distinct().count() > 1
    for kind, f in (("max", max), ("min", min), ("sum", sum), ("last", lambda s: s[-1])):
        for back in (False, True):
            got = {r.o: r.r for r in align.running(x, "o", "r", F.col("v"), kind, back=back).collect()}
            for i in range(200):
                seen = [y for y in (v[i:][::-1] if back else v[: i + 1]) if y is not None]
                assert got[i] == (f(seen) if seen else 0 if kind == "sum" else None)
