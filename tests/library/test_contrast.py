"""Contrastive groups: each check violated by a planted group, and groups whole or not at all."""

import datetime
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from granary.operators import contrast as C

DAY = datetime.date(2024, 3, 5)
GOOD = C.return_group({"key": 999, "day": DAY, "customer": 7}, random.Random(1))


def line(tag, **changes):
    return replace(next(x for x in GOOD.lines if x.tag == tag), **changes)


def swapped(x):
    return replace(GOOD, lines=tuple(x if y.tag == x.tag else y for y in GOOD.lines))


PLANTED = {
    None: GOOD,
    "unsolved": swapped(line("bought", facts={})),
    "same_label": replace(GOOD, changed=line("returned")),
    "edit": replace(GOOD, changed=replace(GOOD.changed, text="Some quite other words that say when it came back to us: " + GOOD.changed.text)),
    "decidable:order": replace(GOOD, evidence=("order",)),
    "decidable:policy": swapped(line("order", facts=line("policy").facts)),
    "leaked:policy": swapped(line("order", text=f"Order of {line('policy').forms[0]} pieces.")),
    "leaked:returned": replace(GOOD, question=f"Is {line('returned').forms[0]} in time?"),
}


@pytest.mark.parametrize("why", PLANTED, ids=str)
def test_checks(why):
    assert C.rejected(PLANTED[why], C.in_time) == why


def test_edit_of_two_lines():
    twice = replace(GOOD, lines=(*GOOD.lines, GOOD.lines[-1]))
    assert C.rejected(replace(twice, evidence=("policy",)), C.in_time) == "edit"
    assert C.rejected(GOOD, C.in_time, max_edit=0) == "edit"


def test_groups_are_whole(spark):
    rows = [(i, DAY + datetime.timedelta(i), i % 70) for i in range(200)]
    worlds = spark.createDataFrame(rows, "key long, day date, customer long").repartition(3)
    got = C.contrastive(worlds, "key", C.return_group, C.in_time, tries=6).collect()
    assert sorted((r.key, r.role, r.state, r.label) for r in got) == sorted((r.key, r.role, r.state, r.label) for r in C.contrastive(worlds.repartition(1), "key", C.return_group, C.in_time, tries=6).collect())
    by_key = {}
    for r in got:
        by_key.setdefault(r.key, []).append(r)
    assert len(by_key) == 200 and any(r.tries > 1 for r in got)
    for rows in by_key.values():
        if rows[0].role == "rejected":
            assert len(rows) == 1 and rows[0].tries == 6 and rows[0].rejected
            continue
        role = {r.role: r for r in rows}
        assert sorted(r.role for r in rows) == ["a", "aux", "b", "unk", "unk"]
        assert {role["a"].label, role["b"].label} == {"yes", "no"} and {r.label for r in rows if r.role == "unk"} == {"unknown"}
        a, b = role["a"].state.split("\n"), role["b"].state.split("\n")
        assert len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1


def test_hopeless_groups(spark):
    worlds = spark.createDataFrame([(1, DAY, 7)], "key long, day date, customer long")
    got = C.contrastive(worlds, "key", C.return_group, lambda facts: "yes", tries=2).collect()
    assert [(r.role, r.tries, r.rejected, r.state) for r in got] == [("rejected", 2, "same_label", None)]
    assert C.contrastive(worlds.where(F.lit(False)), "key", C.return_group, C.in_time).count() == 0


def test_rows_of_one_partition_are_dealt(spark):
    """A table whose rows all lie in one of many partitions is dealt evenly."""
    from granary.operators import contrast
    from pyspark.sql import functions as F

    skewed = spark.range(400).repartition(16, F.lit(1))
    sizes = [r["n"] for r in contrast._dealt(skewed).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism) and max(sizes) <= 2 * min(sizes)
