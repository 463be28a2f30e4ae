"""Contrastive groups: rows of several roles made from one world, kept whole or not at all.

A group says a state line by line, with the facts that each line carries and the forms in
which it spells them.  Role `a` is the state; `b` changes one line so that the answer is
another; `unk` leaves out a line without which nobody can answer; `aux` asks something
else of the same state.  A group is checked before any of its rows leaves the task:

    unsolved      the rules don't give a's or b's answer
    same_label    the changed line doesn't change the answer
    edit          b differs from a in more than one line, or in more than max_edit tokens of it
    decidable     the rules still answer without an evidence line
    leaked        a form of an evidence line's facts stands elsewhere in the state or the question

A rejected group is drawn anew, from another seed, up to `tries` times; after that one row of
role `rejected` says why.  Draws depend on the row's key and the try alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.structured import token_distance

TOKEN = re.compile(r"\w+|[^\w\s]")
ROLES = ("a", "b", "unk", "aux")
SCHEMA = "role string, state string, question string, label string, dropped string, tries int, rejected string"


@dataclass(frozen=True)
class Line:
    tag: str
    text: str
    facts: dict = field(default_factory=dict)
    forms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Group:
    """lines of a; the line that b has instead of the one of its tag; evidence: tags without which there is no answer; aux: (question, answer)."""

    lines: tuple[Line, ...]
    changed: Line
    question: str
    evidence: tuple[str, ...]
    aux: tuple[tuple[str, str], ...] = ()

    def b(self) -> tuple[Line, ...]:
        return tuple(self.changed if x.tag == self.changed.tag else x for x in self.lines)


def said(lines: tuple[Line, ...], drop: str | None = None) -> str:
    return "\n".join(x.text for x in lines if x.tag != drop)


def known(lines: tuple[Line, ...], drop: str | None = None) -> dict:
    return {k: v for x in lines if x.tag != drop for k, v in x.facts.items()}


def rejected(group: Group, solve: Callable[[dict], str | None], *, max_edit: int = 8) -> str | None:
    """Why a group isn't one, or null.  solve gives an answer from facts, null where they don't say."""
    a, b = group.lines, group.b()
    first, second = solve(known(a)), solve(known(b))
    if first is None or second is None:
        return "unsolved"
    if first == second:
        return "same_label"
    changes = [(x.text, y.text) for x, y in zip(a, b, strict=True) if x.text != y.text]
    if len(changes) != 1 or token_distance(TOKEN.findall(changes[0][0]), TOKEN.findall(changes[0][1])) > max_edit:
        return "edit"
    for tag in group.evidence:
        if sum(x.tag == tag for x in a) != 1 or solve(known(a, tag)) is not None:
            return f"decidable:{tag}"
        rest = said(a, tag) + "\n" + group.question
        if any(form and re.search(rf"(?<!\w){re.escape(form)}(?!\w)", rest) for x in a if x.tag == tag for form in x.forms):
            return f"leaked:{tag}"
    return None


def members(group: Group, solve: Callable[[dict], str | None], unknown: str, roles: tuple[str, ...] = ROLES) -> list[tuple]:
    """role, state, question, label, dropped of a good group."""
    a, b, out = group.lines, group.b(), []
    if "a" in roles:
        out.append(("a", said(a), group.question, solve(known(a)), None))
    if "b" in roles:
        out.append(("b", said(b), group.question, solve(known(b)), None))
    if "unk" in roles:
        out += [("unk", said(a, tag), group.question, unknown, tag) for tag in group.evidence]
    if "aux" in roles:
        out += [("aux", said(a), question, answer, None) for question, answer in group.aux]
    return out


def _dealt(worlds: DataFrame) -> DataFrame:
    """worlds' rows dealt evenly: they are small and cost much each, and a file of few row groups gives few tasks rows, however it is split."""
    spark = worlds.sparkSession
    return worlds.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def contrastive(worlds: DataFrame, key: str, make: Callable[[dict, random.Random], Group], solve: Callable[[dict], str | None], *, unknown: str = "unknown", tries: int = 5, max_edit: int = 8, roles: tuple[str, ...] = ROLES, seed: int = 0) -> DataFrame:
    """worlds' key with SCHEMA: the rows of each row's group, by a table function of one row at a time, next to Spark's own scan."""

    @F.udtf(returnType=SCHEMA)
    class Emit:
        def eval(self, row):  # noqa: ANN001, ANN202
            world, why = row.asDict(), None
            for n in range(tries):
                group = make(world, random.Random(f"{seed}|{world[key]}|{n}"))
                why = rejected(group, solve, max_edit=max_edit)
                if why is None:
                    for m in members(group, solve, unknown, roles):
                        yield (*m, n + 1, None)
                    return
            yield ("rejected", None, None, None, None, tries, why)

    return _dealt(worlds).lateralJoin(Emit(F.struct(*worlds.columns).outer())).select(key, *[c.split()[0] for c in SCHEMA.split(", ")])


# ---- a base: is a return in time

def in_time(facts: dict) -> str | None:
    if {"bought", "returned", "window"} - facts.keys():
        return None
    return "yes" if (facts["returned"] - facts["bought"]).days <= facts["window"] else "no"


def return_group(world: dict, rng: random.Random) -> Group:
    """A purchase (key, day, customer), a window in days and a return around its end."""
    from datetime import timedelta

    bought, window = world["day"], rng.randrange(10, 61)
    late = rng.random() < 0.5
    days = lambda after: window + rng.randrange(1, 8) if after else window - rng.randrange(0, 8)
    line = lambda n: Line("returned", f"Returned on {(bought + timedelta(n)):%Y-%m-%d}.", {"returned": bought + timedelta(n)}, (f"{bought + timedelta(n):%Y-%m-%d}",))
    lines = (
        Line("order", f"Order {world['key']} of customer {world['customer']}."), Line("bought", f"Bought on {bought:%Y-%m-%d}.", {"bought": bought}, (f"{bought:%Y-%m-%d}",)),
        Line("policy", f"Returns are taken within {window} days.", {"window": window}, (str(window),)), line(days(late)),
    )
    weekend = "yes" if bought.weekday() > 4 else "no"
    return Group(lines, line(days(not late)), "Is the return in time?", ("policy", "returned"), (("Was it bought on a weekend?", weekend),))
