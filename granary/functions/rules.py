"""Decision rules as column expressions: dates, intervals, policies, schedules of a run.  Labels follow from facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# German words, and free bags by membership and cabin.
GERMAN = ("der", "die", "und", "nicht", "ist", "ich", "ein", "eine", "mit", "für", "auf", "sie", "wie", "was")
FREE_BAGS = {"regular": (0, 1, 2), "silver": (1, 2, 3), "gold": (2, 3, 3)}
CABINS = ("basic economy", "economy", "business")
BAG_FEE = 50


def choose(c: Column, values: dict, default: object = None) -> Column:
    """The value of c's key."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def looks_german(text: Column) -> Column:
    """Three words or more, of which max(2, a twelfth) are German function words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.filter(w, lambda x: x.isin(*GERMAN))).alias("german")))[0]
    return (n["all"] >= 3) & (n["german"] >= F.greatest(F.lit(2), F.floor(n["all"] / 12)))


def model_size(name: Column) -> Column:
    """'7B' of names such as 'family-7B-chat'; null without one."""
    return F.nullif(F.regexp_extract(name, r"-([0-9]+(?:\.[0-9]+)?B)\b", 1), F.lit(""))


# ---- dates and intervals

def weekday(day: Column, offset: Column) -> Column:
    return F.date_format(F.date_add(day, offset.cast("int")), "EEEE")


def deadline(start: Column, n: Column, unit: Column) -> Column:
    """The last day of a delay: the first day doesn't count; months end on the same day or the month's last."""
    return F.when(unit == "month", F.add_months(start, n.cast("int"))).when(unit == "week", F.date_add(start, (7 * n).cast("int"))).otherwise(F.date_add(start, n.cast("int")))


def period_end(start: Column, n: Column, unit: Column) -> Column:
    """The last day of a period: the first day counts."""
    return F.date_sub(deadline(start, n, unit), 1)


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of two half-open intervals, [a, b) and [c, d)."""
    return (a < d) & (c < b)


def compare(x: Column, op: Column, value: Column) -> Column:
    return F.when(op == ">=", x >= value).when(op == ">", x > value).when(op == "<", x < value).when(op == "<=", x <= value)


# ---- policies

def refund(*, final_sale: Column, days: Column, window: Column, bonus: Column, member: Column, opened: Column, sealed_only: Column, amount: Column, limit: Column) -> Column:
    """deny a final sale, a late return (members have a bonus) and an opened article where that is ruled out; escalate large amounts; approve the rest."""
    late = days > window + F.when(member, bonus).otherwise(0)
    return F.when(final_sale | late | (opened & sealed_only), "deny").when(amount > limit, "escalate").otherwise("approve")


def bag_fee(tier: Column, cabin: Column, passengers: Column, bags: Column) -> Column:
    """What bags beyond the allowance of membership and cabin cost."""
    free = F.lit(None).cast("int")
    for name, allowance in FREE_BAGS.items():
        free = F.when(tier == name, choose(cabin, dict(zip(CABINS, allowance, strict=True)))).otherwise(free)
    return F.greatest(bags - free * passengers, F.lit(0)) * BAG_FEE


def may_cancel(*, hours: Column, by_airline: Column, cabin: Column, insured: Column, reason: Column) -> Column:
    """Within a day of booking, if the airline cancelled, in business, or insured for health or weather."""
    return (hours <= 24) | by_airline | (cabin == "business") | (insured & reason.isin("health", "weather"))


def compensation(event: Column, passengers: Column) -> Column:
    return choose(event, {"cancelled": 100, "delayed": 50}, 0) * passengers


def invoice_due(lines: Column, discount: Column) -> Column:
    """The sum of quantity * price less a discount in percent, to the cent; lines: array<struct<qty,price>> of decimals."""
    total = F.aggregate(lines, F.lit(0).cast("decimal(28,4)"), lambda s, x: (s + x["qty"] * x["price"]).cast("decimal(28,4)"))
    return F.round(total * (100 - discount) / 100, 2)


def invoice_matches(lines: Column, discount: Column, shown: Column) -> Column:
    """Whether the shown total is what is due."""
    return F.abs(invoice_due(lines, discount) - shown) < 0.005


# ---- a run's schedule

def every(step: Column, main: int, tail: int, tail_start: int) -> Column:
    """Each `main`-th step, in the tail each `tail`-th; 0 is never."""
    of = lambda n: F.lit(False) if n <= 0 else step % n == 0
    return F.when(step > tail_start, of(tail)).otherwise(of(main)) if tail else of(main)


def share_at(step: Column, total: int, start: float, end_frac: float) -> Column:
    """A share that falls in a line from start to 0 at end_frac of the steps."""
    return F.greatest(F.lit(0.0), start * (1 - step / (end_frac * total)))


def mean_share(start: float, end_frac: float) -> float:
    return start * end_frac / 2


def tier_cap(name: Column, block: Column, *, first_blocks: tuple[str, ...], cap: float, other: float = 1.0, overrides: dict[str, float] | None = None) -> Column:
    """The cap on a source's epochs: `cap` in the blocks of the first tier, else `other`, and never above its own override."""
    by_tier = F.when(block.isin(*first_blocks), F.lit(cap)).otherwise(F.lit(other))
    return F.least(by_tier, choose(name, overrides or {}, None).cast("double"))
