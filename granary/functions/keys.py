"""Keys, hash draws and splits.  sha2 and md5 where another engine must agree, xxhash64 elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_key

SEP = "\u001f"


def sha_int(c: Column) -> Column:
    """The first 32 bits of the SHA-256, as long."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 8), 16, 10).cast("long")


def hash01(key: Column, seed: int = 0) -> Column:
    """Uniform in [0, 1), the same for the same key and seed."""
    return sha_int(F.concat_ws(SEP, key.cast("string"), F.lit(str(seed)))) / F.lit(4294967296.0)


def part_of(identifier: Column) -> Column:
    """Held-out part of an id: validation, calibration or test."""
    return F.element_at(F.array(F.lit("validation"), F.lit("calibration"), F.lit("test")), (sha_int(identifier) % 3 + 1).cast("int"))


def group_held_out(group: Column, per_mille: int = 100) -> Column:
    """True for groups in the held-out share; a group never straddles."""
    return sha_int(group) % 1000 < per_mille


def pair_key(*columns: Column) -> Column:
    """Normalised texts joined to one key."""
    return F.concat_ws(SEP, *[norm_key(c) for c in columns])


def stable_hash(*columns: Column) -> Column:
    return F.xxhash64(F.concat_ws(SEP, *[c.cast("string") for c in columns]))


def exact_key(state: Column, instructions: Column, kind: Column, menu: Column, target: Column) -> Column:
    """Key of a full duplicate: texts, type, options and the target to four digits."""
    return F.md5(F.concat_ws(SEP, norm_key(state), norm_key(instructions), kind, F.to_json(menu), F.to_json(F.transform(target, lambda p: F.round(p, 4)))))


def range_bucket(n: Column, buckets: tuple[int, ...]) -> Column:
    """The least bucket of n or more; null beyond the largest."""
    out = F.lit(None).cast("int")
    for b in sorted(buckets, reverse=True):
        out = F.when(n <= b, F.lit(b)).otherwise(out)
    return out


def first_match(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (pattern, name) that matches."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out
