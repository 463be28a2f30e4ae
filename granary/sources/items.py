"""Decision items as JSON lines: parse to typed columns, with the first reason of rejection, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probs as P

TYPES = ("noul", "choice", "score")
USES = ("", "open", "research", "restricted")
WIRE = """id string, state string, question struct<type: string, instructions: string, criteria: string>, labels array<string>, expected string, target string,
gold_probs string, source string, family string, lang string, license string, license_use string, _corrupt string"""
_MAP = "map<string,string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: JSON lines of a file or folder, split at \\n only, blank ones left out."""
    return spark.read.option("lineSep", "\n").text(path).where(F.length(F.trim("value")) > 0).select(F.col("value").alias("line"))


def parse_items(lines: DataFrame, column: str = "line") -> DataFrame:
    """id, state, type, instructions, labels, descriptions, target, source, family, lang, license, license_use, reject_reason.

    Fail-closed: anything malformed has a reason, and null labels and target.  An array
    or object as state stays as its JSON text.  Criteria, target and state may be of any
    JSON type; they are read as text first.
    """
    f = F.from_json(F.col(column), WIRE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    x = lines.select(column, f.alias("j")).select(column, "j.*")
    q, kind, raw = F.col("question"), F.col("question.type"), F.col("question.criteria")
    listed = F.from_json(raw, "array<string>")
    named = F.from_json(raw, _MAP)
    names = F.json_object_keys(raw)
    is_list = raw.startswith("[")
    plain = F.coalesce(F.when(is_list, F.transform(F.sequence(F.lit(0), F.size(listed) - 1), lambda i: i.cast("string"))).otherwise(names), F.array().cast("array<string>"))
    labels = F.when(kind == "noul", F.array(F.lit("no"), F.lit("yes"))).when(F.size("labels") > 0, F.col("labels")).otherwise(plain)
    get = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(""))
    described = (
        F.when(kind == "noul", F.array(F.coalesce(F.element_at(named, "false"), F.element_at(named, "no"), F.lit("")), F.coalesce(F.element_at(named, "true"), F.element_at(named, "yes"), F.lit(""))))
        .when(is_list, listed)
        .otherwise(F.transform(labels, lambda k: get(named, k)))
    )
    x = x.withColumn("labels", labels).withColumn("descriptions", described).withColumn("type", kind).withColumn("instructions", F.coalesce(q["instructions"], F.lit("")))
    given = F.from_json(F.coalesce("target", "gold_probs"), "map<string,double>")
    expected = F.when(F.lower("expected") == "true", "yes").when(F.lower("expected") == "false", "no").otherwise(F.col("expected"))
    dist = F.transform("labels", lambda k: F.coalesce(F.element_at("given", k), F.lit(0.0)))
    x = x.withColumn("given", given).withColumn("expected", expected).withColumn("dist", F.when(F.col("given").isNotNull(), dist))
    total = P.total(F.col("dist"))
    soft = F.col("given").isNotNull()
    levels = F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda i: i.cast("string"))
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "not_json")
        .when(F.col("type").isNull() | ~F.col("type").isin(*TYPES), "unknown_type")
        .when((F.size("labels") < 2) | (F.size(F.array_distinct("labels")) < F.size("labels")), "labels")
        .when(F.size("labels") != F.size("descriptions"), "criteria_length")
        .when((F.col("type") == "score") & (F.col("labels") != levels), "score_labels")
        .when(soft & (F.size(F.array_except(F.map_keys("given"), "labels")) > 0), "unknown_label")
        .when(soft & F.exists("dist", lambda p: (p < 0) | F.isnan(p) | (p > 1e9)), "invalid_probability")
        .when(soft & ~total.between(0.98, 1.02), "probability_sum")
        .when(~soft & F.col("expected").isNull(), "no_target")
        .when(~soft & ~F.array_contains("labels", F.col("expected")), "expected_unknown")
        .when(F.col("state").isNull() | (F.length(F.trim("state")) == 0), "empty_state")
        .when(~F.coalesce("license_use", F.lit("")).isin(*USES), "license_use")
    )
    target = F.when(soft, F.transform("dist", lambda p: p / total)).otherwise(F.transform("labels", lambda k: F.when(k == F.col("expected"), 1.0).otherwise(0.0)))
    x = x.withColumn("reject_reason", reason).withColumn("target", target)
    ok = F.col("reject_reason").isNull()
    default = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return x.select("id", "state", "type", "instructions", F.when(ok, F.col("labels")).alias("labels"), F.when(ok, F.col("descriptions")).alias("descriptions"), F.when(ok, F.col("target")).alias("target"), default("source", "unknown"), default("family", "unknown"), default("lang", "en"), default("license", ""), default("license_use", ""), "reject_reason")


def item_json(c: Column | None = None) -> Column:
    """A JSON line of an item's columns: expected where the target is one label, else the target by label."""
    one = F.array_max("target") >= 1.0 - 1e-9
    gold = F.get("labels", P.argmax(F.col("target")))
    return F.to_json(
        F.struct(
            "id", "state",
            F.struct("type", "instructions", F.map_from_arrays("labels", "descriptions").alias("criteria")).alias("question"),
            "labels", F.when(one, gold).alias("expected"), F.when(~one, F.map_from_arrays("labels", "target")).alias("target"), "source", "family", "lang",
        )
    )


def write_lines(df: DataFrame, path: str) -> None:
    """Items as JSON lines; the job commits all files or none."""
    df.select(item_json().alias("value")).write.text(path)


def strings_of(value: object) -> list[str]:
    """Every string within a nested value, JSON texts decoded; for reference sets whose layout may change."""
    import json

    out: list[str] = []
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            if v[:1] in "[{":
                try:
                    todo.append(json.loads(v))
                    continue
                except ValueError:
                    pass
            out.append(v)
        elif isinstance(v, dict):
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, (list, tuple)):
            todo.extend(reversed(v))
    return out
