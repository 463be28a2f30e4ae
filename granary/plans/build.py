"""Whole jobs: build a mix, derive another, extend one, evaluate a dump, report on the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import group_held_out, part_of
from ..operators import decontam, hygiene, metrics, mixture, near, sampling
from ..operators.tables import written


def build_mix(items: DataFrame, benchmark: DataFrame, *, cap: int = 100_000, per_mille: int = 100) -> dict[str, DataFrame]:
    """train, held, drops of items (id, state, source, lang, ordinal): whole groups held out by hash, training rows cleaned and capped by source."""
    held = items.where(group_held_out(F.col("id"), per_mille)).withColumn("part", part_of(F.col("id")))
    rest = items.where(~group_held_out(F.col("id"), per_mille))
    against = held.select("id", "state").unionByName(benchmark.select("id", "state"))
    # train and drops both read what was found, a row without its text for each of rest; the three columns tell a row's reason even where ids repeat
    judged = hygiene.reasons(rest.withColumn("text", F.md5("state")), against).select("id", "ordinal", "text", "source", "key", "reason")
    cleaned = hygiene.without_duplicates(written(judged, "reasons"))
    kept = cleaned.where("reason is null").select(F.col("id").alias("__i"), F.col("ordinal").alias("__o"), F.col("text").alias("__t"))
    same = F.col("id").eqNullSafe(F.col("__i")) & F.col("ordinal").eqNullSafe(F.col("__o")) & F.md5("state").eqNullSafe(F.col("__t"))
    train = sampling.cap_per_group(rest.join(kept, same, "left_semi"), "source", cap)
    drops = cleaned.where("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))
    return {"train": train, "held": held, "drops": drops}


def derive_mix(train: DataFrame, *, keep: list[str] | None = None, cap: int | None = None, seed: int = 0) -> DataFrame:
    """A mix of some sources, each capped; held-out rows are never touched."""
    out = train if keep is None else train.where(F.col("source").isin(keep))
    return out if cap is None else sampling.cap_per_group(out, "source", cap, seed=seed)


def extend_mix(base: DataFrame, new: DataFrame, held: DataFrame, *, near_threshold: float = 0.8) -> DataFrame:
    """base and the rows of new that are neither held-out, nor its exact or near duplicates."""
    fresh = hygiene.clean(new, held).where("reason is null").drop("reason")
    known = base.select(F.md5(T.norm_key("state")).alias("key")).distinct()
    fresh = fresh.join(known, "key", "left_anti").drop("key")
    hits = near.near_hits(near.signatures(fresh, "state", "id"), near.signatures(base, "state", "id"), threshold=near_threshold).select("id").distinct()
    return base.unionByName(fresh.join(hits, "id", "left_anti").select(*base.columns))


def source_weights(train: DataFrame, blocks: DataFrame, *, power: float = 0.5, cap: float | None = None) -> DataFrame:
    """source, weight from rows by source and (source, block, share)."""
    n = train.groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("lang") == "fr").cast("int")).alias("fr_share"))
    w = mixture.block_weights(n.join(blocks, "source"), power=power)
    return (mixture.capped(w, cap) if cap else w).select("source", "block", "n", "weight")


def evaluate(dump: DataFrame, groups: list[str]) -> dict[str, DataFrame]:
    """The grouped report, both calibration errors, typed scores and the temperature of each type."""
    return {
        "report": metrics.grouped_report(dump, groups),
        "ece15": metrics.ece(dump, ["type"], metrics.bin_right_closed(F.col("conf"), 15)),
        "ece10": metrics.ece(dump, ["type"], metrics.bin_left_closed(F.col("conf"), 10)),
        "scores": metrics.chance_corrected(metrics.typed_scores(dump), ["tier"]),
        "temperatures": metrics.best_temperature(metrics.temperature_grid(dump, ["type"]), ["type"]),
    }


def quality_report(items: DataFrame, held: DataFrame) -> DataFrame:
    """A row for each source: rows, exact duplicates, benchmark hits, short and damaged texts, artefacts, length quantiles."""
    key = F.md5(T.norm_key("state"))
    n = F.size(T.words("state"))
    rows = items.select("id", "source", key.alias("key"), n.alias("n"), T.damaged("state").alias("damaged"), F.size(T.artefact_flags("state")).alias("flags"))
    first = rows.groupBy("key").agg(F.min("id").alias("first"))
    hit = decontam.hit_ids(items, decontam.known_grams(held)).withColumn("hit", F.lit(1))
    x = rows.join(first, "key").join(hit, "id", "left")
    return x.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("id") > F.col("first")).alias("duplicates"), F.count("hit").alias("benchmark_hits"), F.count_if(F.col("n") < 10).alias("short"),
        F.count_if("damaged").alias("damaged"), F.count_if(F.col("flags") > 0).alias("with_artefacts"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.99)).alias("p99"),
    )


def recommendations(report: DataFrame) -> DataFrame:
    """source, severity, advice, the gravest first: rules on the report's shares."""
    share = lambda c: F.col(c) / F.col("n_rows")
    rules = [("benchmark_hits", 0.0, 5.0, "drop rows that hold benchmark text"), ("duplicates", 0.05, 3.0, "remove duplicates"), ("damaged", 0.0, 3.0, "repair or drop damaged texts"), ("with_artefacts", 0.02, 2.0, "clean artefacts"), ("short", 0.1, 1.0, "check short texts")]
    found = F.array_compact(F.array(*[F.when(share(c) > least, F.struct(F.lit(w).alias("weight"), share(c).alias("share"), F.lit(a).alias("advice"))) for c, least, w, a in rules]))
    return report.select("source", F.explode(found).alias("f")).select("source", F.round(F.col("f.weight") * (1 + F.col("f.share")), 6).alias("severity"), "f.advice").orderBy(F.desc("severity"), "source")
