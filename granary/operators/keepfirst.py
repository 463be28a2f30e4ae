"""Ordered keep-first among near duplicates: a row goes if an earlier row that *stays* is near it.

Rows stand in an order (ord, unique).  An earlier kept row blocks a later one if their
signatures' estimated Jaccard is at the threshold or more and they ask the same question
(`same`), or come from different origins, whatever they ask (`cross`).  So the copies of a
row that went stay in the race, and one passage with several questions in one source is
kept.  The result is that of walking through the rows one by one; it is found in rounds
over written tables.  In a round, a row without any earlier undecided row that could
block it (one of the same question, or of another origin, in any of its buckets) is kept,
and what it blocks goes.  The earliest undecided row always is one, so rounds end.

Rows of equal signature, question and origin are one class, decided by its first row.  No
bucket gives all its pairs: candidates are a round's kept classes with those that are
left, so a bucket of near copies costs one comparison for each, in the first round.  Once
no more than FEW classes are left, one task walks through them (1 KB each).

A bucket whose members aren't near each other would take a round for each of them.  So
when a round decides less than a quarter, those that are left are compared within their
buckets once, block by block, and the links found (near pairs alone) decide the rest: in
rounds over links, as many as a chain of links is long, or by one walk through few links.

KeptIndex holds the kept rows of earlier batches as tables of bands, signatures and
classes; a new batch joins those, and no earlier text is read again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .near import BANDS, band_keys, estimated_jaccard, signature_id
from .tables import written

CLASS = ["sid", "question", "origin"]
#: Undecided classes that one task may walk through, and links for each of these.
FEW = 3_000
LINKS = 64
#: Members of a bucket that are compared with as many others at a time, and rows (1 KB each) that a task gets together.
BLOCK = 1_000
TOGETHER = 10_000


class KeptIndex:
    """Kept rows of all batches so far, in a folder that all executors share; a batch is added once, when it is decided."""

    SCHEMAS = {"bands": "band int, key string, sid string", "signatures": "sid string, sig array<bigint>", "rows": "sid string, question string, origin string, exact string"}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.batches = spark, path.rstrip("/"), 0

    def table(self, name: str) -> DataFrame:
        schema = self.SCHEMAS[name]
        if not self.batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{i:06d}/{name}" for i in range(self.batches)])

    def append(self, kept: DataFrame) -> None:
        """kept: sid, sig, question, origin, exact of rows that stay."""
        at = f"{self.path}/{self.batches:06d}"
        sigs = kept.where("sid is not null").groupBy("sid").agg(F.first("sig").alias("sig"))
        sigs.write.mode("overwrite").parquet(f"{at}/signatures")
        _bands(self.spark.read.parquet(f"{at}/signatures")).write.mode("overwrite").parquet(f"{at}/bands")
        kept.select("sid", "question", "origin", "exact").distinct().write.mode("overwrite").parquet(f"{at}/rows")
        self.batches += 1


def _bands(sigs: DataFrame) -> DataFrame:
    return sigs.select("sid", F.explode(band_keys(F.col("sig"), BANDS)).alias("k")).select(F.col("k.band").cast("int").alias("band"), "k.key", "sid")


def _near(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (l, f) of signature ids those that are near; a signature is near itself."""
    both = pairs.where("l <> f").join(left.toDF("l", "__a"), "l").join(right.toDF("f", "__b"), "f")
    return both.where(estimated_jaccard(F.col("__a"), F.col("__b")) >= threshold).select("l", "f").union(pairs.where("l = f").select("l", "f"))


def _near_in(left: DataFrame, right: DataFrame, left_sigs: DataFrame, right_sigs: DataFrame, threshold: float, by: tuple[str, ...] = ("band", "key")) -> DataFrame:
    """(l, f), different signatures of left and right that share a bucket and are near: all in a bucket are compared, but no pairs of them are moved.

    A bucket's members are dealt into blocks, and each two of them meet in one group, with
    the signatures; groups are put together to tasks of about TOGETHER rows.
    """
    counts = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = counts(left, "cl").join(counts(right, "cr"), list(by)).where("cl > 1 or cr > 1 or " + ("false" if left is right else "true")).withColumn("bl", blocks("cl")).withColumn("br", blocks("cr"))
    sizes = written(sizes, "sizes")
    parts = sizes.agg(F.coalesce(F.sum(F.col("cl") * F.col("br") + F.col("cr") * F.col("bl")), F.lit(0))).first()[0] // TOGETHER + 1

    def dealt(df: DataFrame, mine: str, theirs: str, first: bool) -> DataFrame:
        x = df.join(sizes, list(by)).withColumn("block", F.pmod(F.xxhash64("sid"), F.col(mine)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
        group = F.xxhash64(*by, *(("block", "other") if first else ("other", "block")))
        return x.select("sid", group.alias("group"), F.lit(first).alias("first"))

    met = dealt(left, "bl", "br", True).join(left_sigs, "sid").union(dealt(right, "br", "bl", False).join(right_sigs, "sid"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().take(pa.array(np.lexsort((t["first"].to_numpy(), t["group"].to_numpy())))).combine_chunks()
        group, first = t["group"].to_numpy(), t["first"].to_numpy()
        sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(len(group), -1).astype(np.int32)
        found_l, found_f = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        cuts = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1)).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            mid = hi - int(first[lo:hi].sum())  # right's rows, then left's
            (a, b), (c, d) = sorted(((lo, mid), (mid, hi)), key=lambda x: x[1] - x[0])
            for i in range(a, b):
                near = c + np.flatnonzero(np.count_nonzero(sig[c:d] == sig[i], axis=1) / sig.shape[1] >= threshold)
                one = np.full(len(near), i)
                found_l.append(one if a == mid else near)
                found_f.append(near if a == mid else one)
        take = lambda x: t["sid"].take(pa.array(np.concatenate(x)))
        return pa.table({"l": take(found_l), "f": take(found_f)})

    return met.withColumn("part", F.pmod("group", F.lit(parts))).groupBy("part").applyInArrow(compare, "l string, f string").where("l <> f").distinct()


def _blocked(left: DataFrame, near: DataFrame, kept: DataFrame) -> DataFrame:
    """left with `by_same` and `by_cross`, the first kept class of each kind that blocks it; only rows that have one."""
    same = kept.groupBy(F.col("sid").alias("l"), "question").agg(F.min("ord").alias("first"))
    cross = kept.groupBy(F.col("sid").alias("l"), F.col("origin").alias("other")).agg(F.min("ord").alias("first"))
    met = left.join(near, left["sid"] == near["f"])
    a = met.join(same, ["l", "question"]).where(F.col("first") < F.col("ord")).select(*CLASS, "ord", F.col("first").alias("by_same"), F.lit(None).cast(left.schema["ord"].dataType).alias("by_cross"))
    b = met.join(cross, "l").where((F.col("other") != F.col("origin")) & (F.col("first") < F.col("ord"))).select(*CLASS, "ord", F.lit(None).cast(left.schema["ord"].dataType).alias("by_same"), F.col("first").alias("by_cross"))
    return a.union(b).groupBy(*CLASS).agg(F.first("ord").alias("ord"), F.min("by_same").alias("by_same"), F.min("by_cross").alias("by_cross"))


def _by_index(classes: DataFrame, bands: DataFrame, sigs: DataFrame, index: KeptIndex, threshold: float) -> DataFrame:
    """CLASS, same: classes that a row of the index blocks."""
    alike = index.table("signatures").join(sigs.select("sid"), "sid", "left_semi").select(F.col("sid").alias("l"), F.col("sid").alias("f"))
    near = written(_near_in(index.table("bands"), bands, index.table("signatures"), sigs, threshold).union(alike.distinct()), "near")
    rows = index.table("rows")
    met = classes.join(near, classes["sid"] == near["f"]).select(*CLASS, "l")
    same = met.join(rows.select(F.col("sid").alias("l"), "question").distinct(), ["l", "question"], "left_semi").select(*CLASS, F.lit(True).alias("same"))
    ends = rows.groupBy(F.col("sid").alias("l")).agg(F.min("origin").alias("o1"), F.max("origin").alias("o2"))
    cross = met.join(ends, "l").where("o1 <> origin or o2 <> origin").select(*CLASS, F.lit(False).alias("same"))
    return same.union(cross).groupBy(*CLASS).agg(F.max("same").alias("same"))


def _leaders(at: DataFrame) -> DataFrame:
    """Of classes in their buckets (band, key, CLASS, ord): those that no earlier one could block."""
    asked = at.groupBy("band", "key", "question").agg(F.min("ord").alias("asked"))
    by_origin = at.groupBy("band", "key", F.col("origin").alias("o")).agg(F.min("ord").alias("first"))
    least = by_origin.groupBy("band", "key").agg(F.min(F.struct("first", "o")).alias("m"))
    second = by_origin.join(least, ["band", "key"]).where("o <> m.o").groupBy("band", "key").agg(F.min("first").alias("second"))
    met = at.join(asked, ["band", "key", "question"]).join(least, ["band", "key"]).join(second, ["band", "key"], "left")
    other = F.when(F.col("m.o") != F.col("origin"), F.col("m.first")).otherwise(F.col("second"))
    earlier = (F.col("asked") < F.col("ord")) | F.coalesce(other < F.col("ord"), F.lit(False))
    return met.groupBy(*CLASS).agg(F.first("ord").alias("ord"), F.max(earlier).alias("earlier")).where("not earlier").drop("earlier")


def decide(rows: DataFrame, *, index: KeptIndex | None = None, threshold: float = 0.8, within: bool = True, few: int = FEW) -> DataFrame:
    """id and near (`same`, `cross`, or null for rows that stay) of rows: id, ord, sig, question, origin.

    Null questions are one question, null origins one origin.  Rows with an empty or null
    signature are near nothing.  The rows of the index come before all.  within=False
    compares rows with the index alone, as for a source that is one batch.
    """
    order = F.struct(F.col("ord").cast("long").alias("ord"), F.col("id").alias("id"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = written(rows.select("id", order.alias("ord"), text("question").alias("question"), text("origin").alias("origin"), signature_id(F.col("sig")).alias("sid"), "sig"), "rows")
    signed = rows.where("sid is not null")
    sigs = written(signed.groupBy("sid").agg(F.first("sig").alias("sig")), "signatures")
    classes = written(signed.groupBy(*CLASS).agg(F.min("ord").alias("ord")), "classes")
    bands = written(_bands(sigs), "bands")
    gone = classes.limit(0).select(*CLASS, F.lit(False).alias("same"))
    if index is not None and index.batches:
        gone = written(_by_index(classes, bands, sigs, index, threshold), "gone")
    kept = classes.limit(0)
    if within:
        kept, lost = _rounds(classes.join(gone, CLASS, "left_anti"), bands, sigs, threshold, few)
        gone = written(gone.unionByName(lost), "gone")
    # a class that another origin's row blocks first may be blocked by one of its own question, too, for its first or its later rows
    across = gone.where("not same").select(*CLASS)
    mine = written(across.join(classes, CLASS), "across")
    there = lambda df: bands.join(df.select("sid", "question").distinct(), "sid")
    near = _near_in(there(kept), there(mine), sigs, sigs, threshold, ("band", "key", "question")).union(mine.select("sid").distinct().select(F.col("sid").alias("l"), F.col("sid").alias("f")))
    asked = kept.groupBy(F.col("sid").alias("l"), "question").agg(F.min("ord").alias("first"))
    late = mine.join(near, mine["sid"] == near["f"]).join(asked, ["l", "question"]).groupBy(*CLASS).agg(F.min("first").alias("by_same"))
    of = classes.withColumnRenamed("ord", "first").join(gone, CLASS, "left").join(late, CLASS, "left")
    again = F.lit(within) & (F.col("ord") > F.col("first"))
    near_kind = F.when(F.col("same").isNull(), F.when(again, "same")).when(F.col("same") | F.coalesce(F.col("by_same") < F.col("ord"), F.lit(False)), "same").otherwise("cross")
    return rows.join(of, CLASS, "left").select("id", F.when(F.col("sid").isNotNull(), near_kind).alias("near"))


def _walked(left: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """CLASS, ord, same (null: stays) of a few classes, decided one by one."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        sig = np.array(rows["sig"].tolist())
        asks, comes = rows["question"].to_numpy(), rows["origin"].to_numpy()
        kept, same = [], []
        for i in range(len(rows)):
            near = [] if not kept else np.array(kept)[(sig[kept] == sig[i]).mean(axis=1) >= threshold]
            verdict = None
            if len(near):
                verdict = True if (asks[near] == asks[i]).any() else False if (comes[near] != comes[i]).any() else None
            if verdict is None:
                kept.append(i)
            same.append(verdict)
        return rows[[*CLASS, "rank"]].assign(same=pd.array(same, dtype="boolean"))

    ranked = left.join(sigs, "sid").withColumn("rank", F.row_number().over(W.orderBy("ord")))
    found = ranked.select(*CLASS, "rank", "sig", F.lit(1).alias("one")).groupBy("one").applyInPandas(walk, "sid string, question string, origin string, rank int, same boolean")
    return found.drop("rank").join(left, CLASS)


def _links(numbered: DataFrame, buckets: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, same) of classes numbered in order that share a bucket: a, the earlier, is near b and blocks it if it is kept."""
    ids = numbered.select("sid").distinct()
    some = buckets.join(ids, "sid", "left_semi")
    near = _near_in(some, some, sigs, sigs, threshold).union(ids.select(F.col("sid").alias("l"), F.col("sid").alias("f")))
    side = lambda sid, n, q, o: numbered.select(F.col("sid").alias(sid), F.col("n").alias(n), F.col("question").alias(q), F.col("origin").alias(o))
    met = near.join(side("l", "a", "q", "o"), "l").join(side("f", "b", "p", "u"), "f").where("a < b and (q = p or o <> u)")
    return met.select("a", "b", (F.col("q") == F.col("p")).alias("same"))


def _by_links(left: DataFrame, buckets: DataFrame, sigs: DataFrame, threshold: float, few: int) -> tuple[DataFrame, DataFrame]:
    """(kept, gone) of classes that are left, decided by the links between them."""
    numbered = written(left.orderBy("ord").withColumn("n", F.monotonically_increasing_id()), "numbered")  # rises with ord
    links = written(_links(numbered, buckets, sigs, threshold), "links")
    lost = numbered.limit(0).select("n", F.lit(False).alias("same"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        verdict: dict[int, bool] = {}
        for b, rows_of_b in rows.sort_values("b").groupby("b"):
            by = [same for a, same in zip(rows_of_b["a"], rows_of_b["same"], strict=True) if a not in verdict]
            if by:
                verdict[b] = any(by)
        return pd.DataFrame({"n": list(verdict), "same": list(verdict.values())}).astype({"n": "int64", "same": "bool"})

    while m := links.count():
        if m <= few * LINKS:
            return _ended(numbered, lost.unionByName(links.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(walk, "n long, same boolean")))
        blocked = links.select(F.col("b").alias("a")).distinct()
        now = written(links.join(blocked, "a", "left_anti").groupBy(F.col("b").alias("n")).agg(F.max("same").alias("same")), "lost")
        lost = lost.unionByName(now)
        out = now.select("n")
        links = written(links.join(out.toDF("b"), "b", "left_anti").join(out.toDF("a"), "a", "left_anti"), "links")
    return _ended(numbered, lost)


def _ended(numbered: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    verdict = written(numbered.join(lost, "n", "left"), "verdicts")
    return verdict.where("same is null").select(*CLASS, "ord"), verdict.where("same is not null").select(*CLASS, "same")


def _rounds(classes: DataFrame, bands: DataFrame, sigs: DataFrame, threshold: float, few: int) -> tuple[DataFrame, DataFrame]:
    """(kept, gone) classes; those that meet no other class in a bucket are kept and in neither."""
    buckets = bands.union(sigs.select(F.lit(-1), "sid", "sid"))  # classes of one signature meet, too
    met = buckets.join(classes.select(*CLASS), "sid")
    who = F.xxhash64(*CLASS)
    shared = met.groupBy("band", "key").agg(F.min(who).alias("a"), F.max(who).alias("z")).where("a < z").select("band", "key")
    buckets = written(buckets.join(shared, ["band", "key"], "left_semi"), "buckets")
    left = written(classes.join(buckets.select("sid").distinct(), "sid", "left_semi"), "left")
    kept, gone = classes.limit(0), classes.limit(0).select(*CLASS, F.lit(False).alias("same"))
    n = left.count()
    while n > few:
        at = written(buckets.join(left, "sid"), "at")
        lead = written(_leaders(at), "leaders")
        kept = kept.unionByName(lead)
        first, rest = at.join(lead.select(*CLASS), CLASS, "left_semi"), written(at.join(lead.select(*CLASS), CLASS, "left_anti"), "rest")
        same = first.select("band", "key", "question", F.col("sid").alias("l")).distinct().join(rest.select("band", "key", "question", F.col("sid").alias("f")).distinct(), ["band", "key", "question"]).select("l", "f")
        of = lambda df, sid, origin: df.select("band", "key", F.col("sid").alias(sid), F.col("origin").alias(origin)).distinct()
        cross = of(first, "l", "o").join(of(rest, "f", "p"), ["band", "key"]).where("o <> p").select("l", "f")
        near = _near(written(same.union(cross).distinct(), "pairs"), sigs, sigs, threshold)
        waiting = left.join(lead.select(*CLASS), CLASS, "left_anti")
        lost = written(_blocked(waiting, near, lead).select(*CLASS, F.col("by_same").isNotNull().alias("same")), "lost")
        gone = gone.unionByName(lost)
        left = written(waiting.join(lost, CLASS, "left_anti"), "left")
        before, n = n, left.count()
        if n > few and 4 * n > 3 * before:
            stay, go = _by_links(left, buckets, sigs, threshold, few)
            return kept.unionByName(stay), gone.unionByName(go)
    if n:
        walked = written(_walked(left, sigs, threshold), "walked")
        kept, gone = kept.unionByName(walked.where("same is null").select(kept.columns)), gone.unionByName(walked.where("same is not null").select(gone.columns))
    return kept, gone
