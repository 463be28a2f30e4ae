"""MinHash signatures, band keys, near pairs and hits, components, cluster caps.

The hashes are 28 bits of an MD5 and (a * h + b) modulo 2^31 - 1, which stay within a
64-bit integer in any engine.  Signatures are made in Arrow batches; all else are joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as T
from .shingles import gram_hashes
from .tables import written

PRIME = 2147483647
#: Permutations and bands (of 4 rows): a pair at a similarity of 0.8 is a candidate with a probability of 1 - 5e-8, one at 0.5 with 87 %.
PERMS = 128
BANDS = 32
#: Hashes that the permutations are applied to at a time: what fits a core's cache.
CHUNK = 16_384
#: Words of a batch that are worked on at a time; a longer text is worked on by itself.
WORDS_AT_ONCE = 1 << 18


#: Bits of a band filter for each band's key, and its 64-bit words at least and at most (32 MB, in every Python worker).
FILTER_BITS, FILTER_WORDS = 32, (1 << 16, 1 << 22)

#: (first, step) of the permutations' factors and of their addends.
FACTORS, ADDENDS = (48271, 15838), (0, 104729)


def coefficients(perms: int) -> list[tuple[int, int]]:
    return [(FACTORS[0] + FACTORS[1] * j, ADDENDS[0] + ADDENDS[1] * j) for j in range(perms)]


def minima(hashes: np.ndarray, counts: np.ndarray, perms: int) -> np.ndarray:
    """[sets, perms]: the least (a * h + b) modulo PRIME of each set, for all coefficients; sets lie one after another and mustn't be empty.

    The coefficients have equal steps, so each permutation's values are those of the one
    before plus one difference, modulo PRIME: 32-bit additions.
    """
    out, prime = np.empty((len(counts), perms), np.int64), np.uint32(PRIME)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        lo = int(ends[at] - counts[at])
        upto = max(int(np.searchsorted(ends, lo + CHUNK, "right")), at + 1)
        h = hashes[lo : int(ends[upto - 1])].astype(np.uint64)
        starts = (ends - counts)[at:upto] - lo
        x, step = (((np.uint64(a) * h + np.uint64(b)) % np.uint64(PRIME)).astype(np.uint32) for a, b in zip(FACTORS, ADDENDS, strict=True))
        less = np.empty_like(x)
        for j in range(perms):
            out[at:upto, j] = np.minimum.reduceat(x, starts)
            x += step
            np.subtract(x, prime, out=less)  # wraps around, and is larger, where x is under PRIME
            np.minimum(x, less, out=x)
        at = upto
    return out


def band_hashes(sigs: np.ndarray, bands: int) -> np.ndarray:
    """[sets, bands]: 64-bit hashes of each band's number and rows of signatures [sets, perms]."""
    rows = sigs.shape[1] // bands
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sigs), 1))
    for r in range(rows):
        out ^= sigs[:, r : bands * rows : rows].astype(np.uint64)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter that each hash belongs to, and its (up to) four bits there."""
    bits = np.zeros(hashes.shape, np.uint64)
    for shift in (58, 52, 46, 40):
        bits |= np.uint64(1) << (hashes >> np.uint64(shift) & np.uint64(63))
    return (hashes & np.uint64(words - 1)).astype(np.int64), bits


def meets_filter(sigs: np.ndarray, words: np.ndarray, bands: int) -> np.ndarray:
    """Which signatures may have a band in common with one that the filter was made of; those that have are never left out."""
    at, bits = _places(band_hashes(sigs, bands), len(words))
    return ((words[at] & bits) == bits).any(axis=1)


def band_filter(sigs: DataFrame, *, bands: int = BANDS) -> np.ndarray:
    """A Bloom filter of the bands of sig, merged from those of all tasks; sigs, of signatures(), should be written.

    It grows with sigs from 0.5 to 32 MB, which suit 262,144 signatures in 32 bands.  Of
    more, it still lets all rows through that have a band in common, and more of the others.
    """
    wanted = sigs.count() * bands * FILTER_BITS // 64
    size = min(max(1 << max(wanted - 1, 0).bit_length(), FILTER_WORDS[0]), FILTER_WORDS[1])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size, np.uint64)
        for batch in batches:
            if batch.num_rows:
                at, bits = _places(band_hashes(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), bands), size)
                np.bitwise_or.at(words, at, bits)
        found = np.flatnonzero(words)
        for i in range(0, len(found), WORDS_AT_ONCE):
            some = found[i : i + WORDS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some].view(np.int64), pa.int64())], ["at", "bits"])

    merged = sigs.select("sig").mapInArrow(part, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[merged["at"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return words


def signature(words: Column, perms: int = PERMS, k: int = 3, meets: np.ndarray | None = None, bands: int = BANDS) -> Column:
    """perms minima over the k-grams of an array of words (of the whole, where it has fewer); empty for no words.

    meets: a band_filter of the same bands; empty for a signature that has no band in common with it.
    """

    @F.arrow_udf(ArrayType(LongType()))
    def sign(batch: pa.Array) -> pa.Array:
        found, full = [], np.zeros(len(batch), np.int64)
        size = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // WORDS_AT_ONCE
        for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
            hashes, counts = gram_hashes(batch.slice(rows[0], len(rows)), k) if len(rows) else (np.empty(0, np.uint32), np.empty(0, np.int64))
            some, sigs = rows[counts > 0], minima(hashes, counts[counts > 0], perms)
            if meets is not None:
                near = meets_filter(sigs, meets, bands)
                some, sigs = some[near], sigs[near]
            full[some] = 1
            found.append(sigs.ravel())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * perms)]), pa.int32()), pa.array(np.concatenate(found), pa.int64()))

    return sign.asNondeterministic()(words)  # so that a filter on the result isn't pushed below it, which would make each signature twice


def band_keys(sig: Column, bands: int = BANDS, key: Column | None = None) -> Column:
    """array<struct<band,key>>; rows of a band are size / bands.  A key, mixed in, keeps rows of other keys out of a bucket."""
    rows = F.floor(F.size(sig) / bands).cast("int")
    more = [] if key is None else [key.cast("string")]
    return F.when(F.size(sig) > 0, F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.md5(F.concat_ws("|", F.array_join(F.transform(F.slice(sig, b * rows + 1, rows), lambda x: x.cast("string")), ","), *more)).alias("key"))))


def signature_id(sig: Column) -> Column:
    """128 bits of a signature; null for an empty one."""
    return F.when(F.size(sig) > 0, F.md5(F.array_join(F.transform(sig, lambda x: x.cast("string")), ",")))


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its input has fewer partitions (a single small file); larger inputs aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df  # noqa: SLF001


def signatures(df: DataFrame, text: str, *keep: str, perms: int = PERMS, k: int = 3, meets: np.ndarray | None = None, bands: int = BANDS) -> DataFrame:
    """keep and sig of the rows that have words.

    meets: a band_filter of the same bands; rows that can't meet it fall out where they are
    signed, so a large query of a small index moves and writes no signatures but its candidates'.
    """
    return spread(df).select(*keep, signature(T.words(text), perms, k, meets, bands).alias("sig")).where(F.size("sig") > 0)


def near_pairs(sigs: DataFrame, *, bands: int = BANDS, threshold: float = 0.8) -> DataFrame:
    """(a, b, j): each member of a bucket with the bucket's smallest id, estimated Jaccard at the threshold or more.

    A star and not all pairs: a bucket of n gives n - 1.
    """
    sigs = written(sigs, "signatures")
    keys = sigs.select("id", F.explode(band_keys(F.col("sig"), bands)).alias("k")).select("id", "k.band", "k.key")
    first = keys.groupBy("band", "key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z")
    pairs = keys.join(first, ["band", "key"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    left, right = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", estimated_jaccard(F.col("sa"), F.col("sb")).alias("j")).where(F.col("j") >= threshold)


def near_hits(query: DataFrame, index: DataFrame, *, bands: int = BANDS, threshold: float = 0.8, key: str | None = None, tag: str | None = None) -> DataFrame:
    """(id, ref, j): rows of query near a row of index; both with id and sig.  Every candidate is verified.

    key: a column of both that has to be equal, e.g. a hash of the question.  tag: a
    column of both that has to differ, e.g. the source.  Rows of equal signature (and key
    and tag) are compared as one, so copies multiply the result alone and no bucket.
    """
    more = [c for c in (key, tag) if c]
    q, i = (written(df.select("id", "sig", *more, signature_id(F.col("sig")).alias("sid")).where("sid is not null"), "signed") for df in (query, index))
    same = ["sid", *more]
    reps = lambda df: df.groupBy(*same).agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    reps_q, reps_i = written(reps(q), "query"), written(reps(i), "index")
    mixed = F.col(key) if key else None
    tagged = [F.col(tag).alias("tag")] if tag else []
    banded = lambda df, name: df.select(F.col("rep").alias(name), *tagged, F.explode(band_keys(F.col("sig"), bands, mixed)).alias("k")).select(name, *(["tag"] if tag else []), "k.band", "k.key")
    met = banded(reps_q, "q").alias("x").join(banded(reps_i, "r").alias("y"), ["band", "key"])
    if tag:
        met = met.where(~F.col("x.tag").eqNullSafe(F.col("y.tag")))
    pairs = written(met.select("q", "r").distinct(), "candidates")  # ids alone; signatures are fetched once for each candidate
    both = pairs.join(reps_q.select(F.col("rep").alias("q"), F.col("sig").alias("qs")), "q").join(reps_i.select(F.col("rep").alias("r"), F.col("sig").alias("rs")), "r")
    found = both.select("q", "r", estimated_jaccard(F.col("qs"), F.col("rs")).alias("j")).where(F.col("j") >= threshold)
    equal = lambda df: [df[c].eqNullSafe(F.col(f"__{c}")) for c in same]
    whole = lambda df, r, rep, name: df.join(r.select("rep", *[F.col(c).alias(f"__{c}") for c in same]), equal(df)).select(F.col("id").alias(name), F.col("rep").alias(rep))
    return found.join(whole(q, reps_q, "q", "id"), "q").join(whole(i, reps_i, "r", "ref"), "r").select("id", "ref", "j")


def components(pairs: DataFrame) -> DataFrame:
    """(id, cluster) of all ids in pairs (a, b), cluster the smallest id reachable; label propagation with pointer jumps over written tables."""
    edges = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct().toDF("id", "other"), "edges")
    labels = written(edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("cluster")), "labels")
    while True:
        seen = edges.join(labels.toDF("other", "c"), "other").groupBy("id").agg(F.min("c").alias("c"))
        new = labels.join(seen, "id").select("id", F.least("cluster", "c").alias("cluster"), F.col("cluster").alias("old"))
        jump = new.join(labels.toDF("cluster", "up"), "cluster", "left").select("id", F.least("cluster", F.coalesce("up", "cluster")).alias("cluster"), "old")
        jump = written(jump, "labels")
        moved = jump.where("cluster <> old").limit(1).count()
        labels = jump.select("id", "cluster")
        if not moved:
            return labels


def cluster_cap(df: DataFrame, clusters: DataFrame, *, cap: int, question: str, salts: int = 16) -> DataFrame:
    """At most cap rows of each cluster: first one of each question, then any, both by id.  Rows without cluster stay.

    A question's first row is a partial aggregate, and ranks are taken within salted
    parts first: a cluster meets in one task with salts * cap rows at most.
    """
    joined = df.join(clusters, "id", "left")
    inside = joined.where("cluster is not null")
    first = inside.groupBy("cluster", question).agg(F.min("id").alias("__first")).toDF("__cluster", "__question", "__first")
    ranked = inside.join(first, (F.col("cluster") == F.col("__cluster")) & F.col(question).eqNullSafe(F.col("__question")))
    ranked = ranked.select(*inside.columns, (F.col("id") > F.col("__first")).cast("int").alias("__again"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("__salt"))
    best = lambda df, *by: df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy("__again", "id"))).where(F.col("__r") <= cap)
    kept = best(best(ranked, "cluster", "__salt"), "cluster")
    return joined.where("cluster is null").drop("cluster").unionByName(kept.drop("cluster", "__again", "__salt", "__r"))


def exact_jaccard(left: DataFrame, right: DataFrame, *, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, ref, j) of all pairs at the threshold or more.

    Two sets at the threshold share one of each one's size - ceil(threshold * size) + 1
    first shingles, in any order that both follow: those of one side alone come first and
    fall out at once, then the rarer ones.  So a shingle that is common joins no rows, and
    candidates are verified on the whole sets.
    """
    sets = lambda df, name: written(spread(df).select(F.col("id").alias(name), T.gram_hashes(T.words("state"), n, whole=True).alias("s")).where(F.size("s") > 0), name)
    a, b = sets(left, "id"), sets(right, "ref")
    grams = lambda df, name: df.select(name, F.size("s").alias("size"), F.explode("s").alias("g"))
    of_a = written(grams(a, "id").join(grams(b, "ref").select("g").distinct(), "g", "left_semi"), "shared")
    of_b = written(grams(b, "ref").join(of_a.select("g").distinct(), "g", "left_semi"), "shared")
    often = of_a.select("g").union(of_b.select("g")).groupBy("g").agg(F.count("*").alias("n"))

    def first(df: DataFrame, name: str) -> DataFrame:
        ranked = df.join(often, "g").groupBy(name, "size").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("s"))
        alone = F.col("size") - F.size("s")
        prefix = F.col("size") - F.ceil(F.round(threshold * F.col("size"), 9)).cast("int") + 1 - alone
        return ranked.select(name, F.explode(F.slice("s", 1, F.greatest(prefix, F.lit(0)))).alias("x")).select(name, "x.g")

    met = first(of_a, "id").join(first(of_b, "ref"), "g").select("id", "ref").distinct()
    both = met.join(a, "id").join(b.withColumnRenamed("s", "t"), "ref").select("id", "ref", F.size("s").alias("na"), F.size("t").alias("nb"), F.size(F.array_intersect("s", "t")).alias("both"))
    return both.withColumn("j", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("j") >= threshold).select("id", "ref", "j")
