"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles of `width` words, as 64-bit hashes.  A
signature has `bands * rows` coordinates that come from two permutations of the
universe of 2^32 positions: sigma (the upper half of a shingle's hash) breaks up its
structure, and pi, circularly shifted by k, gives coordinate k as the least
pi(sigma(x) + k mod 2^32).  Documents that agree in a band are candidates; a link needs
100 * intersection >= percent * union on the full sets.

With 30 bands of 5 coordinates a pair at a similarity of 0.85 is missed with a
probability of 2.3e-8 (0.5563^30), at 0.80 with 5.5e-6; larger similarities less.

Scale.  Equal sets are one class, and only its smallest id goes on.  A bucket (band,
key) doesn't give all its pairs: it first gives each member one pair with a leader, and
the verified links are joined to components.  Buckets whose members are in several
components then get their members' sets, and every pair in different components is
compared there; only links that join components come out.  So every pair that shares a
bucket is verified or connected already.  A large bucket is dealt into blocks, its
largest component's apart from the others'.  Hot buckets and leaders meet in joins of written tables whose
large partitions Spark can split.  Nothing about links or components reaches the driver
but counts.

Defined results.  A null text, or one without words, has an empty set: n_shingles 0,
its own component, linked with nothing.  With fewer words than `width` the whole
sequence is the one shingle.  Rows with a null doc_id can't be named: they are linked
with nothing, have a null component, and are kept.  Repeated ids: the rows of an id
share the component of all their texts.  Extra columns are ignored by classes() and
kept by keep_first().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, session, table, written


class _Words(dict):
    """Word -> 64-bit hash, kept until there are many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 300_000:
            self.clear()
        self[word] = h
        return h


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles."""
    words = _Words()
    get = words.__getitem__
    out = []
    odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(width)]
    for text in texts:
        tokens = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
        n = len(tokens)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(get, tokens), np.uint64, n)
        if n < width:
            # the sequence as one; the count keeps it apart from longer ones
            s = np.array([n], np.uint64)
            for i in range(n):
                s += _mix64(h[i : i + 1] * odd[i])
            out.append(_mix64(s))
            continue
        s = _mix64(h[: n - width + 1] * odd[0])
        for i in range(1, width):
            s += _mix64(h[i : n - width + 1 + i] * odd[i])
        out.append(np.unique(_mix64(s)))
    return out


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """[documents, size] circulant MinHash coordinates; the sets mustn't be empty."""
    out = np.empty((len(sets), size), np.uint32)
    at = 0
    while at < len(sets):
        upto, n = at, 0
        while upto < len(sets) and (upto == at or n + len(sets[upto]) <= 32_768):  # what fits a core's cache
            n += len(sets[upto])
            upto += 1
        x = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[at : upto - 1]])
        for k in range(size):
            out[at:upto, k] = np.minimum.reduceat(_pi(x + np.uint32(k + 1)), starts)
        at = upto
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[documents, bands] 64-bit keys."""
    s = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.zeros(s.shape[:2], np.uint64)
    for r in range(rows):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def described(docs: DataFrame, *, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set), keys (one for each band) of each row."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        import xxhash

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch["text"].to_pylist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list[np.ndarray | None] = [None] * len(sets)
            if full:
                for i, k in zip(full, band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows), strict=True):
                    keys[i] = k
            return pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_hash", "keys"],
            )

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_shingles long, set_hash binary, keys array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes, packed) of the documents in ids (doc_id, set_hash), one row for each set."""
    import xxhash

    schema = "doc_id long, set_hash binary, shingles binary"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [s.tobytes() for s in shingle_sets(batch["text"].to_pylist(), width)]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([xxhash.xxh3_128_digest(x) for x in packed], pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "set_hash", "shingles"])

        return step

    rows = arrow_map(texts, make, schema)
    # an id that is repeated with another text: only the row of this set
    return written(rows.join(ids.hint("shuffle_hash"), ["doc_id", "set_hash"], "left_semi").select("doc_id", "shingles"), "sets")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids those whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)) if len(q) else 0
                ok.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            return pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return step

    return arrow_map(both.select("a", "b", "sa", "sb"), make, "a long, b long")


def bucket_links(rep: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of one bucket's members, every pair in different components compared on full sets.

    The largest component's members needn't be asked: each other one is compared with
    all members at once, by the lists of documents that hold its shingles.  A document
    of whose shingles the others have too few can't be linked.
    """
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(token)
    shared = np.add.reduceat((held[token] > 1).astype(np.int64), starts)
    can = np.flatnonzero(100 * shared >= percent * size)
    if len(can) < 2:
        return []
    label = np.unique(comp, return_inverse=True)[1]
    main = np.bincount(label[can]).argmax()
    by_token = np.argsort(token, kind="stable")
    doc = np.repeat(np.arange(len(sets)), size)[by_token]
    at = np.cumsum(held) - held
    out = []
    for x in can[np.argsort(-shared[can] / size[can], kind="stable")]:
        if label[x] == main:
            continue
        mine = token[starts[x] : starts[x] + size[x]]
        mine = mine[held[mine] > 1]
        common = np.bincount(np.concatenate([doc[at[t] : at[t] + held[t]] for t in mine]), minlength=len(sets))
        for y in np.flatnonzero((100 * common >= percent * (size[x] + size - common)) & (label != label[x])):
            p, q = label[x], label[y]
            if p != q:
                out.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y]))))
                label[label == (p if q == main else q)] = q if q == main else p
    return out


def open_links(placed: DataFrame, sets: DataFrame, percent: int, block: int, tasks: int) -> DataFrame:
    """Links (a, b) between components that meet in a bucket, of placed: band, key, rep, comp, main (the bucket's largest component), n_main, n_rest.

    Members of the main component are one side, the others both: each block of others
    meets each block of the main component and each block of others in a place of its
    own.  So a hot bucket's main component moves once for each block of others, of which
    there is mostly one.  Small buckets share a task's group.
    """
    blocks = lambda n: F.ceil(F.greatest(F.col(n), F.lit(1)) / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    place = lambda i, side, j: F.struct(i.cast("int").alias("i"), F.lit(side).alias("side"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    x = placed.withColumn("mb", F.when(F.col("n_main") > 0, blocks("n_main")).otherwise(0)).withColumn("sb", blocks("n_rest"))
    rest = own(F.col("sb"))
    places = F.when(F.col("comp") == F.col("main"), F.transform(upto(F.col("sb")), lambda i: place(i, 0, own(F.col("mb"))))).otherwise(
        F.concat(F.transform(upto(F.col("mb")), lambda j: place(rest, 0, j)), F.transform(upto(F.col("sb")), lambda j: place(F.least(rest, j), 1, F.greatest(rest, j)))))
    dealt = x.select("band", "key", "rep", "comp", F.explode(places).alias("p")).select("band", "key", "rep", "comp", "p.*")
    dealt = dealt.join(sets.toDF("rep", "shingles"), "rep").withColumn("task", F.pmod(F.xxhash64("band", "key", "i", "side", "j"), F.lit(tasks)))

    def group(t: pa.Table) -> pa.Table:
        band, key, i, side, j, rep, comp = (t[k].to_numpy() for k in ("band", "key", "i", "side", "j", "rep", "comp"))
        order = np.lexsort((rep, j, side, i, key, band))
        new = np.ones(len(order), bool)
        for v in (band, key, i, side, j):
            new[1:] &= v[order][1:] == v[order][:-1]
        new = ~new
        new[0] = True
        packed = t["shingles"].combine_chunks()
        out: list[tuple[int, int]] = []
        cuts = [*np.flatnonzero(new), len(order)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            k = order[lo:hi]
            if hi - lo > 1:
                out += bucket_links(rep[k], comp[k], [np.frombuffer(packed[int(r)].as_buffer(), np.uint64) for r in k], percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return dealt.groupBy("task").applyInArrow(group, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): the smallest id that is reachable.  Alternates large and small stars until nothing changes."""

    def state(e: DataFrame) -> tuple[int, int]:
        r = e.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        return r.n, r.x

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", "m")).distinct(), "edges")
        before, now = now, state(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def classes(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, block: int = 500) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; see the module's text."""
    session(docs)
    everything = written(described(docs, width=width, bands=bands, rows=rows), "described")
    base = everything.where("doc_id is not null")
    sets = written(base.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "sets_of")
    reps = base.join(sets.select("set_hash", F.col("rep").alias("doc_id")), ["set_hash", "doc_id"]).dropDuplicates(["set_hash"])
    buckets = reps.select(F.col("doc_id").alias("rep"), F.posexplode("keys").alias("band", "key"))
    shared = written(buckets.groupBy("band", "key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1"), "leaders")
    members = written(buckets.join(shared, ["band", "key"]), "members")  # band, key, rep, leader, size; only buckets of two or more
    ids = members.select(F.col("rep").alias("doc_id")).distinct().join(reps.select("doc_id", "set_hash"), "doc_id")
    full = full_sets(docs, written(ids, "ids"), width)
    # one leader for each member first: most links come from these
    first = members.where("rep <> leader").groupBy("rep").agg(F.min("leader").alias("leader"))
    links = written(linked(first.select(F.col("leader").alias("a"), F.col("rep").alias("b")), full, percent), "links")
    named = written(connected(links), "named")
    placed = written(members.join(named, members["rep"] == named["id"], "left").select("band", "key", "size", "rep", F.coalesce("component", "rep").alias("comp")), "placed")
    # buckets whose members are in several components, one of those with the same members
    parts = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.min("rep").alias("r0"), F.max("rep").alias("r1"), F.bit_xor(F.xxhash64("rep")).alias("x"))
    mixed = parts.groupBy("band", "key").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.bit_xor("x").alias("x")).where("comps > 1")
    mixed = mixed.groupBy("n", "r0", "r1", "x").agg(F.min(F.struct("band", "key", "main")).alias("b")).select("b.band", "b.key", F.col("b.main.comp").alias("main"), F.col("b.main.n").alias("n_main"), (F.col("n") - F.col("b.main.n")).alias("n_rest"))
    placed = placed.select("band", "key", "rep", "comp").join(written(mixed, "mixed"), ["band", "key"])
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.union(written(open_links(placed, full, percent, block, tasks), "links"))
    # ids of equal sets, and repeated ids, are linked as well
    same = base.join(sets, "set_hash").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    named = written(connected(links.union(same.distinct())), "named")
    return everything.join(named, everything["doc_id"] == named["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, **options: int) -> DataFrame:
    """docs without the rows of a class whose doc_id isn't its smallest, with all columns.

    All rows of the smallest doc_id stay where that is repeated; rows without doc_id are compared with nothing and all stay.
    """
    drop = classes(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(written(drop, "drop"), docs["doc_id"] == F.col("__id"), "left_anti")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), width=3, percent=85).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
