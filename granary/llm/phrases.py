"""Collocations: phrases that occur more often together than their parts do, by language.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\n\\v\\f\\r]`, and pieces into
words at spaces and tabs.  Everything is counted for each language: n all words, f(phrase)
all contiguous occurrences within pieces, overlapping ones too.  Candidates have 2 to
max_n words and f >= min_count.  A cut after the first k words gives l = f(first part), r =
f(rest) and floor(1000000 * f^2 / (l * r)); the lowest-scoring cut counts, of equal ones
the one with the smallest k.  A candidate goes if a longer one (itself dropped or not)
holds its words contiguously and is at least half as frequent.

Counting is suffix-sigma.  Each word begins a suffix of at most max_n words; a task
counts equal suffixes of a slice of its documents before anything moves, deals them by
language and first word to parts, sorts each part's and packs it: a list of its words and
numbers into that list, compressed.  So a row that moves is a part's share of a slice (at
most one for each suffix).  A part unpacks its rows, numbers its words in reverse
lexicographic order, sorts by that, and counts all prefixes with one stack: equal
prefixes stand side by side, and one is closed where the next suffix doesn't share it.

Hot words.  The parts' suffixes are counted before they are sorted.  A part with more than
`LARGE` and four times the mean is unpacked row by row and dealt anew by the next word,
and what is still too large by the one after that.  In a part dealt by m words, counts of
prefixes of fewer than m words are partial; only those are added up by a second
aggregation.  Others are complete where they are counted, and go there if under min_count.

The scores join written tables by phrase, whose skewed partitions Spark splits.  Products
are decimals of 38 digits: exact up to a frequency of 4.6e15.  Ranking is done within
salted parts of a language first.

Defined results.  A null text is empty, a null lang is `und`; repeated rows and ids count
each time; extra columns are ignored; an empty table gives no rows.  Ties: score, then f,
both descending, then the phrase's UTF-8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, release_memory, session, table, written

#: Bytes of text whose suffixes are counted at once, and suffixes that any part may have.
SLICE_BYTES, LARGE = 8 << 20, 200_000
PIECES, SPACES = "[.,;:!?\n\x0B\f\r]", "[ \t]+"
PACKED = "part string, level int, lang string, suffixes long, words long, packed binary"


# ---- suffixes of a slice

def _counted(texts: pa.Array, langs: pa.Array, max_n: int) -> Iterator[tuple[str, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Of each language: its words, the different truncated suffixes as columns of word numbers (0: none, i: word i - 1), and how often each occurs."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), PIECES)
    words = pc.split_pattern_regex(pieces.flatten(), SPACES)
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    piece_at = before[words.offsets.to_numpy()]  # where pieces begin among the real words
    text_at = piece_at[pieces.offsets.to_numpy()]
    coded = flat.filter(real).dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64) + 1, len(coded)
    if not n:
        return
    end = np.repeat(piece_at[1:], np.diff(piece_at))
    lang = langs.dictionary_encode()
    of = np.repeat(lang.indices.to_numpy(), np.diff(text_at))
    names = coded.dictionary
    for g, name in enumerate(lang.dictionary.to_pylist()):
        at = np.flatnonzero(of == g)
        key, columns = np.zeros(len(at), np.int64), []
        for d in range(max_n):
            columns.append(np.where(at + d < end[at], code[np.minimum(at + d, n - 1)], 0))
            # numbers of the different prefixes so far, so that the key never outgrows 64 bits
            _, first, key = np.unique(key * (len(names) + 1) + columns[-1], return_index=True, return_inverse=True)
        if len(at):
            yield name, names, [c[first] for c in columns], np.bincount(key)


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in names.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint32, len(names))


def _pack(names: pa.Array, columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted suffixes: used words on end with their sizes, then the columns, compressed."""
    import zstandard

    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    words = names.take(pa.array(used - 1)).cast(pa.binary())
    number = lambda c: np.where(c > 0, np.searchsorted(used, np.maximum(c, 1)) + 1, 0).astype("<u4")
    spelled = b"".join(words.to_numpy(zero_copy_only=False))
    head = np.array([len(used), len(spelled), len(n)], "<u8")
    body = [head.tobytes(), pc.binary_length(words).to_numpy().astype("<u4").tobytes(), spelled, *[number(c).tobytes() for c in columns], n.astype("<u8").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpack(packed: bytes, max_n: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    import zstandard

    x = zstandard.ZstdDecompressor().decompress(packed)
    words, spelled, m = (int(v) for v in np.frombuffer(x, "<u8", 3))
    at = 24 + 4 * words
    offsets = np.r_[0, np.cumsum(np.frombuffer(x, "<u4", words, 24))].astype(np.int32)
    names = pa.Array.from_buffers(pa.binary(), words, [None, pa.py_buffer(offsets), pa.py_buffer(x[at : at + spelled])])
    at += spelled
    columns = [np.frombuffer(x, "<u4", m, at + 4 * m * d).astype(np.int64) for d in range(max_n)]
    return names.cast(pa.string()), columns, np.frombuffer(x, "<u8", m, at + 4 * m * max_n).astype(np.int64)


def _rows(above: list[str], level: int, lang: str, names: pa.Array, columns: list[np.ndarray], n: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """A row for each place: the suffixes dealt there, sorted."""
    order = np.lexsort([*columns[::-1], places])
    cuts = np.flatnonzero(np.r_[True, np.diff(places[order]) != 0, True])
    groups = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([
        pa.array(["/".join([*above, str(places[k[0]])]) for k in groups]), pa.array([level] * len(groups), pa.int32()), pa.array([lang] * len(groups)), pa.array([len(k) for k in groups], pa.int64()),
        pa.array([int(n[k].sum()) for k in groups], pa.int64()), pa.array([_pack(names, [c[k] for c in columns], n[k]) for k in groups], pa.binary())],
        names=["part", "level", "lang", "suffixes", "words", "packed"])


def suffixes(docs: DataFrame, max_n: int, parts: int) -> DataFrame:
    """PACKED: the suffixes of each slice, dealt by language and first word."""

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, langs = pc.fill_null(batch["text"], ""), pc.fill_null(batch["lang"], "und")
            place = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    for lang, names, columns, n in _counted(texts[lo:hi], langs[lo:hi], max_n):
                        dealt = (_hashes(names) ^ np.uint32(zlib.crc32(lang.encode())))[columns[0] - 1].astype(np.int64) % parts
                        yield _rows([], 1, lang, names, columns, n, dealt)

        return step

    return arrow_map(docs.select("text", F.col("lang").cast("string").alias("lang")), make, PACKED)


def _dealt_anew(large: DataFrame, max_n: int) -> DataFrame:
    """The rows of large parts (with `ways`, into how many), dealt by one more word."""

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for r in batch.to_pylist():
                names, columns, n = _unpack(r["packed"], max_n)
                h = np.r_[np.uint32(0), _hashes(names)][columns[r["level"]]].astype(np.int64)
                yield _rows([r["part"]], r["level"] + 1, r["lang"], names, columns, n, h % r["ways"])

        return step

    return arrow_map(large, make, PACKED)


def balanced(rows: DataFrame, max_n: int, parts: int) -> DataFrame:
    """rows with large parts dealt by more words; see the module's text."""
    done = []
    for _ in range(max_n - 1):
        sizes = written(rows.groupBy("part").agg(F.sum("suffixes").alias("size")), "sizes")
        limit = max(LARGE, 4 * (sizes.agg(F.sum("size")).first()[0] or 0) // parts)
        large = sizes.where(F.col("size") > limit).select("part", F.ceil(F.col("size") / limit).cast("long").alias("ways"))
        if large.isEmpty():
            break
        done.append(rows.join(large, "part", "left_anti"))
        rows = written(_dealt_anew(rows.join(large, "part"), max_n), "suffixes")
    for d in done:
        rows = rows.unionByName(d)
    return rows


# ---- the stack

def prefix_counts(names: pa.Array, columns: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Words and counts of all prefixes, by length; columns are numbers of names (0: none)."""
    # numbers by reverse lexicographic order, so that sorting numbers sorts suffixes so; none comes last
    order = pc.array_sort_indices(names, order="descending").to_numpy()
    rank = np.empty(len(names) + 1, np.int64)
    rank[order + 1] = np.arange(len(names))
    rank[0] = len(names)
    ranked = [rank[c] for c in columns]
    by = np.lexsort(ranked[::-1])
    n, changed = n[by], np.zeros(len(by), bool)
    changed[0] = True
    named = names.take(pa.array(order))
    words: list[np.ndarray] = []
    for c in ranked:
        c = c[by]
        words.append(c)
        changed[1:] |= c[1:] != c[:-1]  # here the stack closes the open prefix of this length, and all longer ones
        at = np.flatnonzero(changed)
        sums = np.add.reduceat(n, at)
        there = c[at] < len(names)
        at, sums = at[there], sums[there]
        yield [named.take(pa.array(w[at])) for w in words], sums


def _counts_of_part(table: pa.Table, max_n: int, min_count: int) -> pa.Table:
    """lang, words, n, partial of one part: all prefixes that are partial or frequent."""
    kind = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.int64()), ("partial", pa.bool_())])
    out = []
    for lang in table["lang"].unique().to_pylist():
        mine = table.filter(pc.equal(table["lang"], lang))
        level = mine["level"][0].as_py()
        rows = [_unpack(x.as_py(), max_n) for x in mine["packed"]]
        merged = pa.chunked_array([r[0] for r in rows]).combine_chunks().dictionary_encode()
        to = merged.indices.to_numpy().astype(np.int64) + 1
        starts = np.cumsum([0, *[len(r[0]) for r in rows]])
        columns = [np.concatenate([np.r_[0, to[s : s + len(r[0])]][r[1][d]] for s, r in zip(starts, rows, strict=False)]) for d in range(max_n)]
        for d, (words, sums) in enumerate(prefix_counts(merged.dictionary, columns, np.concatenate([r[2] for r in rows])), 1):
            keep = np.ones(len(sums), bool) if d < level else sums >= min_count
            m = int(keep.sum())
            where = pa.array(np.flatnonzero(keep))
            flat = pa.concat_arrays([w.take(where) for w in words]).take(pa.array((np.arange(m)[:, None] + m * np.arange(d)[None, :]).ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * d + 1, d), pa.int32()), flat)
            out.append(pa.table([pa.array([lang] * m, pa.string()), lists, pa.array(sums[keep].astype(np.int64)), pa.array([d < level] * m, pa.bool_())], schema=kind))
    release_memory()
    return pa.concat_tables(out) if out else kind.empty_table()


def phrase_counts(docs: DataFrame, *, max_n: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """Two tables: lang, words (1 to max_n), n of all phrases that occur min_count times or more; and lang, total (all words)."""
    spark = session(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(suffixes(docs, max_n, 2 * parts), "suffixes")
    totals = written(rows.groupBy("lang").agg(F.sum("words").alias("total")), "totals")
    counted = balanced(rows, max_n, 2 * parts).groupBy("part").applyInArrow(lambda t: _counts_of_part(t, max_n, min_count), "lang string, words array<string>, n long, partial boolean")
    counted = written(counted, "counted")
    joined = counted.where("partial").groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return written(counted.where("not partial").select("lang", "words", "n").union(joined), "phrases"), totals


# ---- scores

def collocations(docs: DataFrame, *, max_n: int = 3, min_count: int = 10, inside_percent: int = 50, first: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases; see the module's text."""
    spark = session(docs)
    counts, totals = phrase_counts(docs, max_n=max_n, min_count=min_count)
    candidates = counts.where(F.size("words") > 1).withColumnRenamed("n", "a")
    # the largest count of a longer candidate around each
    spans = [(i, k) for m in range(3, max_n + 1) for k in range(2, m) for i in range(1, m - k + 2)]
    if spans:
        inner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in dict.fromkeys(spans)])
        inside = candidates.where(F.size("words") > 2).select("lang", "words", "a", F.explode(inner).alias("s")).where("s.k < size(words) and s.i + s.k - 1 <= size(words)")
        around = inside.groupBy("lang", F.expr("slice(words, s.i, s.k)").alias("words")).agg(F.max("a").alias("longer"))
        candidates = candidates.join(around, ["lang", "words"], "left").where(F.expr(f"longer is null or 100 * longer < {inside_percent} * a")).drop("longer")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(words, 1, k)").alias("left"), F.expr("slice(words, k + 1, size(words) - k)").alias("right"))
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("words").alias(side), F.col("n").alias(f)), ["lang", side])
    score = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = lowest.select("lang", F.array_join("words", " ").alias("phrase"), "a", "c.l", "c.r", "c.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = scored.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*best))).where(F.col("rank") <= first).drop("__salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \x09]+') IF x <> ''] AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
counts AS (
  SELECT lang, words, count(*) AS f FROM (SELECT lang, unnest([w[i:i + k] FOR k IN range(0, least(3, len(w) - i + 1))]) AS words FROM placed) GROUP BY lang, words),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE len(words) = 1 GROUP BY lang),
candidates AS (SELECT lang, words, f AS a FROM counts WHERE len(words) > 1 AND f >= 10),
around AS (
  SELECT lang, part, max(a) AS longer FROM (SELECT lang, unnest([words[1:2], words[2:3]]) AS part, a FROM candidates WHERE len(words) = 3) GROUP BY lang, part),
kept AS (SELECT c.* FROM candidates c LEFT JOIN around o ON o.lang = c.lang AND o.part = c.words WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT *, unnest(range(1, len(words))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.words, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.words = c.words[1:c.k] JOIN counts y ON y.lang = c.lang AND y.words = c.words[c.k + 1:]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score FROM lowest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n::BIGINT AS n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
