"""Maximal repetitions (runs) of a text's words, from Lempel-Ziv blocks.

A run is a stretch of words with smallest period q (words q apart are identical) that no
neighbouring word extends; runs of at least `min_length` words and `min_exponent`
periods (2 or more) are returned, all of them.

Method.  The suffix array of a document's words comes from prefix doubling; the ranks of
each doubling are kept, and give the longest common extension of two positions, to the
right as to the left, exactly.  Between neighbours in the suffix array those are the LCP
array; the nearest neighbours that begin earlier give the longest-previous-factor array
and each factor's earlier place, and so the LZ blocks.  A run that touches the beginning
or the end of a block is found from there by Main's extensions: for a boundary s and a
period p, the words before and from s are compared with those p further right, or left;
(min_exponent - 1) * p can't exceed the blocks on both sides, so all candidates together
are linear in the words.  A run inside a block is a copy of one at the block's earlier
place: runs lie in buckets by their first word, and block by block, from left to right,
those of the earlier place are copied.

A task takes documents together, in slices of SLICE_WORDS words or one longer document;
suffixes of different documents never compare equal.  Nothing is shuffled, and a task
holds no more than a batch and a slice (4 bytes a word and doubling, and doublings go no
further than the longest repeated stretch).

Defined results.  A null text, or one without words, has no runs and collapses to an
empty text.  Repeated rows give a row each, null ids are kept, extra columns ignored.
Runs are in order of their first word, then period.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, arrow_map, session, table

SLICE_WORDS = 400_000
#: Rounds of pointer jumping before a stack finishes the rest of a group.
ROUNDS = 32

Run = tuple[int, int, int]  # start, length, period


class Ranks:
    """Suffix array of several sequences on end, and the classes of all their blocks of 1, 2, 4, ... words."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        n = len(codes)
        self.n, self.begin = n, np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int64)
        end = np.repeat(np.cumsum(sizes), sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        key = doc * (int(codes.max()) + 1 if n else 1) + codes
        self.sa = np.argsort(key, kind="stable")
        head = np.ones(n, bool)
        head[1:] = key[self.sa][1:] != key[self.sa][:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.levels = [self._level(first, None)]
        self.head = first  # of each place in the suffix array, the first place of the same word
        slots = np.flatnonzero(~(head & np.r_[head[1:], True]))
        h = 1
        while len(slots):
            at, last = self.sa[slots], self.levels[-1]
            a = last[at].astype(np.int64)
            b = np.where(at + h < end[at], last[np.minimum(at + h, n)], -1)
            order = np.argsort(a * (n + 1) + b + 1, kind="stable")
            self.sa[slots] = at = at[order]
            a, b = a[order], b[order]
            new = np.ones(len(at), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = np.maximum.accumulate(np.where(new, slots, 0))
            self.levels.append(self._level(first, at))
            slots = slots[~(new & np.r_[new[1:], True])]
            h *= 2

    def _level(self, first: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        out = np.full(self.n + 1, -1, np.int32) if at is None else self.levels[-1].copy()
        out[self.sa if at is None else at] = first
        return out

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal from i and from j on; i < j in the same sequence, j may be its end."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):  # a class without an equal is no block's whole, so ends need no test
            q = np.minimum(j + out, self.n)
            out += (self.levels[k][i + out] == self.levels[k][q]) * np.int64(1 << k)
        return out

    def left(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Words that are equal before i and before j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            p = i - out - (1 << k)
            ok = p >= begin
            p = np.where(ok, p, 0)
            out += (ok & (self.levels[k][p] == self.levels[k][np.where(ok, j - out - (1 << k), 0)])) * np.int64(1 << k)
        return out


def _nearest_smaller(v: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of each place the nearest place before it with a smaller value, not under least (its group's first place); -1 for none.

    Places jump along what others have found; groups that take many rounds are finished by a stack.
    """
    p = np.arange(len(v)) - 1
    live = np.flatnonzero(p >= least)
    for _ in range(ROUNDS):
        live = live[v[p[live]] > v[live]]
        if not len(live):
            break
        p[live] = p[p[live]]
        live = live[p[live] >= least[live]]
    open_groups = np.zeros(len(v), bool)
    open_groups[least[live]] = True
    rest = np.flatnonzero(open_groups[least])
    if len(rest):
        stack: list[int] = []
        out, group = [], -1
        for i, x, g in zip(rest.tolist(), v[rest].tolist(), least[rest].tolist(), strict=True):
            if g != group:
                stack, group = [], g
            while stack and v[stack[-1]] > x:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            stack.append(i)
        p[rest] = out
    return np.where(p >= least, p, -1)


def previous_factors(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """LPF: for each word the length of the longest stretch from it that also begins earlier, and where."""
    n, sa = ranks.n, ranks.sa
    before = _nearest_smaller(sa, ranks.head)
    back = sa[::-1]
    tail = np.r_[ranks.head[1:] != ranks.head[:-1], True] if n else np.zeros(0, bool)
    last = np.minimum.accumulate(np.where(tail, np.arange(n), n)[::-1])  # of each place, mirrored, the last place of the same word
    after = _nearest_smaller(back, n - 1 - last)
    after = np.where(after >= 0, n - 1 - after, -1)[::-1]
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for near in (before, after):
        slots = np.flatnonzero(near >= 0)
        i, j = sa[near[slots]], sa[slots]
        common = ranks.right(i, j)
        longer = common > length[j]
        length[j[longer]], source[j[longer]] = common[longer], i[longer]
    return length, source


def lz_blocks(length: np.ndarray) -> np.ndarray:
    """Where the blocks begin: each is the longest previous factor, or one new word."""
    step, out, s = np.maximum(length, 1).tolist(), [], 0
    while s < len(step):
        out.append(s)
        s += step[s]
    return np.array(out, np.int64)


def _touching(ranks: Ranks, starts: np.ndarray, sizes: np.ndarray, min_length: int, min_exponent: int) -> dict[int, dict[int, int]]:
    """Runs that touch a block's beginning or end, by first word: end -> smallest period."""
    found: dict[int, dict[int, int]] = {}
    need = min(max(min_length - p, (min_exponent - 1) * p) for p in range(1, min_length + 1))
    level = ((need + 1) // 2).bit_length() - 1  # one of the extensions is at least half of what is needed
    if level >= len(ranks.levels) or not len(starts):
        return found
    n, same = ranks.n, ranks.levels[level]
    w = 1 << level
    ends = np.cumsum(sizes)
    ends = ends[sizes > 0]
    at = np.concatenate([starts, ends])  # the end of a sequence is a boundary too, with nothing behind it
    kind = np.r_[np.zeros(len(starts), np.int8), np.ones(len(ends), np.int8)]
    order = np.lexsort((kind * -1, at))
    at, kind = at[order], kind[order]
    begin = np.where(kind == 1, ranks.begin[at - 1], ranks.begin[np.minimum(at, n - 1)])
    size = np.where(kind == 1, 0, np.r_[at[1:], n] - at)
    past = np.where(at > begin, np.r_[0, at[1:] - at[:-1]], 0)
    # at an end both boundaries stand at one place, the end first: its block is the one before, the next sequence's has none
    most = (size + past) // (min_exponent - 1)
    for right in (True, False):
        top = np.minimum(most, size if right else at - begin)
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(top) // (4 * SLICE_WORDS))) + 1, len(top)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            t = top[lo:hi]
            s, b = np.repeat(at[lo:hi], t), np.repeat(begin[lo:hi], t)
            p = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t) + 1
            i, j = (s, s + p) if right else (s - p, s)
            back = i - w >= b
            may = same[i] == same[np.minimum(j, n)]
            may |= back & (same[np.where(back, i - w, 0)] == same[np.where(back, j - w, 0)])
            i, j, p, b = i[may], j[may], p[may], b[may]
            before, after = ranks.left(i, j, b), ranks.right(i, j)
            good = before + after >= np.maximum(min_length - p, (min_exponent - 1) * p)
            for x, y, q in zip((i - before)[good].tolist(), (j + after)[good].tolist(), p[good].tolist(), strict=True):
                mine = found.setdefault(x, {})
                mine[y] = min(q, mine.get(y, q))
    return found


def _copied(found: dict[int, dict[int, int]], starts: np.ndarray, length: np.ndarray, source: np.ndarray, min_length: int) -> None:
    """Adds the runs inside blocks: those of the earlier place, bucket by bucket; a block may overlap its earlier place."""
    order = sorted(found)
    if not order:
        return
    for s in starts[length[starts] >= min_length + 2].tolist():
        src, d = int(source[s]), s - int(source[s])
        end = src + int(length[s])
        heap = order[bisect_right(order, src) : bisect_left(order, end)]
        last = -1
        while heap:
            b = heapq.heappop(heap)
            if b == last:
                continue
            last = b
            for e, q in list(found[b].items()):
                if e < end:
                    if b + d not in found:
                        found[b + d] = {}
                        insort(order, b + d)
                        if b + d < end:
                            heapq.heappush(heap, b + d)
                    found[b + d].setdefault(e + d, q)


def runs_of(codes: np.ndarray, sizes: np.ndarray, min_length: int, min_exponent: int) -> list[list[Run]]:
    """The runs of each of the sequences that stand on end in codes."""
    out: list[list[Run]] = [[] for _ in range(len(sizes))]
    if not len(codes):
        return out
    ranks = Ranks(codes, sizes)
    length, source = previous_factors(ranks)
    starts = lz_blocks(length)
    found = _touching(ranks, starts, sizes, min_length, min_exponent)
    _copied(found, starts, length, source, min_length)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for b in sorted(found):
        begin = int(ranks.begin[b])
        out[doc[b]] += sorted(((b - begin, e - b, q) for e, q in found[b].items()), key=lambda r: r[2])
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, and each text's number of words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(real).dictionary_encode().indices.to_numpy().astype(np.int64), np.diff(before[offsets])


def periodic_runs(docs: DataFrame, *, min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and the collapsed text of each row."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    session(docs)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(batch["text"], "")
            spaces = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // (6 * SLICE_WORDS)
            cuts = [0, *(np.flatnonzero(np.diff(spaces)) + 1).tolist(), len(texts)]
            n, runs, kept = [], [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    codes, sizes = _coded(texts[lo:hi])
                    n += sizes.tolist()
                    part = runs_of(codes, sizes, min_length, min_exponent)
                    runs += part
                    kept += [collapsed(t.as_buffer().to_pybytes().split(), r).decode() for t, r in zip(texts[lo:hi], part, strict=True)]
            listed = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in runs]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(listed, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """The query's input: where crc32(doc_id) is divisible by 10, words from a on repeat with a period, a and the period by crc32(doc_id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    chosen = docs.withColumn("__g", F.floor(h / 10).cast("long")).withColumn("__words", F.when(h % 10 == 0, words))
    n = F.size("__words").cast("long")
    a = F.col("__g") % n
    p = 1 + F.expr("(size(__words) - __a) div (3 + __g % 8)")
    sized = chosen.withColumn("__a", F.when(n > 0, a)).withColumn("__p", F.when(n > 0, p))
    again = F.flatten(F.array_repeat(F.slice("__words", F.col("__a").cast("int") + 1, F.col("__p").cast("int")), F.ceil((n - F.col("__a")) / F.col("__p")).cast("int")))
    repeated = F.slice(F.concat(F.slice("__words", 1, F.col("__a").cast("int")), again), 1, n.cast("int"))
    return sized.withColumn("text", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))).drop("__g", "__words", "__a", "__p")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  runs come by start, then period: the first of equal ones stays
    first = F.element_at("runs", 1)
    best = F.when(F.size("runs") > 0, F.aggregate("runs", first, lambda x, y: F.when(better(y, x), y).otherwise(x)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        _digest(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"))
