"""Finds windows of `length` consecutive tokens that also start in a document with a smaller id, in four passes.

Anchors.  A window's anchor is its token group of `group` tokens with the least hash
(the leftmost of those).  It depends on the window alone, so equal windows have equal
anchors; consecutive windows mostly share one, and such a run with all the tokens that
its windows cover is a *phrase*.  Phrases stand for their windows: about 2 / (length -
group + 2) of them for each token.

The sketch.  Each block of documents sends its anchors, dealt by hash; a task merges its
share in a count-min sketch, which never counts too little, and answers each block how
often its anchors occur.  A window is in no more documents than its anchor, so windows
whose anchor is counted in one document only are done with, and none is lost.

Substring dedup of words sketches the windows themselves, too: each block counts its
windows in a count-min sketch, cuts it by ranges of counters, a task merges a range of all
blocks' sketches, and answers each block whether the counters that it hit are 2 or more.
A window that all rows count once is in one place only; a phrase of such windows alone is
done with.

Phrases.  Each different phrase that is left, as a 128-bit hash of its bytes, is dealt by
that hash; an occurrence in a larger document than the smallest is removed whole.  Where
an anchor occurs in other phrases too (at the ends of a passage), the windows of the
phrase's first occurrence are compared one by one: dealt by anchor, or each on its own
where the sketch counts an anchor HOT times or more.  The last pass turns the answers
into covered tokens.

Work is dealt into pieces that follow the texts' bytes, however many shuffle partitions
there are; a task takes the pieces that it gets one after another.  What a piece gathers is
its share of hashes: each block sends an anchor, phrase or hot
window once, so a passage that a third of all documents holds gives a row for each
block, not for each document, and a hot anchor's neighbours are dealt over all tasks.

Blocks of documents are a bucketed table whose files lie in the shared folder; each pass
joins its answers to it without moving texts.  Table, blocks and answers are dropped at
the end, whether the result could be written or not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, delete_path, release_memory, session, work_path, written

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Window starts that are worked on at a time.
CHUNK = 1 << 18
#: Bytes of text in a block of documents; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text for each piece that the work is dealt into.
PIECE_BYTES = 12 << 20
#: Counts beyond this are not told apart.
MANY = 65_535
#: Occurrences of an anchor from which its windows are dealt each on its own: fewer are some MB of a task.
HOT = MANY
#: Bytes of phrases whose windows a task compares at a time.
COMPARED_BYTES = 1 << 20
#: The id of documents without one: larger than any other.
NO_ID = np.iinfo(np.int64).max

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xCF1BBCDCB7A56463)
    x ^= x >> U(32)
    return x


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and _BASE^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", _INV)):
            x = np.full(n, b, U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


#: A 64-bit number for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Tokens:
    """Tokens as 64-bit numbers (for anchors only), the first of each document, and each one's place in data (ends exclusive; None: a byte each)."""

    numbers: np.ndarray
    bounds: np.ndarray
    data: bytes
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def places(self, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where the bytes of tokens first to last begin and end."""
        a, b = (first, last + 1) if self.starts is None else (self.starts[first], self.ends[last])
        return zip(a.tolist(), b.tolist(), strict=True)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """[n, 2] 128-bit hashes of the bytes of tokens first to last."""
        import xxhash

        view, digest = memoryview(self.data), xxhash.xxh3_128_digest
        got = [b"".join([digest(view[a:b]) for a, b in self.places(first[i : i + CHUNK], last[i : i + CHUNK])]) for i in range(0, len(first), CHUNK)]
        return np.frombuffer(b"".join(got), U).reshape(-1, 2)


def window_numbers(numbers: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number of each window of length tokens, equal for equal windows; windows across documents are there, too."""
    m = len(numbers) - length + 1
    up, down = power(CHUNK + 8 * length)
    out = []
    for lo in range(0, max(m, 0), CHUNK):
        tok = numbers[lo : min(lo + CHUNK, m) + length - 1]
        total = np.zeros(len(tok) + 1, U)
        np.cumsum(tok * up[: len(tok)], out=total[1:])
        out.append(mix((total[length:] - total[:-length]) * down[: len(tok) - length + 1]))
    return np.concatenate(out) if out else np.empty(0, U)


#: Rows of the windows' sketch, and counters of each row that a task merges.
DEPTH, COUNTERS = 2, 1 << 24


class Phrases:
    """The phrases of a token sequence in which document d has tokens bounds[d] to bounds[d+1].

    first, last: the first and last window start; anchor, at: its hash and place; doc: the document.
    """

    def __init__(self, numbers: np.ndarray, bounds: np.ndarray, length: int, group: int) -> None:
        self.length = length
        m = len(numbers) - length + 1
        parts = [self._chunk(numbers, at, min(at + CHUNK, m), bounds, group) for at in range(0, max(m, 0), CHUNK)]
        self.first, self.last, self.anchor, self.doc, self.at = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, U if i == 2 else np.int64) for i in range(5))

    def _chunk(self, numbers: np.ndarray, lo: int, hi: int, bounds: np.ndarray, group: int) -> tuple[np.ndarray, ...]:
        length, m = self.length, hi - lo
        tok = numbers[lo : hi + length - 1]
        up, down = power(CHUNK + 8 * length)
        total = np.empty(len(tok) + 1, U)
        total[0] = 0
        np.cumsum(tok * up[: len(tok)], out=total[1:])
        h = mix((total[group:] - total[:-group]) * down[: len(tok) - group + 1])
        low = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=U)
        span, have = length - group + 1, 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[:m], low[span - have : span - have + m])
        at = (low & U(0xFFFFFF)).astype(np.int64)
        d0, d1 = np.searchsorted(bounds, (lo, hi - 1), "right") - 1
        own = np.clip(bounds[d0 : d1 + 2], lo, hi)
        doc = np.repeat(np.arange(d0, d1 + 1), np.diff(own))
        fits = np.arange(lo, hi) <= np.repeat(bounds[d0 + 1 : d1 + 2] - length, np.diff(own))
        cut = np.empty(m, bool)
        cut[0] = True
        cut[1:] = (at[1:] != at[:-1]) | (fits[1:] != fits[:-1])
        cut[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(cut)
        last = np.append(first[1:], m) - 1
        keep = fits[first]
        first, last = first[keep], last[keep]
        return first + lo, last + lo, h[at[first]], doc[first], at[first] + lo


def bucket_of(number: int, buckets: int) -> int:
    """The bucket of a table that Spark puts a long into: its Murmur3 hash (seed 42), modulo."""
    mask = 0xFFFFFFFF
    rotate = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    h = 42
    for part in (number & mask, (number >> 32) & mask):
        k = rotate(part * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (rotate(h ^ k, 13) * 5 + 0xE6546B64) & mask
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & mask
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def pieces(docs: DataFrame) -> int:
    """How many pieces the work is dealt into: the shuffle partitions, and more where these would get more than PIECE_BYTES of text each."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE_BYTES))


def blocks(docs: DataFrame, name: str, path: str, n: int) -> DataFrame:
    """block, ids, texts: documents packed by size, in a bucketed table `name` at path, of n buckets.

    Blocks are numbered so that they go round the buckets, whatever the size of the
    input's partitions: no text is shuffled, and yet each later join by block finds the
    table dealt as it needs it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    session(docs)
    parts = docs._jdf.rdd().getNumPartitions()  # noqa: SLF001

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, bucket = part << 36, part % n
        ids: list[int | None] = []
        texts: list[str] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number, bucket
            number += 1
            while bucket_of(number, n) != bucket:
                number += 1
            bucket = (bucket + parts) % n
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], names=["block", "ids", "texts"])

        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                t = t or ""
                if ids and (size + len(t) > BLOCK_BYTES or len(ids) >= 65_535):
                    yield out()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield out()
        del ids, texts
        release_memory()

    packed = docs.mapInArrow(pack, "block long, ids array<long>, texts array<string>")
    # the size of a row group is looked at after each row, not after the first hundred, which may be 400 MB
    small = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    packed.write.bucketBy(n, "block").options(**small).option("path", path).saveAsTable(name)
    return docs.sparkSession.table(name)


_SENT = pa.schema([("task", pa.int32()), ("block", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
_SENT_SQL = "task int, block long, docs binary, keys binary, counts binary"
_ANSWER = pa.schema([("block", pa.int64()), ("task", pa.int32()), ("round", pa.int32()), ("data", pa.binary())])
_ANSWER_SQL = "block long, task int, round int, data binary"


def _deltas(doc: np.ndarray) -> bytes:
    return np.diff(doc, prepend=np.int64(0)).tobytes()  # small numbers, which Spark's shuffle compresses


def _by_task(task: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by task, and where each task's part of it begins."""
    order = np.argsort(task, kind="stable")
    return order, np.searchsorted(task[order], np.arange(tasks + 1))


class Block:
    """A block's anchors, phrases and windows as the passes need them, each dealt to tasks; answers: what the earlier passes said."""

    def __init__(self, ids: list[int | None], tokens: Tokens, length: int, group: int, tasks: int, sketch: bool = False) -> None:
        self.sketch = sketch
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.tokens, self.tasks, self.length = tokens, tasks, length
        self.phrases = Phrases(tokens.numbers, tokens.bounds, length, group)

    # -- anchors

    def deal_anchors(self) -> None:
        """anchor: the different ones, anchor_of: of each phrase its own; by task."""
        self.anchor, self.anchor_of = np.unique(self.phrases.anchor, return_inverse=True)
        self.anchor_order, self.anchor_starts = _by_task((mix(self.anchor ^ U(0x5851F42D4C957F2D)) % U(self.tasks)).astype(np.int64), self.tasks)

    def deal_sketch(self) -> None:
        """This block's sketch of its windows: of each row the counters that aren't 0, in order, their values, and each window's counter; and where tasks' ranges begin."""
        import zstandard

        self.compressed = zstandard.ZstdCompressor(level=1).compress
        p = self.phrases
        n = p.last - p.first + 1
        self.phrase_starts = np.cumsum(n) - n
        start = np.repeat(p.first - self.phrase_starts, n) + np.arange(int(n.sum()))
        h = window_numbers(self.tokens.numbers, self.length)[start]
        self.counters = []
        for d in range(DEPTH):
            c = (mix(h + U((0x9E3779B97F4A7C15 * (d + 7)) & 0xFFFFFFFFFFFFFFFF)) % U(self.tasks * COUNTERS)).astype(np.int64)
            own, of, value = np.unique(c, return_inverse=True, return_counts=True)
            self.counters.append((own, value, of, np.searchsorted(own, np.arange(self.tasks + 1) * COUNTERS)))

    def sketch_part(self, k: int) -> bytes:
        """What task k merges of this block's sketch: for each row the number of counters, their distances and their values."""
        parts = []
        for own, value, _, cut in self.counters:
            s = slice(cut[k], cut[k + 1])
            parts.append(np.array([s.stop - s.start], np.uint32).tobytes() + np.diff(own[s] - k * COUNTERS, prepend=0).astype(np.uint32).tobytes() + np.minimum(value[s], 255).astype(np.uint8).tobytes())
        return self.compressed(b"".join(parts))

    def maybe_repeated(self, bits: dict[int, bytes]) -> np.ndarray:
        """Of each phrase whether the merged sketch counts one of its windows twice or more."""
        flag = np.ones(int(self.phrases.last.sum() - self.phrases.first.sum()) + len(self.phrases.first), bool)
        said = [np.zeros(len(own), bool) for own, _, _, _ in self.counters]
        for k, packed in bits.items():
            sizes = [int(cut[k + 1] - cut[k]) for _, _, _, cut in self.counters]
            got = np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool)
            for d, part in enumerate(_split(got, np.array(sizes))):
                said[d][self.counters[d][3][k] : self.counters[d][3][k + 1]] = part
        for d, (_, _, of, _) in enumerate(self.counters):
            flag &= said[d][of]
        return np.logical_or.reduceat(flag, self.phrase_starts) if len(self.phrase_starts) else np.empty(0, bool)

    def sent_anchors(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """task, this block's sketch (if asked for), of each anchor a 31-bit cell and whether several documents of the block have it, how often it occurs."""
        n = np.minimum(np.bincount(self.anchor_of, minlength=len(self.anchor)), MANY)
        several = np.zeros(len(self.anchor), U)
        if len(self.anchor):
            order = np.argsort(self.anchor_of, kind="stable")
            doc, starts = self.ids[self.phrases.doc[order]], np.searchsorted(self.anchor_of[order], np.arange(len(self.anchor)))
            several = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)).astype(U)
        cell = ((mix(self.anchor + U(0x9E3779B97F4A7C15)) >> U(33)) << U(1) | several).astype(np.uint32)
        for k in range(self.tasks):
            x = self.anchor_order[self.anchor_starts[k] : self.anchor_starts[k + 1]]
            part = self.sketch_part(k) if self.sketch else b""
            if len(x) or self.sketch:
                yield k, part, cell[x].tobytes(), n[x].astype(np.uint16).tobytes()

    # -- phrases

    def deal_phrases(self, answers: list[dict]) -> None:
        """The phrases whose anchor may be in several documents (`of`) and their classes of equal ones; a class stands for its first occurrence, in `rep`."""
        self.deal_anchors()
        count, bits = np.zeros(len(self.anchor), np.int64), {}
        for x in answers:
            if x["round"] == 0:
                mine = self.anchor_order[self.anchor_starts[x["task"]] : self.anchor_starts[x["task"] + 1]]
                count[mine] = np.frombuffer(x["data"], np.uint16, len(mine))
                bits[x["task"]] = x["data"][2 * len(mine) :]
        p = self.phrases
        wanted = count[self.anchor_of] > 0
        if self.sketch:
            self.deal_sketch()
            wanted &= self.maybe_repeated(bits)
        self.of = np.flatnonzero(wanted)
        h = self.tokens.hashes(p.first[self.of], p.last[self.of] + self.length - 1)
        doc = self.ids[p.doc[self.of]]
        task = (h[:, 0] % U(self.tasks)).astype(np.int64)
        order = np.lexsort((doc, h[:, 1], h[:, 0], task))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]).any(axis=1)
        self.class_of = np.empty(len(order), np.int64)
        self.class_of[order] = np.cumsum(new) - 1
        self.rep, self.hash = self.of[order[new]], h[order[new]]
        self.doc = self.ids[p.doc[self.rep]]
        self.occurs = np.bincount(self.class_of, minlength=len(self.rep))
        self.anchor_count = count[self.anchor_of[self.rep]]
        self.larger = doc > self.doc[self.class_of] if len(order) else np.empty(0, bool)
        self.starts = np.searchsorted(task[order[new]], np.arange(self.tasks + 1))

    def sent_phrases(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """task, documents, hashes, occurrences of the different phrases."""
        n = np.minimum(self.occurs, MANY).astype(np.uint16)
        for k in range(self.tasks):
            s = slice(self.starts[k], self.starts[k + 1])
            if s.start < s.stop:
                yield k, _deltas(self.doc[s]), self.hash[s].tobytes(), n[s].tobytes()

    # -- windows

    def deal_windows(self, answers: list[dict], wide: bool) -> None:
        """Units of windows: whole phrases (only if wide), or single windows; unit_first, unit_n: their windows; window: of each class that is asked about, the (unit, place) of its windows."""
        self.deal_phrases(answers)
        seen = np.zeros(len(self.rep), np.int64)
        for x in answers:
            if x["round"] == 1:
                seen[self.starts[x["task"]] : self.starts[x["task"] + 1]] = np.frombuffer(x["data"], np.uint16)
        self.gone = seen == 0  # a smaller document has the phrase
        p = self.phrases
        asked = np.flatnonzero(~self.gone & ((seen < self.anchor_count) | (self.anchor_count >= MANY)))
        whole = (self.anchor_count[asked] < HOT) & wide
        self.asked = np.concatenate([asked[whole], asked[~whole]])
        a, b = p.first[self.rep[asked[whole]]], p.last[self.rep[asked[whole]]]
        task_a = (mix(p.anchor[self.rep[asked[whole]]] ^ U(0x2545F4914F6CDD1D)) % U(self.tasks)).astype(np.int64)
        # single windows, the different ones with their smallest document
        f, n = p.first[self.rep[asked[~whole]]], (p.last - p.first + 1)[self.rep[asked[~whole]]]
        start = np.repeat(f, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.repeat(self.doc[asked[~whole]], n)
        h = self.tokens.hashes(start, start + self.length - 1)
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]).any(axis=1)
        one = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        self.unit_first, self.unit_n = np.concatenate([a, start[one]]), np.concatenate([b - a + 1, np.ones(len(one), np.int64)])
        self.unit_doc = np.concatenate([self.doc[asked[whole]], doc[one]])
        self.unit_hash = np.concatenate([np.zeros((len(a), 2), U), h[one]])
        task = np.concatenate([task_a, ((h[one, 0] ^ h[one, 1]) % U(self.tasks)).astype(np.int64)])
        # where a unit's anchor is (63: not said); units of equal windows are in one lane, and a task compares lanes one after another
        self.unit_offset = np.concatenate([p.at[self.rep[asked[whole]]] - a, np.full(len(one), 63)]).astype(np.uint32)
        self.unit_lane = np.concatenate([mix(p.anchor[self.rep[asked[whole]]] ^ U(0x9FB21C651E98DF25)) & U(1023), h[one, 0] >> U(54)]).astype(np.uint32)
        self.unit_order, self.unit_starts = _by_task(task, self.tasks)
        # the windows of the asked classes one after another: their unit, their place in it, and whether a smaller document of the block has them
        wide_n = b - a + 1
        self.window_unit = np.concatenate([np.repeat(np.arange(len(a)), wide_n), len(a) + of])
        self.window_place = np.concatenate([np.arange(wide_n.sum()) - np.repeat(np.cumsum(wide_n) - wide_n, wide_n), np.zeros(len(of), np.int64)])
        self.window_gone = np.concatenate([np.zeros(wide_n.sum(), bool), doc > doc[one][of] if len(of) else np.empty(0, bool)])
        self.window_start = np.concatenate([np.repeat(a, wide_n) + self.window_place[: wide_n.sum()], start])
        self.window_class = np.concatenate([np.repeat(asked[whole], wide_n), np.repeat(asked[~whole], n)])

    def sent_windows(self, wide: bool) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """task, documents, contents (bytes if wide, else hashes), windows of the units (6 bits), their lanes (10 bits) and where their anchors are."""
        t = self.tokens
        for k in range(self.tasks):
            u = self.unit_order[self.unit_starts[k] : self.unit_starts[k + 1]]
            if not len(u):
                continue
            if wide:
                keys = b"".join([t.data[i:j] for i, j in t.places(self.unit_first[u], self.unit_first[u] + self.unit_n[u] + self.length - 2)])
            else:
                keys = self.unit_hash[u].tobytes()
            yield k, _deltas(self.unit_doc[u]), keys, (self.unit_n[u].astype(np.uint32) | self.unit_lane[u] << np.uint32(6) | self.unit_offset[u] << np.uint32(16)).tobytes()

    def covered(self, answers: list[dict], wide: bool) -> np.ndarray:
        """Of each token whether it goes."""
        self.deal_windows(answers, wide)
        p, length = self.phrases, self.length
        n, begin = self.unit_n, np.zeros(len(self.unit_n) + 1, np.int64)
        np.cumsum(n, out=begin[1:])
        bit = np.zeros(begin[-1], bool)
        for x in answers:
            if x["round"] == 2:
                u = self.unit_order[self.unit_starts[x["task"]] : self.unit_starts[x["task"] + 1]]
                size = n[u]
                at = np.repeat(begin[u], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                bit[at] = np.unpackbits(np.frombuffer(x["data"], np.uint8), count=int(size.sum())).astype(bool)
        change = np.zeros(len(self.tokens.numbers) + 1, np.int32)
        whole = self.of[self.larger | self.gone[self.class_of]] if len(self.of) else self.of
        np.add.at(change, p.first[whole], 1)
        np.add.at(change, p.last[whole] + length, -1)
        gone = np.flatnonzero(self.window_gone | bit[begin[self.window_unit] + self.window_place])
        if len(gone):
            # the same windows of the class's other occurrences in its document
            place, cls = self.window_start[gone] - p.first[self.rep[self.window_class[gone]]], self.window_class[gone]
            rest = np.flatnonzero(~self.larger)
            rest = rest[np.argsort(self.class_of[rest], kind="stable")]
            lo, hi = np.searchsorted(self.class_of[rest], cls), np.searchsorted(self.class_of[rest], cls, "right")
            size = hi - lo
            which = rest[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            s = p.first[self.of[which]] + np.repeat(place, size)
            np.add.at(change, s, 1)
            np.add.at(change, s + length, -1)
        return np.cumsum(change[:-1]) > 0


def _joined(t: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All rows' numbers one after another, and how many each row has."""
    got = [np.frombuffer(x.as_buffer(), kind) for x in t[column]]
    return np.concatenate(got), np.array([len(x) for x in got])


def _documents(t: pa.Table) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(x.as_buffer(), np.int64)) for x in t["docs"]])


def _answered(key: tuple, t: pa.Table, number: int, parts: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([t["block"].combine_chunks().cast(pa.int64()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([number] * len(parts), pa.int32()), pa.array(parts, pa.binary())], schema=_ANSWER)


def _split(x: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1])


def sketched(cell: np.ndarray, several: np.ndarray, n: np.ndarray, depth: int = 3) -> np.ndarray:
    """Of each cell how often it occurs at least, by a count-min sketch of what all blocks send; 0 where it is in one document only.

    A row of the sketch has at least two counters for each cell that was sent.  Blocks
    hold different documents, so a cell of two blocks is in several.
    """
    width = 1 << max(10, int(2 * len(cell) - 1).bit_length())
    occurs, docs = np.full(len(cell), np.iinfo(np.int64).max), np.full(len(cell), 255, np.uint8)
    for d in range(depth):
        at = (mix(cell.astype(U) + U((0x9E3779B97F4A7C15 * (d + 1)) & 0xFFFFFFFFFFFFFFFF)) & U(width - 1)).astype(np.int64)
        row = np.zeros(width, np.uint32)
        np.add.at(row, at, n.astype(np.uint32))
        occurs = np.minimum(occurs, row[at])
        row[:] = 0
        np.add.at(row, at, several.astype(np.uint32) + np.uint32(1))
        docs = np.minimum(docs, np.minimum(row[at], 2).astype(np.uint8))
    return np.where(docs > 1, occurs, 0)


def _trimmed(reply: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """reply, which gives back a piece's memory before the next one."""

    def answers(key: tuple, t: pa.Table) -> pa.Table:
        try:
            return reply(key, t)
        finally:
            release_memory()

    return answers


def _anchor_answers(key: tuple, t: pa.Table) -> pa.Table:
    cells, sizes = _joined(t, "keys", np.uint32)
    n, _ = _joined(t, "counts", np.uint16)
    count = np.minimum(sketched(cells >> np.uint32(1), cells & np.uint32(1), n), MANY).astype(np.uint16)
    return _answered(key, t, 0, [x.tobytes() + b for x, b in zip(_split(count, sizes), merged_sketches([x.as_py() for x in t["docs"]]), strict=True)])


def merged_sketches(parts: list[bytes]) -> list[bytes]:
    """Of each block's part of the sketch its counters, as bits: 1 where all blocks' values together are 2 or more."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    if not any(parts):
        return [b""] * len(parts)
    total = [np.zeros(COUNTERS, np.uint16) for _ in range(DEPTH)]

    def rows(x: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        data, at = unzip.decompress(x), 0
        for d in range(DEPTH):
            m = int(np.frombuffer(data, np.uint32, 1, at)[0])
            yield d, np.cumsum(np.frombuffer(data, np.uint32, m, at + 4).astype(np.int64)), np.frombuffer(data, np.uint8, m, at + 4 + 4 * m)
            at += 4 + 5 * m

    for x in parts:
        for d, own, value in rows(x):
            total[d][own] = np.minimum(total[d][own] + value, 1000)  # a block has each counter once
    return [np.packbits(np.concatenate([total[d][own] > 1 for d, own, _ in rows(x)])).tobytes() for x in parts]


def _phrase_answers(key: tuple, t: pa.Table) -> pa.Table:
    """Of each sent phrase 0 if a smaller document has it, else how often it occurs in all."""
    doc = _documents(t)
    keys, sizes = _joined(t, "keys", U)
    keys, sizes = keys.reshape(-1, 2), sizes // 2
    n, _ = _joined(t, "counts", np.uint16)
    order = np.lexsort((doc, keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    cls, first = np.cumsum(new) - 1, np.flatnonzero(new)
    total = np.minimum(np.add.reduceat(n[order].astype(np.int64), first), MANY)
    answer = np.empty(len(order), np.uint16)
    answer[order] = np.where(doc[order] > doc[order][first][cls], 0, total[cls])
    return _answered(key, t, 1, [x.tobytes() for x in _split(answer, sizes)])


def _alike(contents: bytes, begin: np.ndarray, n: np.ndarray, offset: np.ndarray, length: int, group: int) -> np.ndarray:
    """Of each unit whether it can have a window of another one.

    Each window holds its anchor and, before or after it, half of what is left of its
    length: a unit shares this with another, or has no window of another's.
    """
    import xxhash

    view, digest, side = memoryview(contents), xxhash.xxh3_64_intdigest, (length - group) // 2
    out = offset == 63
    for some, lo in ((offset >= side, begin + offset - side), (offset - n + 1 <= side, begin + offset)):
        u = np.flatnonzero(some & (offset < 63))
        h = np.fromiter((digest(view[i : i + group + side]) for i in lo[u].tolist()), U, len(u))
        _, of, count = np.unique(h, return_inverse=True, return_counts=True)
        out[u[count[of] > 1]] = True
    return out


def _groups(contents: bytes, counts: np.ndarray, length: int, group: int, same: Callable[[list[bytes], np.ndarray], np.ndarray]) -> np.ndarray:
    """Numbers of groups of equal windows, of each unit's one after another, some lanes at a time."""
    n, lane, offset = (counts & np.uint32(63)).astype(np.int64), counts >> np.uint32(6) & np.uint32(1023), (counts >> np.uint32(16)).astype(np.int64)
    size = n + length - 1
    end, at = np.cumsum(size), np.cumsum(n) - n
    out = np.arange(int(n.sum()))  # each in a group of its own
    number = len(out)
    some = np.flatnonzero(_alike(contents, end - size, n, offset, length, group))
    if not len(some):
        return out
    lanes = np.bincount(lane[some], weights=size[some])
    part = ((np.cumsum(lanes) - lanes) // COMPARED_BYTES).astype(np.int64)[lane[some]]
    order = np.argsort(part, kind="stable")
    for k in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        u = some[k]
        got = same([contents[i:j] for i, j in zip((end - size)[u].tolist(), end[u].tolist(), strict=True)], n[u])
        out[np.repeat(at[u], n[u]) + np.arange(len(got)) - np.repeat(np.cumsum(n[u]) - n[u], n[u])] = got + number
        number += int(got.max()) + 1
    return out


def _window_answers(length: int, group: int, same: Callable[[list[bytes], np.ndarray], np.ndarray] | None) -> Callable[[tuple, pa.Table], pa.Table]:
    def answers(key: tuple, t: pa.Table) -> pa.Table:
        """Of each sent window whether a smaller document has it, as bits."""
        doc = _documents(t)
        counts, sizes = _joined(t, "counts", np.uint32)
        n = (counts & np.uint32(63)).astype(np.int64)
        if same:
            number = _groups(b"".join([x.as_buffer() for x in t["keys"]]), counts, length, group, same)
        else:
            number = np.unique(_joined(t, "keys", U)[0].view("V16"), return_inverse=True)[1]
        doc_of = np.repeat(doc, n)
        order = np.lexsort((doc_of, number))
        g = number[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        gone = np.empty(len(g), bool)
        gone[order] = doc_of[order] > doc_of[order][new][np.cumsum(new) - 1]
        windows = [int(x.sum()) for x in _split(n, sizes)]
        return _answered(key, t, 2, [np.packbits(x).tobytes() for x in _split(gone, np.array(windows))])

    return answers


def removed(
    docs: DataFrame,
    *,
    name: str,
    tokens: Callable[[list[str]], Tokens],
    length: int,
    group: int,
    finish: Callable[[list[int | None], Tokens, np.ndarray], pa.RecordBatch],
    schema: str,
    same: Callable[[list[bytes], np.ndarray], np.ndarray] | None = None,
    sketch: bool = False,
) -> DataFrame:
    """Applies finish(ids, tokens, gone) to each block; gone marks the tokens to remove.

    same(contents, windows of each unit): numbers of groups of equal windows; without it
    windows are sent and compared as 128-bit hashes.  sketch: only windows that a merged
    count-min sketch of all blocks' windows counts twice or more are grouped.
    """
    spark = session(docs)
    table_name, folder = f"{name}_{uuid.uuid4().hex}", work_path(spark, name)
    try:
        tasks = pieces(docs)
        table = blocks(docs, table_name, f"{folder}/blocks", tasks)
        return _removed(table, folder, tasks=tasks, name=name, tokens=tokens, length=length, group=group, finish=finish, schema=schema, same=same, sketch=sketch)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        delete_path(spark, folder)


def _removed(table: DataFrame, folder: str, tasks: int, *, name: str, tokens: Callable, length: int, group: int, finish: Callable, schema: str, same: Callable | None, sketch: bool) -> DataFrame:
    wide = same is not None

    def each(what: Callable[[int, list, list[str], list[dict], Block], pa.RecordBatch]) -> Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]:
        """A function of blocks, one of which is held at a time."""

        def one(r: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = r["ids"][0].as_py(), r["texts"][0].as_py()
            answers = r["answers"][0].as_py() or [] if "answers" in r.schema.names else []
            return what(r["block"][0].as_py(), ids, texts, answers, Block(ids, tokens(texts), length, group, tasks, sketch))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(batch.num_rows):
                yield one(batch.slice(i, 1))

        return lambda: step

    def sent(what: Callable[[Block, list[dict]], Iterator[tuple[int, bytes, bytes, bytes]]]) -> Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]:
        def run(number: int, ids: list, texts: list[str], answers: list[dict], block: Block) -> pa.RecordBatch:
            got = [(k, number, d, x, n) for k, d, x, n in what(block, answers)]
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(_SENT)], schema=_SENT)

        return each(run)

    def anchors(block: Block, answers: list[dict]) -> Iterator:
        block.deal_anchors()
        if sketch:
            block.deal_sketch()
        return block.sent_anchors()

    def phrases(block: Block, answers: list[dict]) -> Iterator:
        block.deal_phrases(answers)
        return block.sent_phrases()

    def windows(block: Block, answers: list[dict]) -> Iterator:
        block.deal_windows(answers, wide)
        return block.sent_windows(wide)

    def per_block(answers: list[DataFrame]) -> DataFrame:
        if not answers:
            return table
        every = answers[0]
        for a in answers[1:]:
            every = every.unionByName(a)
        got = every.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("task", "round", "data")).alias("answers"))
        return table.join(got.hint("shuffle_hash"), "block", "left")

    answers: list[DataFrame] = []
    for what, reply in ((anchors, _anchor_answers), (phrases, _phrase_answers), (windows, _window_answers(length, group, same))):
        dealt = arrow_map(per_block(answers), sent(what), _SENT_SQL).groupBy("task").applyInArrow(_trimmed(reply), _ANSWER_SQL)
        answers.append(written(dealt, f"round-{len(answers)}", folder))

    def end(_: int, ids: list, texts: list[str], got: list[dict], block: Block) -> pa.RecordBatch:
        return finish(ids, block.tokens, block.covered(got, wide))

    return written(arrow_map(per_block(answers), each(end), schema), f"{name}-removed")
