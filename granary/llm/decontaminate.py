"""Benchmark decontamination by pigeonhole edit matching.

Item and document are lower-cased and each run of white space becomes one space.  An
item of m characters may differ from a passage of a document by k = floor(error_rate *
m) edits.  It is cut into k + 1 pieces; k edits leave at least one piece untouched, so
an Aho-Corasick scan for all pieces finds every place where a match can lie.  Each such
place is verified with Myers' bit-parallel edit distance, the whole item against the
best stretch of text there.

Defined results.  A null or blank item matches nothing, a null or empty document holds
nothing.  Equal (item_id, text) rows of the benchmark count once, repeated documents
give repeated rows.  Of several matches of an item in a document the one of least
distance counts, of those the first to end.  Extra columns are ignored by contaminated()
and kept by clean(), whatever their names.

An item of less than 1 / error_rate characters has no budget and is one piece; it
matches whole words only, as its letters within a longer word say nothing.

Items and documents meet in blocks: a stated set of items is dealt by hash into blocks
of about block_chars characters, each of which is sent to the tasks.  Neither the driver
nor a task's machine holds more than a block at a time, however many items there are;
contaminated() reads the documents once for each block, of which benchmarks of up to
block_chars characters have one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ._common import arrow_map, session, table


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, error_rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The error budget k, and k + 1 pieces with their offsets, of lengths that differ by one at most."""
    k = int(error_rate * len(item))
    bounds = [i * len(item) // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between the whole pattern and any stretch of text, and where (exclusive) the first such stretch ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, at + 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv
    return best, end


def _inside(text: str, at: int) -> bool:
    """Whether a place lies within a word."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | str | None, str]], error_rate: float) -> None:
        import ahocorasick

        self.items, at = [], defaultdict(list)
        for item_id, text in items:
            if p := normalize(text):
                k, pieces = cut(p, error_rate)
                for offset, piece in pieces:
                    at[piece].append((len(self.items), offset))
                self.items.append((item_id, p, k))
        self.masks: dict[int, dict[str, int]] = {}
        self.machine = None
        if at:
            self.machine = ahocorasick.Automaton()
            for piece, where in at.items():
                self.machine.add_word(piece, (len(piece), where))
            self.machine.make_automaton()

    def _masks(self, i: int) -> dict[str, int]:
        if i not in self.masks:
            masks: dict[str, int] = {}
            for b, c in enumerate(self.items[i][1]):
                masks[c] = masks.get(c, 0) | 1 << b
            self.masks[i] = masks
        return self.masks[i]

    def matches(self, text: str | None) -> list[tuple[int | str | None, int, int, int]]:
        """(item_id, distance, characters of the item, end of the match in the normalized text) of each item that the text holds."""
        if self.machine is None or not text:
            return []
        text = normalize(text)
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, where) in self.machine.iter(text):
            for i, offset in where:
                starts[i].append(end - size + 1 - offset)
        out = []
        for i, begins in starts.items():
            item_id, p, k = self.items[i]
            m = len(p)
            if not k:  # the piece is the item
                if ends := [b + m for b in begins if not (_inside(text, b) or _inside(text, b + m))]:
                    out.append((item_id, 0, m, min(ends)))
                continue
            exact = text.find(p)
            if exact >= 0:
                out.append((item_id, 0, m, exact + m))
                continue
            best, end, upto = k + 1, 0, -1
            begins.sort()
            n = 0
            while n < len(begins):  # hits whose windows touch are verified at once
                a, b = max(begins[n] - k, 0), begins[n] + m + k
                while n < len(begins) and begins[n] - k <= b:
                    b = max(b, begins[n] + m + k)
                    n += 1
                d, e = myers(self._masks(i), m, text[a:b])
                if d < best:
                    best, end, upto = d, a + e, b
            if upto >= 0 and best <= k:
                out.append((item_id, best, m, end))
        return out


def blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int | str | None, str]]]:
    """The benchmark's items, dealt by hash into lists of about block_chars characters; the driver holds one at a time."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    n = total // block_chars + 1
    for b in range(n):
        yield [(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").toLocalIterator()]


def contaminated(docs: DataFrame, items: DataFrame, *, error_rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, distance, item_chars, match_end: a row for each item that a document holds."""
    spark = session(docs)
    kept = docs.select("doc_id", "text")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", items.schema["item_id"].dataType), *(StructField(n, LongType()) for n in ("distance", "item_chars", "match_end"))])
    types = to_arrow_schema(schema)
    out = None
    for block in blocks(items, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent) -> Callable[[pa.RecordBatch], pa.RecordBatch]:  # noqa: ANN001
            matcher = Matcher(sent.value, error_rate)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                got = [(d, *m) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for m in matcher.matches(t)]
                return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(types)], schema=types)

            return step

        hits = arrow_map(kept, make, schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, items: DataFrame, *, error_rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """docs without those that hold an item, all columns kept; read once, whatever the number of blocks."""
    spark = session(docs)
    for block in blocks(items, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def make(sent=sent) -> Callable[[pa.RecordBatch], pa.RecordBatch]:  # noqa: ANN001
            matcher = Matcher(sent.value, error_rate)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not matcher.matches(t) for t in batch["text"].to_pylist()], pa.bool_()))

            return step

        docs = arrow_map(docs, make, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
