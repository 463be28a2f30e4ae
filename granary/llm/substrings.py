"""Substring dedup over words, with a count-min prefilter.

A first pass counts windows in a count-min sketch (see _repeats): each block of documents
fills one of its own, cut by ranges of counters; a task merges a range of all blocks'
sketches and tells each block which of the counters that it hit are 2 or more.  Merged
counters overestimate, so a window that is counted once in any row is in one place only,
and none that repeats is lost.  The second step exactly groups the windows that are left,
through the phrases that they make up, as 128-bit hashes of their words, joined by one
space.  Counters are a fixed number for each task, and tasks follow the input; nothing of
the sketch is broadcast or collected, and it filters alike at every size.

Defined results.  A null or blank text has no words; texts of fewer words than the
window keep all.  A null doc_id counts as larger than all others (its windows remove
nothing, and are removed if any document with an id has them).  Rows of the same id
remove nothing from each other.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table
from ._repeats import BYTE, Tokens, mix, power, removed

WINDOW = 50
GROUP = 25
#: Bytes whose words are hashed at a time.
HASHED_BYTES = 1 << 18


def word_tokens(texts: list[str]) -> Tokens:
    """The words of all texts, joined by one space each; the numbers are polynomial hashes, which only choose anchors and counters."""
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    # each run of white space one space, none at the start
    keep = ~space
    keep[1:] |= ~space[:-1]
    words = (~space).astype(np.int8)
    edge = np.diff(words, prepend=np.int8(0))
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    bounds = np.searchsorted(np.flatnonzero(edge == 1), begins)
    data = np.where(space, np.uint8(32), raw)[keep]
    edge = np.diff((data != 32).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    numbers = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # as many words as lie within a stretch of bytes, one at least
        upto = max(int(np.searchsorted(ends, starts[at] + HASHED_BYTES, "right")), at + 1)
        lo, hi = starts[at], ends[upto - 1]
        up, down = power(max(int(hi - lo), HASHED_BYTES))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = starts[at:upto] - lo, ends[at:upto] - lo
        numbers[at:upto] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = upto
    return Tokens(numbers, bounds, data.tobytes(), starts, ends)


def dedup(docs: DataFrame, *, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the words that no earlier document's window covers."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * text]

    def finish(ids: list[int | None], tokens: Tokens, gone: np.ndarray) -> pa.RecordBatch:
        n, cut, sha, kept = [], [], [], []
        for a, b in zip(tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist(), strict=True):
            out = gone[a:b]
            k = int(out.sum())
            left = tokens.data[tokens.starts[a] : tokens.ends[b - 1]] if a < b else b""
            if k:
                left = b" ".join([w for w, g in zip(left.split(b" "), out.tolist(), strict=True) if not g])
            n.append(b - a)
            cut.append(k)
            sha.append(hashlib.sha256(left).hexdigest())
            if text:
                kept.append(left.decode())
        cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(sha, pa.string()), *[pa.array(kept, pa.string())] * text]
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text
    return removed(docs, name="substrings", tokens=word_tokens, length=WINDOW, group=GROUP, finish=finish, schema=schema, sketch=True)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
