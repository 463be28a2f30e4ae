"""Suffix-array dedup over bytes, by prefix-free parsing.

Corpus order.  corpus_order() puts the suffixes of many texts in order.  A rolling hash
of WIDTH bytes triggers phrases: a text is cut where the hash is 0 modulo MODULUS, and a
phrase reaches over the trigger that ends it.  The dictionary holds each different
phrase once, the parse is what texts hold in place of them: the phrases' numbers in the
dictionary's order.  No phrase's suffix of more than WIDTH bytes begins another, so a
text's suffix is placed by the suffix of the phrase that it begins in (the dictionary's
suffix array) and, among equal ones, by the phrases that follow (the parse's suffix
array).  Highly repetitive texts have small dictionaries, which is all that is sorted
byte by byte.  Neighbours in corpus order with the same first LENGTH bytes are the
repeated strings; their bytes are compared.

The corpus.  Suffixes are dealt over tasks so that equal strings of LENGTH bytes meet:
by anchors, the triggers of the first level (see _repeats).  Strings whose anchor a
sketch counts in one document only are done with, and stretches that a smaller document
has as a whole (by 128-bit hashes) are removed whole.  What is left, where different
stretches share an anchor, is put in corpus order, each task's share by itself; the
documents of neighbours decide.

Defined results.  A null text counts as empty: no bytes, the hash of none.  Texts under
50 bytes keep all.  A null doc_id counts as larger than all others.  Rows of the same id
remove nothing from each other.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table
from ._repeats import BYTE, Tokens, U, mix, removed

LENGTH = 50
GROUP = 20
#: Bytes of a trigger, and one in how many places is one.
WIDTH = 6
MODULUS = 16


def byte_tokens(texts: list[str]) -> Tokens:
    parts = [t.encode() for t in texts]
    data = b"".join(parts)
    return Tokens(BYTE[np.frombuffer(data, np.uint8)], np.cumsum([0, *map(len, parts)]), data)


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of several runs, one after another: the run's number, and the place within it."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _ranked(rank: np.ndarray, left: np.ndarray, step: int, until: int) -> np.ndarray:
    """Doubles ranks of the first `step` signs of suffixes, `left` signs long each, up to `until` signs; an ended suffix comes before all that go on."""
    while step < until and int(rank.max()) + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        on = np.flatnonzero(left > step)
        after[on] = rank[on + step] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1]
        step *= 2
    return rank


def cuts(data: np.ndarray, bounds: np.ndarray, width: int, modulus: int) -> np.ndarray:
    """Where phrases begin: at each text's first byte, and at each trigger that lies in a text and leaves bytes after it."""
    begins = bounds[:-1][np.diff(bounds) > 0]
    n = len(data) - width + 1
    if n <= 0:
        return begins
    h = np.zeros(n, U)
    for j in range(width):
        h = (h << U(8)) | data[j : j + n].astype(U)
    at = np.flatnonzero(mix(h) % U(modulus) == 0)
    end = bounds[np.searchsorted(bounds, at, "right")]
    return np.unique(np.concatenate([begins, at[at + width < end]]))


def corpus_order(data: bytes, bounds: np.ndarray, wanted: np.ndarray | None = None, *, width: int = WIDTH, modulus: int = MODULUS) -> np.ndarray:
    """The suffix array of texts (text i is data[bounds[i]:bounds[i + 1]], each ended by a sign below all bytes), ties by position; of the wanted places only."""
    import xxhash

    text = np.frombuffer(data, np.uint8)
    if not len(text):
        return np.empty(0, np.int64)
    cut = cuts(text, bounds, width, modulus)
    own_end = bounds[np.searchsorted(bounds, cut, "right")]  # of the phrase's text
    following = np.append(cut[1:], len(text))
    final = following >= own_end
    end = np.where(final, own_end, following + width)
    # the dictionary: one of each phrase; a text's final phrases are told from others by the sign that ends them
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    names = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(cut.tolist(), end.tolist(), strict=True)]), U).reshape(-1, 2).copy()
    names[final, 0] ^= U(0x9E3779B97F4A7C15)
    _, first, phrase = np.unique(names.view("V16").ravel(), return_index=True, return_inverse=True)
    size = (end - cut)[first]
    word, place = _spread(size)
    begin = np.cumsum(size) - size
    sign = text[cut[first][word] + place].astype(np.int64) + 1
    left = size[word] - place
    # its suffix array: seven signs in one number, then by doubling
    key, padded = np.zeros(len(sign), np.int64), np.concatenate([sign, np.zeros(7, np.int64)])
    for j in range(7):
        key = (key << 9) | np.where(left > j, padded[j : j + len(sign)], 0)
    rank = _ranked(np.unique(key, return_inverse=True)[1], left, 7, int(size.max()))
    # the parse, and its suffix array
    parse = np.unique(rank[begin], return_inverse=True)[1][phrase]
    count = np.diff(np.append(np.flatnonzero(np.append(True, final[:-1])), len(cut)))
    which, nth = _spread(count)
    after = _ranked(parse, count[which] - nth, 1, int(count.max()))
    # a suffix: the dictionary's suffix that it begins with, then the phrases after it
    at = np.arange(len(text)) if wanted is None else wanted
    p = np.searchsorted(cut, at, "right") - 1
    begins = rank[begin[phrase[p]] + at - cut[p]]
    then = np.where(final[p], 0, np.append(after[1:], 0)[p] + 1)
    return at[np.lexsort((at, then, begins))]


def equal_strings(contents: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Of all strings of LENGTH bytes that begin at each unit's first places, `windows` of them: numbers of groups of equal ones, from the units' corpus order."""
    data = b"".join(contents)
    size = windows + LENGTH - 1
    begin = np.cumsum(size) - size
    unit, place = _spread(windows)
    starts = begin[unit] + place
    number = np.zeros(len(data), np.int64)
    number[starts] = np.arange(len(starts))
    order = number[corpus_order(data, np.append(begin, len(data)), starts)]
    text = np.frombuffer(data, np.uint8)
    new = np.zeros(len(order), bool)
    at = starts[order]
    for lo in range(0, len(order), 1 << 14):  # neighbours' bytes, some at a time
        hi = min(lo + (1 << 14), len(order) - 1)
        a, b = at[lo:hi, None] + np.arange(LENGTH), at[lo + 1 : hi + 1, None] + np.arange(LENGTH)
        new[lo + 1 : hi + 1] = (text[a] != text[b]).any(axis=1)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def dedup(docs: DataFrame, *, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary): the bytes that no earlier document's string covers."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * text]

    def finish(ids: list[int | None], tokens: Tokens, gone: np.ndarray) -> pa.RecordBatch:
        n, cut, spans, sha, kept = [], [], [], [], []
        for a, b in zip(tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist(), strict=True):
            out, data = gone[a:b], tokens.data[a:b]
            k = int(out.sum())
            left = data if not k else np.frombuffer(data, np.uint8)[~out].tobytes()
            n.append(b - a)
            cut.append(k)
            spans.append(int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])) if k else 0)
            sha.append(hashlib.sha256(left).hexdigest())
            if text:
                kept.append(left)
        cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *[pa.array(kept, pa.binary())] * text]
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text
    return removed(docs, name="suffixes", tokens=byte_tokens, length=LENGTH, group=GROUP, finish=finish, schema=schema, same=equal_strings)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
