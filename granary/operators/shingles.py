"""Hashes of word n-grams for MinHash, whole Arrow batches at a time.

A gram's hash is the first 28 bits of the MD5 of its words, joined by one space, as any
engine can repeat it.  Grams are stretches of one buffer: no text of a gram is built.
Those that fit one block of MD5 (nearly all) are hashed together, a step at a time.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Sines and rotations of MD5's 64 steps.
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that is one block of MD5, with its end mark and length.
ONE_BLOCK = 55
#: Grams that are hashed at a time: what fits a core's cache.
HASHED = 4_096
#: Of a 32-bit word's bytes those before the text's end, and the mark of that end.
_BEFORE = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_MARK = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def _blocks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray | None]:
    """The 16 words of each text's block; None for those that are 0 in all.  data goes on for 64 bytes after the last text."""
    words = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    out: list[np.ndarray | None] = [None] * 16
    for j in range(int(sizes.max()) // 4 + 1):
        left = sizes - 4 * j
        some = np.clip(left, 0, 4)
        out[j] = words[starts + 4 * j] & _BEFORE[some] | np.where(left >= 0, _MARK[some], np.uint32(0))
    out[14] = (sizes * 8).astype(np.uint32)
    return out


def md5_starts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first four bytes (a big-endian number) of the MD5 of each data[start : start + size], of up to ONE_BLOCK bytes."""
    n, m = len(starts), _blocks(data, starts, sizes)
    a, b, c, d = (np.full(n, x, np.uint32) for x in BEGIN)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if m[k] is not None:
            f += m[k]
        f += np.uint32(SINES[i])
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=g)
        f <<= np.uint32(TURNS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(BEGIN[0])
    return a.byteswap()


def gram_hashes(words: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """28-bit hashes of each row's k-grams of words, one row after another, with repeats, and how many a row has.

    Of fewer words the whole is one gram; of none, or null, there is none.
    """
    words = words.cast(pa.list_(pa.string()))  # Spark says that elements aren't null, and binary_join has no such type
    joined = pc.binary_join(words, " ")
    flat = words.flatten()
    count = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(joined.cast(pa.binary()).fill_null(b"").to_pylist()) + bytes(64), np.uint8)
    rank = np.cumsum(count > 0) - 1  # rows before that have words: between two rows there is no space
    begin = np.cumsum(size) - size + np.arange(len(size)) - np.repeat(rank, count)
    grams = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), grams)
    first = np.arange(len(row)) + ((np.cumsum(count) - count) - (np.cumsum(grams) - grams))[row]
    last = first + np.minimum(count, k)[row] - 1
    starts, sizes = begin[first], begin[last] + size[last] - begin[first]
    out = np.empty(len(row), np.uint32)
    order = np.argsort(np.minimum(sizes, ONE_BLOCK + 1).astype(np.uint8), kind="stable")
    short = order[: int((sizes <= ONE_BLOCK).sum())]
    for i in range(0, len(short), HASHED):
        x = short[i : i + HASHED]
        out[x] = md5_starts(data, starts[x], sizes[x])
    view = memoryview(data)
    for i in order[len(short) :].tolist():
        out[i] = int.from_bytes(hashlib.md5(view[starts[i] : starts[i] + sizes[i]], usedforsecurity=False).digest()[:4], "big")
    return out >> np.uint32(4), grams
