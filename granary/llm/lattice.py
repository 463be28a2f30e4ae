"""Language-model scores from a subword lattice.

A token is a word (white space split, A-Z lower-cased) with a boundary mark before it.
Each way to cut it into pieces of a given vocabulary is a path of its lattice; a piece
that isn't in the vocabulary stands for a single character by its bytes' pieces.  Paths
are weighted by unigram piece probabilities: the vocabulary's own scores to begin with,
then re-estimated on the training documents' word counts by expectation-maximization
(expected piece counts over all segmentations).  The forward recursion in log space sums
all segmentations, so the score of a text is its marginal log10 probability:

    sum over words of log10((1 - e) * marginal(word)) + log10(e),

e the share of ends among the training tokens; vocabulary_score is the same with the
vocabulary's own scores as weights, as they were before training.  What is kept of the pieces is bounded by
the vocabulary; word counts are a written table that grows with the corpus.

The base score needs each token's training count.  The most frequent words (at most
max_frequent, picked by count) are sent to the tasks with their counts; the others meet
their counts in a join by word, which therefore has no hot key.

Defined results.  A null or blank text is one end.  A null doc_id is not held out and
not learned from.  Repeated rows are scored, and counted, each.  Without training
documents all counts are 0, N is 0, V is 0, and the pieces keep their own scores with
e = 0.5.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, crc_mod, session, table, written

MARK = "▁"
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
U = np.uint64
#: Cells of the matrices that are worked on at a time.
CELLS = 1 << 19
#: Characters of a word that are worked on at a time; expected counts of a longer one are taken stretch by stretch.
STRETCH = 1 << 15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    return x


@dataclass(frozen=True)
class Pieces:
    """names: the pieces; log_p: their natural log probabilities; bytes: the pieces of single bytes."""

    names: tuple[str, ...]
    log_p: np.ndarray
    byte: np.ndarray


def load_pieces(path: str) -> Pieces:
    """A sentencepiece model's pieces.  Its scores are merge ranks below zero: rank r weighs 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, weight, byte = [], [], np.full(256, -1)
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte[int(model.id_to_piece(i)[3:5], 16)] = len(names)
        elif model.is_control(i) or model.is_unknown(i):
            continue
        names.append(model.id_to_piece(i))
        weight.append(1.0 / (max(-model.get_score(i), 0.0) + 10.0))
    w = np.array(weight)
    w[byte[byte >= 0]] = w.min() / 256
    return Pieces(tuple(names), np.log(w / w.sum()), byte)


class Lattice:
    """The lattices of many words at once; words of one length are a matrix."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        byte = set(pieces.byte.tolist())
        self.longest = max((len(n) for i, n in enumerate(pieces.names) if i not in byte), default=1)
        keys = np.zeros(len(pieces.names), U)
        for i, n in enumerate(pieces.names):
            if i not in byte:
                h = 0
                for c in n:
                    h = (h * int(_B) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                keys[i] = h
        rest = np.array([i for i in range(len(keys)) if i not in byte], np.int64)
        self.keys = np.append(keys, U(0))
        self.tables: list[tuple[int, np.ndarray]] = []
        bits = 20
        while len(rest):  # what collides in one table is in the next
            slot = (_mix(keys[rest]) >> U(64 - bits)).astype(np.int64)
            t = np.full(1 << bits, -1, np.int32)
            t[slot] = rest
            self.tables.append((bits, t))
            rest, bits = rest[t[slot] != rest], max(bits - 4, 10) if len(self.tables) < 3 else 14
        self.unknown: dict[tuple[int, int], float] = {}

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, or -1."""
        m = _mix(h)
        out = np.full(h.shape, -1, np.int32)
        for bits, t in self.tables:
            got = t[(m >> U(64 - bits)).astype(np.int64)]
            out = np.where((got >= 0) & (self.keys[got] == h), got, out)
        return out

    def edges(self, codes: np.ndarray, *weights: np.ndarray) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        """For each piece length its edges' numbers (-1: none) by start, and, by weights (log probabilities of the pieces), their log probabilities."""
        index, log_p = [], [[] for _ in weights]
        shifted = codes.astype(U) + U(1)
        h = np.zeros(codes.shape, U)
        for size in range(1, min(self.longest, codes.shape[1]) + 1):
            h = (h[:, : codes.shape[1] - size + 1] * _B) + shifted[:, size - 1 :]
            k = self.find(h)
            index.append(k)
            for of, weight in zip(log_p, weights, strict=True):
                p = np.where(k >= 0, weight[k], -np.inf)
                if size == 1 and (k < 0).any():
                    at = k < 0
                    p[at] = [self._bytes(c, weight) for c in codes[at].tolist()]
                of.append(p)
        return index, log_p

    def _bytes(self, code: int, weight: np.ndarray) -> float:
        if (code, id(weight)) not in self.unknown:
            b = self.pieces.byte[list(chr(code).encode("utf-8", "surrogatepass"))]
            self.unknown[code, id(weight)] = float(weight[b].sum()) if (b >= 0).all() else -700.0
        return self.unknown[code, id(weight)]

    @staticmethod
    def forward(log_p: list[np.ndarray], n: int, begun: np.ndarray | None = None) -> np.ndarray:
        """alpha by place; begun: its first rows, where they are known."""
        m = log_p[0].shape[0]
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0.0
        if begun is not None:
            alpha[: len(begun)] = begun
        for j in range(1 if begun is None else len(begun), n + 1):
            terms = np.stack([alpha[j - s] + log_p[s - 1][:, j - s] for s in range(1, min(len(log_p), j) + 1)])
            top = terms.max(axis=0)
            alpha[j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha

    def last(self, codes: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
        """alpha at the words' end, by weights; long words go by in stretches that overlap by a piece."""
        begun: list[np.ndarray | None] = [None] * len(weights)
        lo, n = 0, codes.shape[1]
        while lo < n:
            hi, back = min(lo + STRETCH, n), min(lo, self.longest - 1)
            _, log_p = self.edges(codes[:, lo - back : hi], *weights)
            begun = [self.forward(p, hi - lo + back, None if b is None else b[-back - 1 :]) for p, b in zip(log_p, begun, strict=True)]
            lo = hi
        return [b[-1] for b in begun]

    @staticmethod
    def backward(log_p: list[np.ndarray], n: int) -> np.ndarray:
        m = log_p[0].shape[0]
        beta = np.full((n + 1, m), -np.inf)
        beta[n] = 0.0
        for i in range(n - 1, -1, -1):
            terms = np.stack([log_p[s - 1][:, i] + beta[i + s] for s in range(1, min(len(log_p), n - i) + 1)])
            top = terms.max(axis=0)
            beta[i] = top + np.log(np.exp(terms - top).sum(axis=0))
        return beta

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in words, code points) of words of one length, the mark before each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(sizes[order])) + 1).tolist(), len(words)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            n = int(sizes[order[a]])
            step = max(CELLS // (n + 1), 1)
            for lo in range(a, b, step):
                at = order[lo : min(lo + step, b)]
                data = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
                yield at, np.concatenate([np.full((len(at), 1), ord(MARK), np.uint32), data], axis=1)

    def marginals(self, words: list[str], *weights: np.ndarray) -> np.ndarray:
        """[weights, words] the natural log of each word's probability, over all its segmentations; the pieces' own weights, where none are given, alone."""
        use = weights or (self.pieces.log_p,)
        out = np.zeros((len(use), len(words)))
        for at, codes in self.by_length(words):
            out[:, at] = self.last(codes, *use)
        return out if weights else out[0]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces in all segmentations of the words."""
        out = np.zeros(len(self.pieces.names) + 1)
        stretches = ((at, codes[:, lo : lo + STRETCH]) for at, codes in self.by_length(words) for lo in range(0, codes.shape[1], STRETCH))
        for at, codes in stretches:
            n = codes.shape[1]
            index, (log_p,) = self.edges(codes, self.pieces.log_p)
            alpha, beta = self.forward(log_p, n), self.backward(log_p, n)
            for s in range(1, len(log_p) + 1):
                k = index[s - 1]
                if (k >= 0).any():
                    post = np.exp(alpha[: n - s + 1].T + log_p[s - 1] + beta[s:].T - beta[0][:, None]) * counts[at][:, None]
                    out += np.bincount(k.ravel() + 1, post.ravel(), len(out))[np.r_[1 : len(out), 0]]
            missing = index[0] < 0
            if missing.any():
                post = np.exp(alpha[:n].T + log_p[0] + beta[1:].T - beta[0][:, None]) * counts[at][:, None]
                for code, w in zip(codes[missing].tolist(), post[missing].tolist(), strict=True):
                    b = self.pieces.byte[list(chr(code).encode("utf-8", "surrogatepass"))]
                    np.add.at(out, b[b >= 0], w)
        return out[:-1]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, *, folds: int, held_fold: int, limit: int = 400_000) -> DataFrame:
    """word, c (in training documents), c_all, as a written table."""

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            both: tuple[Counter, Counter] = (Counter(), Counter())

            def out() -> pa.RecordBatch:
                words = list(both[0].keys() | both[1].keys())
                c, rest = ([n.get(w, 0) for w in words] for n in both)
                return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([x + y for x, y in zip(c, rest, strict=True)], pa.int64())], names=["word", "c", "c_all"])

            for text, learn in zip(batch["text"].to_pylist(), batch["learn"].to_pylist(), strict=True):
                both[0 if learn else 1].update(words_of(text))
                if len(both[0]) + len(both[1]) > limit:
                    yield out()
                    both[0].clear()
                    both[1].clear()
            yield out()

        return step

    rows = docs.select("text", F.coalesce(crc_mod("doc_id", folds) != held_fold, F.lit(False)).alias("learn"))
    return written(arrow_map(rows, make, "word binary, c long, c_all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")), "word_counts")


def estimate(pieces: Pieces, counts: DataFrame, *, rounds: int = 2) -> Pieces:
    """Re-estimates the pieces' probabilities on all training words."""
    spark = counts.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(pieces)

        def make(sent=sent) -> Callable[[pa.RecordBatch], pa.RecordBatch]:  # noqa: ANN001
            lattice = Lattice(sent.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                got = lattice.expected([w.decode() for w in batch["word"].to_pylist()], batch["c"].to_numpy().astype(float))
                k = np.flatnonzero(got)
                return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(got[k])], names=["piece", "n"])

            return step

        got = arrow_map(counts.where("c > 0").select("word", "c"), make, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece at most
        n = np.zeros(len(pieces.names))
        n[[r.piece for r in got]] = [r.n for r in got]
        if n.sum() > 0:
            n += 0.5
            pieces = Pieces(pieces.names, np.log(n / n.sum()), pieces.byte)
    return pieces


def _frequent(counts: DataFrame, most: int) -> tuple[int, dict[bytes, int]]:
    """The least c_all with at most `most` words at or above it, and these words' counts."""
    level = F.floor(F.log2("c_all") * 8).cast("int")
    levels = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 512 at most
    total, at = 0, None
    for lv, n in levels:
        if total + n > most:
            break
        total, at = total + n, lv
    if at is None:
        return np.iinfo(np.int64).max, {}
    least = math.ceil(2 ** (at / 8) - 1e-9)
    return least, {bytes(r.word): r.c for r in counts.where(level >= at).select("word", "c").collect()}


def score(docs: DataFrame, pieces: Pieces, *, folds: int = 5, held_fold: int = 1, rounds: int = 2, max_frequent: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score of each row; see the module's text."""
    spark = session(docs)
    counts = word_counts(docs, folds=folds, held_fold=held_fold)
    ends = docs.where(crc_mod("doc_id", folds) != held_fold).count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = total.n + ends, total.v + (ends > 0)
    denominator = n + 0.5 * (v + 1)
    end_share = ends / n if ends else 0.5
    own, pieces = pieces.log_p, estimate(pieces, counts, rounds=rounds)
    _, frequent = _frequent(counts, max_frequent)
    sent = spark.sparkContext.broadcast((pieces, frequent, own))

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        lattice, frequent, own = Lattice(sent.value[0]), sent.value[1], sent.value[2]
        made = [TaskContext.get().partitionId() << 40]
        inside, end = math.log10(1 - end_share) if end_share < 1 else 0.0, math.log10(end_share)
        base_end = math.log10((ends + 0.5) / denominator)

        def part(ids: pa.Array, held: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            local: dict[bytes, int] = {}
            numbered = []
            for t in texts:
                w = words_of(t)
                numbered.append(np.fromiter([local.setdefault(x, len(local)) for x in w], np.int64, len(w)))
            size = np.array([len(x) for x in numbered])
            doc = np.repeat(np.arange(len(texts)), size)
            key, mult = np.unique(np.concatenate([np.empty(0, np.int64), *numbered]) * len(texts) + doc, return_counts=True)
            word, doc = key // len(texts), key % len(texts)
            words = list(local)
            log_m, own_m = lattice.marginals([w.decode() for w in words], lattice.pieces.log_p, own) / math.log(10)
            c = np.fromiter((frequent.get(w, -1) for w in words), np.int64, len(words))
            known = np.where(c > 0, 1, 0)
            base = np.log10((np.maximum(c, 0) + 0.5) / denominator) * (c >= 0)
            total = lambda x: np.bincount(doc, mult * x[word], len(texts))
            row = np.arange(len(texts)) + made[0]
            made[0] += len(texts)
            rare = c[word] < 0
            w, d, k = word[rare], doc[rare], mult[rare]
            new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.empty(0, np.int64)
            m = len(new)
            offsets = pa.array(np.r_[new, len(w)].astype(np.int32))
            empty = pa.array(np.zeros(len(texts) + 1, np.int32))
            none = lambda kind: pa.nulls(m, kind)
            lists = lambda x, kind: pa.concat_arrays([pa.ListArray.from_arrays(empty, pa.array([], kind)), pa.ListArray.from_arrays(offsets, pa.array(x, kind))])
            cols = [
                pa.concat_arrays([pa.array(row), none(pa.int64())]),
                pa.concat_arrays([ids.cast(pa.int64()), none(pa.int64())]),
                pa.concat_arrays([held, none(pa.bool_())]),
                pa.concat_arrays([pa.array(size + 1), none(pa.int64())]),
                pa.concat_arrays([pa.array(total(known).astype(np.int64) + int(ends > 0)), none(pa.int64())]),
                pa.concat_arrays([pa.array(total(base) + base_end), none(pa.float64())]),
                *[pa.concat_arrays([pa.array(total(x) + size * inside + end), none(pa.float64())]) for x in (log_m, own_m)],
                pa.concat_arrays([pa.nulls(len(texts), pa.binary()), pa.array([words[i] for i in w[new].tolist()], pa.binary())]),
                lists(row[d], pa.int64()),
                lists(k, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "vocabulary_score", "word", "rows", "times"])

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars < 8_000_000):
                    chars += len(texts[upto] or "")
                    upto += 1
                yield part(batch["doc_id"].slice(at, upto - at), batch["held_out"].slice(at, upto - at), texts[at:upto])
                at = upto

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, vocabulary_score double, word binary, rows array<long>, times array<long>"
    parts = written(arrow_map(rows, make, schema), "scored")
    of_words = parts.where("word is not null").select("word", "rows", "times").join(counts.select("word", "c").hint("shuffle_hash"), "word", "left")
    more = (
        of_words.select(F.coalesce("c", F.lit(0)).alias("c"), F.explode(F.arrays_zip("rows", "times")).alias("x"))
        .groupBy(F.col("x.rows").alias("row"))
        .agg(F.sum(F.col("x.times") * F.log10((F.col("c") + 0.5) / F.lit(float(denominator)))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("x.times")).otherwise(0)).alias("more_known"))
    )
    return parts.where("word is null").drop("word", "rows", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "vocabulary_score",
    )


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
