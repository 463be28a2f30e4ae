"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes the usual disguises (letter case, compatibility forms, accents,
homoglyphs from other scripts, digits and signs in place of letters).  The lexicon,
its weights, the exception phrases and the two coefficients of the score are
learned from labelled rows; the matches of a text are summed and set against its
length.

Defined results.  A null or empty text has no match and gets the score of a text
without matches.  A null doc_id is never held out and never learned from.  Repeated
labels of a document count once, the larger one wins; a null label is no label.
Without both classes among the labels the lexicon is empty and every score is the same,
about 2e-9.
Extra columns are ignored by score() and kept by reject(),
whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, crc_mod, session, table, written

#: Homoglyphs of Latin letters, and signs and digits in place of letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ꞵ": "b",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Signs that stand for a letter only where a letter or digit follows; at a word's end they are punctuation.
SIGNS = {"@": "a", "$": "s", "!": "i"}

_MARKS = re.compile(r"[̀-ͯ​-‏⁠﻿­]+")
_WORD = re.compile(r"[^\W_]+")


def _table() -> dict[int, str]:
    plain = {ord(k): v for k, v in HOMOGLYPHS.items()}
    plain |= {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
    plain |= {ord(k): v for k, v in SUBSTITUTES.items()}
    return plain


_TABLE = _table()
_SIGN = re.compile(r"[@$!]+(?=\w)")
_SIGN_TABLE = {ord(k): v for k, v in SIGNS.items()}


def fold(text: str) -> str:
    """Lower case, without marks, homoglyphs and substitutes, each run of anything but letters and digits one space, a space at both ends."""
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if "!" in text or "$" in text or "@" in text:
        text = _SIGN.sub(lambda m: m[0].translate(_SIGN_TABLE), text)
    text = text.translate(_TABLE)
    return f" {' '.join(_WORD.findall(text))} "


@dataclass(frozen=True)
class Lexicon:
    """terms: " word " or " stem" with its weight; exceptions: phrases within which no term counts; coefficients: intercept, log sum, log density."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-20.0, 0.0, 0.0)


def matcher(lexicon: Lexicon) -> Callable[[str], tuple[float, int]]:
    """text -> (sum of the weights of its matches, words).  Of terms that match in one word the heaviest counts."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term, weight in lexicon.terms.items():
        machine.add_word(term, (len(term), weight, False))
    for phrase in lexicon.exceptions:
        if len(p := fold(phrase)) > 2:
            machine.add_word(p, (len(p), 0.0, True))
    if not len(machine):
        return lambda text: (0.0, fold(text).count(" ") - 1)
    machine.make_automaton()

    def match(text: str) -> tuple[float, int]:
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight, spares) in machine.iter(folded):
            start = end - size + 1
            if spares:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared and best:
            # a term that begins within an exception phrase doesn't count; of the phrases that begin before it the one that reaches furthest decides
            spared.sort()
            begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            best = {s: w for s, w in best.items() if not (k := bisect_right(begins, s)) or reach[k - 1] <= s}
        return float(sum(best.values())), folded.count(" ") - 1 if folded.strip() else 0

    return match


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100.0 * total / max(words, 1))


def _score(total: float, words: int, c: tuple[float, float, float]) -> float:
    a, b = features(total, words)
    z = c[0] + c[1] * a + c[2] * b
    return 1.0 / (1.0 + math.exp(-z)) if z >= 0 else (e := math.exp(z)) / (1.0 + e)


def candidate_terms(text: str, stem: tuple[int, int]) -> set[str]:
    """Of a text: its words, and their beginnings of stem[0] to stem[1] letters."""
    words = set(fold(text).split())
    out = {f" {w} " for w in words if len(w) > 1}
    for w in words:
        for n in range(stem[0], min(stem[1], len(w) - 1) + 1):
            out.add(f" {w[:n]}")
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    folds: int = 5,
    held_fold: int = 0,
    max_rows: int = 20_000,
    min_docs: int = 5,
    min_log_odds: float = 4.0,
    max_false_share: float = 0.02,
    stem: tuple[int, int] = (4, 6),
    exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learns the lexicon from at most max_rows labelled rows (the first by hash of doc_id) outside the held-out fold.

    Terms are whole words and word beginnings of stem[0] to stem[1] letters; what bounds
    the lexicon is the sample.  A term is kept if at least min_docs toxic rows hold it, its smoothed log odds are
    min_log_odds or more, and at most max_false_share of its rows are not toxic; the
    weight is the log odds.  Exception phrases: those given, and the word pairs around a
    term that are in three or more rows, none toxic.
    """
    import numpy as np

    spark = session(docs)
    rows = (
        labels.select("doc_id", "toxic")
        .where("doc_id is not null and toxic is not null")
        .where(crc_mod("doc_id", folds) != held_fold)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    picked = rows.collect()  # max_rows at most
    n_pos = sum(r.toxic == 1 for r in picked)
    n_neg = len(picked) - n_pos
    if not n_pos or not n_neg:
        return Lexicon(exceptions=tuple(exceptions))
    small = spark.createDataFrame(picked, "doc_id long, toxic int")
    sample = written(docs.select("doc_id", "text").join(F.broadcast(small), "doc_id"), "labelled")

    def terms() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pos: dict[str, int] = {}
            neg: dict[str, int] = {}
            for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                into = pos if y == 1 else neg
                for t in candidate_terms(text or "", stem):
                    into[t] = into.get(t, 0) + 1
            keys = list(pos)  # terms of no toxic row can't be kept
            rest = [k for k in neg if k not in pos]
            return pa.RecordBatch.from_pydict({"term": keys + rest, "pos": pa.array([pos[k] for k in keys] + [0] * len(rest), pa.int64()), "neg": pa.array([neg.get(k, 0) for k in keys + rest], pa.int64())})

        return step

    counted = arrow_map(sample, terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    best = (
        counted.where(F.col("pos") >= min_docs)
        .withColumn("w", odds)
        .where((F.col("w") >= min_log_odds) & (F.col("neg") <= max_false_share * (F.col("pos") + F.col("neg"))))
        .orderBy("term").collect()
    )
    lexicon = Lexicon({r.term: float(r.w) for r in best}, tuple(exceptions))

    def context() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words = {t.strip() for t in lexicon.terms if t.endswith(" ")}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[tuple[str, int], int] = {}
            for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                w = fold(text or "").split()
                for pair in {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a in words or b in words}:
                    out[pair, int(y == 1)] = out.get((pair, int(y == 1)), 0) + 1
            return pa.RecordBatch.from_pydict({"pair": pa.array([k[0] for k in out], pa.string()), "pos": pa.array([v * k[1] for k, v in out.items()], pa.int64()), "neg": pa.array([v * (1 - k[1]) for k, v in out.items()], pa.int64())})

        return step

    if lexicon.terms:
        spared = (
            arrow_map(sample, context, "pair string, pos long, neg long").groupBy("pair").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where("pos = 0 and neg >= 3").orderBy("pair").collect()
        )
        lexicon = Lexicon(lexicon.terms, (*exceptions, *(r.pair for r in spared)))
    seen = arrow_map(sample, lambda: _totals(lexicon), "doc_id long, total double, words long").collect()
    truth = {r.doc_id: r.toxic for r in picked}
    x = np.array([(1.0, *features(r.total, r.words)) for r in seen]).reshape(-1, 3)
    y = np.array([float(truth[r.doc_id] == 1) for r in seen])
    if not len(y):
        return lexicon
    c = np.zeros(3)
    for _ in range(50):  # Newton steps of a logistic fit with a small ridge
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (p - y) / len(y) + 1e-4 * c
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-4 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.terms, lexicon.exceptions, tuple(map(float, c)))


def _totals(lexicon: Lexicon) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    match = matcher(lexicon)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [match(t.as_py() or "") for t in batch["text"]]
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "total": pa.array([g[0] for g in got], pa.float64()), "words": pa.array([g[1] for g in got], pa.int64())})

    return step


def score(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every row; text is the only input of a score."""
    session(docs)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        match = matcher(lexicon)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = [_score(*match(t.as_py() or ""), lexicon.coefficients) for t in batch["text"]]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=["doc_id", "score", "predicted"])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.5) -> DataFrame:
    """docs without the toxic ones, all columns kept."""
    session(docs)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        match = matcher(lexicon)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([_score(*match(t.as_py() or ""), lexicon.coefficients) < threshold for t in batch["text"]], pa.bool_()))

        return step

    return arrow_map(docs, make, docs.schema)
