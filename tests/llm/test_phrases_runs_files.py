"""Phrase collocations, runs of words and token files: brute force, round trips, edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("granary.llm")
from granary.llm import periodic, phrases, token_files  # noqa: E402
from granary.llm._common import delete_path, work_path  # noqa: E402

CLASHES = ("key", "n", "hot", "words", "a", "runs", "collapsed", "ids", "start", "w1", "k", "total", "best", "__g")


def odd(spark):
    """Nulls, blanks, repeated rows, a very long text, ties and columns with clashing names."""
    rng = random.Random(7)
    long = " ".join(rng.choice(["ab", "Cd", "é"]) for _ in range(30_000))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "one two " * 20, "en"), (4, "one two " * 20, "en"), (None, "x y. X y; x\0 y", None), (None, None, None), (5, long, "de"), (6, "日本 🎉 日本 🎉 " * 15, "de"), (-3, "a\x0bb\x0cc\r\nd", "")]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, g, *["q"] * len(CLASHES)) for i, t, g in rows], f"doc_id long, text string, lang string, {extra}")


# ---- 11 phrases

def brute_phrases(docs, max_n=3, min_count=10, percent=50, first=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = {}
    for p, a in cand.items():
        if any(q[0] == p[0] and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q))) for q, b in cand.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((g, i, p.decode(), -a, x, y, n[g], -s) for g, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:first], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("options", "hot"), [({}, None), ({"max_n": 4, "min_count": 3}, None), ({"max_n": 4, "min_count": 4, "inside_percent": 80, "first": 7}, 1), ({"max_n": 2, "min_count": 2}, 1)])
def test_phrases(spark, monkeypatch, options, hot):
    rng = random.Random(3)
    words = ["The", "of", "a", "B", "c\x01", "é", "x"]
    docs = [(" ".join(rng.choice(words[:4] if rng.random() < 0.6 else words) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(rng.randrange(40))), rng.choice(["en", "en", None, "de"])) for _ in range(60)]
    docs += [(None, "en"), ("", None), ("of a x " * 60, "en")]
    monkeypatch.setattr(phrases, "SLICE_BYTES", 700)
    if hot:  # parts of some suffixes are large already
        monkeypatch.setattr(phrases, "LARGE", 4)
        monkeypatch.setattr(phrases, "max", lambda a, b: a, raising=False)
    got = rows_of(phrases.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), **options))
    assert got and got == brute_phrases(docs, *(options.get(k, d) for k, d in (("max_n", 3), ("min_count", 10), ("inside_percent", 50), ("first", 2000))))


def test_phrases_of_odd_rows(spark):
    docs = odd(spark)
    want = brute_phrases([(r.text, r.lang) for r in docs.select("text", "lang").collect()])
    assert rows_of(phrases.collocations(docs)) == want and any(r[0] == "de" for r in want)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    f = spark.createDataFrame([(3_000_000_000_000, 3_100_000_000_000, 3_000_000_000_001)], "a long, l long, r long")
    e = "(cast(1000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    assert f.selectExpr(f"{e} AS s").first().s == 1_000_000 * 3_000_000_000_000**2 // (3_100_000_000_000 * 3_000_000_000_001)


# ---- 12 runs

def brute_runs(w, min_length, min_exponent):
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - b >= max(min_length, min_exponent * q):
                found.setdefault((b, i + q), q)
    return sorted(((b, e - b, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(rng):
    s = [rng.randrange(rng.choice([1, 2, 2, 3, 5, 20])) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(3)):
        if s:
            a = rng.randrange(len(s))
            b = rng.randrange(a, len(s)) + 1
            s = s[:a] + s[a:b] * rng.randrange(1, 6) + s[b:]
    return s[:150]


@pytest.mark.parametrize("rounds", [1, 32])
def test_runs(monkeypatch, rounds):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    rng, seen = random.Random(rounds), 0
    fib = ["a", "ab"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    for _ in range(60):
        docs = [sequences(rng) for _ in range(rng.randrange(1, 8))] + [[ord(c) for c in fib[-1]]]
        codes, sizes = np.array([c for d in docs for c in d], np.int64), np.array([len(d) for d in docs])
        for limits in ((1, 2), (24, 3), (7, 3), (5, 4)):
            want = [brute_runs(d, *limits) for d in docs]
            assert periodic.runs_of(codes, sizes, *limits) == want
            seen += sum(map(len, want))
    assert seen > 1_000


def test_blocks_by_definition():
    s = [0, 1, 0, 1, 0, 1, 2, 0, 1, 2, 2]
    length, source = periodic.previous_factors(periodic.Ranks(np.array(s), np.array([len(s)])))
    for i in range(len(s)):
        want = max([next(k for k in range(len(s)) if i + k == len(s) or s[i + k] != s[j + k]) for j in range(i)], default=0)
        assert length[i] == want and (not want or s[source[i] : source[i] + want] == s[i : i + want])
    assert periodic.lz_blocks(length).tolist() == [0, 1, 2, 6, 7, 10]


def brute_row(doc_id, text, planted=True):
    w = re.split(rb"[\x20\x09-\x0D]+", (text or "").encode())
    w = [x for x in w if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 24, 3)
    drop = {i for b, m, q in runs for i in range(b + q, b + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    listed = "".join(f"{b},{m},{q}\n" for b, m, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = [d for d in docs if len((d[1] or "").split()) < 1_500]
    want = {d[0]: brute_row(*d) for d in docs}
    got = {r.doc_id: tuple(r) for r in periodic.op12_periodic(spark, sf_dir).collect()}
    assert {k: got[k] for k in want} == want and sum(r[1] > 0 for r in want.values()) > 10


def test_runs_of_odd_rows(spark):
    docs = odd(spark)
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id == 4:
            assert [tuple(x) for x in r.runs] == [(0, 40, 2)] and r.collapsed == "one two"
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
    assert next(r for r in got if r.doc_id == 6).collapsed == "日本 🎉"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_exponent=1)


# ---- 13 token files

@pytest.fixture(scope="module")
def tokenizer_json():
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


@pytest.fixture(scope="module")
def library(tokenizer_json):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_chunks_like_the_library(tokenizer_json, library, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 3_000)
    monkeypatch.setattr(token_files, "CACHE", 500)
    rng = random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "\n\n", "\t", "\r", "’s", "'s", "123", "é", "日本", "!", "...", " ", "　", "\x1c", "<|endoftext|>", "Word", "🎉", "\x00", "d,", "e?!", "ß.", "1."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5_000)] + ["", None, "z" * 100_000]
    ids, counts = token_files.Encoder(tokenizer_json).encode(pa.array(texts), 7)
    want = [library(t) + [7] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    special = token_files.Encoder(tokenizer_json, special=True)
    assert special.encode(pa.array(["a<|endoftext|>"]))[0].tolist() == [64, 50256]


def expected(rows, library):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*library(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_token_file_query(spark, sf_dir, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert [tuple(r) for r in token_files.op13_token_files(spark, sf_dir).orderBy("doc_id").collect()] == expected(docs, library)


def test_token_files(spark, tokenizer_json, library, sf_dir):
    path = work_path(spark, "tokens")
    docs = odd(spark).union(odd(spark).where("doc_id = 4"))
    token_files.write_tokens(docs, path, tokenizer_json, end_id=0, shards=5)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == docs.count() and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    by_start = 0
    for r in got:
        assert r.start == by_start and len(r.ids) == 4 * r.n_tokens
        by_start += r.n_tokens
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == [*library(texts[r.doc_id]), 0]
    shards = token_files.Shards(path)
    assert [x.tolist() for x in shards.get(4)] == [[*library(texts[4]), 0]] * 4
    assert shards.get(777) == [] and shards.get(-3)[0].tolist() == [*library(texts[-3]), 0]
    one = token_files.read_tokens(spark, path, [4])
    assert one.count() == 4 and one.rdd.getNumPartitions() < token_files.read_tokens(spark, path).rdd.getNumPartitions()
    assert sorted(r.doc_id for r in token_files.read_tokens(spark, path, [1, 6, 777]).collect()) == [1, 6] and token_files.read_tokens(spark, path, [777]).count() == 0
    twice = token_files.read_tokens(spark, path)
    assert (twice.where("doc_id = 5").count(), twice.where("doc_id = 6").count(), twice.where("doc_id is null").count()) == (1, 1, 2)
    delete_path(spark, path)


def test_dictionary_and_damage(spark, tokenizer_json, sf_dir, tmp_path):
    path = str(tmp_path / "tokens")  # a plain path
    token_files.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_json, shards=2)
    shards = token_files.Shards(path)
    assert shards.manifest["dictionary"] == hashlib.sha256((tmp_path / "tokens/dictionary.bin").read_bytes()).hexdigest() and (tmp_path / "tokens/dictionary.bin").stat().st_size > 1000
    one = shards.get(shards.manifest["shards"][0]["first"])[0]
    (tmp_path / "tokens/dictionary.bin").write_bytes(b"another")
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Shards(path).get(shards.manifest["shards"][0]["first"])
    file = tmp_path / "tokens" / shards.manifest["shards"][0]["file"]
    content = bytearray(file.read_bytes())
    content[-60] ^= 1
    file.write_bytes(bytes(content))
    with pytest.raises(ValueError, match="damaged"):
        token_files.Shards(path).get(shards.manifest["shards"][0]["first"])
    assert len(one)


def test_empty_table_of_tokens(spark, tokenizer_json):
    path = work_path(spark, "tokens")
    token_files.write_tokens(odd(spark).limit(0), path, tokenizer_json, end_id=0)
    assert token_files.read_tokens(spark, path).count() == 0 and token_files.Shards(path).manifest["shards"] == []


def test_sql_of_phrases(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(c.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.ORACLE.strip()})").fetchall())
    assert rows_of(phrases.op11_collocations(spark, sf_dir)) == want
