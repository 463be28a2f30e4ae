"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database for each task.

A text is split by a pattern; each piece that is no token itself becomes token-position
rows.  A recursive query joins neighbouring positions with the merge table, contracts
each word's leftmost pair of least rank, and ends when no word has a pair left; an
ordered aggregation of the tokens' bytes decodes.  Each different piece of a task is
worked on once, however often it occurs, and nothing is shuffled.

Defined results.  A null text counts as empty: no tokens, and the hashes of no bytes.
Rows are neither dropped nor merged; repeated ids give repeated rows.  A piece of any
length is encoded: a long one is cut between bytes that stand side by side in no token,
which no merge crosses, a round of what is still long contracts all places of its pair of
least rank, and what a query gathers is bounded by bytes.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, session, table

#: Pieces that one recursive query works on, and pieces whose encoding a task keeps.
QUERY_WORDS = 25_000
CACHE_WORDS = 500_000
#: Characters of text whose pieces a task holds at a time.
SLICE_CHARS = 1_000_000

#: Rounds of one query; a word that has pairs left then goes to the next one, so that what a query gathers stays bounded.
QUERY_ROUNDS = 256
#: Ids that one query gathers, over all its rounds.
QUERY_IDS = 4_000_000
#: Bytes from which a piece is long: a round contracts all places of a pair, not the leftmost alone.
LONG_BYTES = 1_000

# best: the pair of least rank, at its leftmost position: rank and position in one number
ENCODE_SQL = """
WITH RECURSIVE s(w, ids, step) AS (
  SELECT w, list(tok ORDER BY p), 0 FROM ini GROUP BY w
  UNION ALL
  (WITH pairs AS (
     SELECT w, unnest(ids[:-2]) AS tok, unnest(ids[2:]) AS next, generate_subscripts(ids[2:], 1) AS p
     FROM s WHERE step < {rounds}),
   hit AS (
     SELECT w, best & 4294967295 AS p, (best >> 32)::INT AS k
     FROM (SELECT w, min((m.k::BIGINT << 32) + p) AS best
           FROM pairs JOIN merges m ON m.lr = tok::BIGINT * 1048576 + next GROUP BY w))
   SELECT w, ids[:p - 1] || [k] || ids[p + 2:], step + 1 FROM s JOIN hit USING (w))
)
SELECT w, ids, step, false AS early FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) USING (w, step)
"""

# all places of the pairs of least rank, of overlapping ones each second; early: a contraction has made a pair of lesser rank,
# or could have made one before its next place, and then the leftmost place alone was the one to contract
LONG_SQL = """
WITH RECURSIVE s(w, ids, last, early, step) AS (
  SELECT w, list(tok ORDER BY p), -1, false, 0 FROM ini GROUP BY w
  UNION ALL
  (WITH pairs AS (
     SELECT w, unnest(ids[:-2]) AS tok, unnest(ids[2:]) AS next, generate_subscripts(ids[2:], 1) AS p
     FROM s WHERE step < {rounds} AND NOT early),
   hit AS MATERIALIZED (SELECT w, p, m.k, m.alone FROM pairs JOIN merges m ON m.lr = tok::BIGINT * 1048576 + next),
   best AS MATERIALIZED (SELECT w, min(k) AS k FROM hit GROUP BY w),
   run AS MATERIALIZED (SELECT w, p, k, alone, p - row_number() OVER (PARTITION BY w ORDER BY p) AS run FROM hit JOIN best USING (w, k)),
   take AS MATERIALIZED (
     SELECT w, p, k FROM (SELECT w, p, k, row_number() OVER (PARTITION BY w, run ORDER BY p) AS n FROM run) WHERE n % 2 = 1),
   now AS (SELECT w, unnest(ids) AS tok, generate_subscripts(ids, 1) AS p FROM s SEMI JOIN best USING (w)),
   new AS (
     SELECT w, list(coalesce(t.k, tok) ORDER BY p) AS ids FROM now LEFT JOIN take t USING (w, p)
     WHERE NOT EXISTS (FROM take u WHERE u.w = now.w AND u.p + 1 = now.p) GROUP BY w),
   alone AS (SELECT w, bool_or(alone) AS alone FROM run GROUP BY w)
   SELECT w, new.ids, k, k < last OR alone, step + 1 FROM s JOIN best USING (w) JOIN new USING (w) JOIN alone USING (w))
)
SELECT w, ids, step, early FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) USING (w, step)
"""

DECODE_SQL = """
SELECT w, string_agg(v.piece, '' ORDER BY p) AS decoded
FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM encoded) e JOIN vocabulary v USING (id)
GROUP BY w
"""

# what is kept of a word: its ids as decimals, and the bytes that they decode to
BOTH_SQL = f"""
WITH encoded AS MATERIALIZED (FROM done), decoded AS ({DECODE_SQL})
SELECT w, array_to_string(ids, ',') AS ids, decoded FROM encoded JOIN decoded USING (w)
"""


@dataclass(frozen=True)
class Vocabulary:
    """pattern splits texts; tokens: the bytes of each rank.  Its size bounds what is sent to the tasks."""

    pattern: str
    ranks: dict[bytes, int]


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: a line for each token, its bytes in base64 and its rank.  Read once, on the driver."""
    with open(path, "rb") as f:
        return Vocabulary(pattern, {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Each way to join two tokens to a third: left * 2^20 + right, and the third's rank."""
    keys, ks = [], []
    for token, k in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append((a << 20) + b)
                ks.append(k)
    return keys, ks


def lone_merges(keys: list[int], ks: list[int]) -> list[bool]:
    """Of each merge, whether its token and what another place of it begins with make a token of lesser rank."""
    lefts: dict[int, set[int]] = {}
    for key, k in zip(keys, ks, strict=True):
        lefts.setdefault(k, set()).add(key >> 20)
    lone = {key >> 20 for key, k in zip(keys, ks, strict=True) if k < key >> 20 and key & 1048575 in lefts.get(key >> 20, ())}
    return [k in lone for k in ks]


class Coder:
    """Encodes and decodes pieces in a DuckDB database of its own, in memory."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import duckdb
        import numpy as np
        import regex

        self.split = regex.compile(vocabulary.pattern).findall
        self.ranks = vocabulary.ranks
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "256MB", "temp_directory": f"{tempfile.gettempdir()}/granary-bpe-{uuid.uuid4().hex}"})
        self.db.execute("SET enable_progress_bar = false")
        keys, ks = merge_rows(self.ranks)
        self.db.register("merge_rows", pa.table({"lr": pa.array(keys, pa.int64()), "k": pa.array(ks, pa.int32()), "alone": lone_merges(keys, ks)}))
        # bytes stand as the characters U+0001 to U+0100 (for byte 0), so that text aggregation keeps them
        pieces = ["".join(chr(b or 256) for b in t) for t in self.ranks]
        self.db.register("pieces", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": pieces}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows; CREATE TABLE vocabulary AS SELECT * FROM pieces")
        self.ids: dict[str, str] = {}
        #: What a piece's ids, as decimals, decode to: texts are decoded from the ids that are given out, and never from their own pieces.
        self.bytes: dict[str, bytes] = {}
        self.token = {k: t for t, k in self.ranks.items()}
        # bytes that stand side by side in some token: no merge joins others
        self.joined = np.zeros((256, 256), bool)
        for t in self.ranks:
            if len(t) > 1:
                a = np.frombuffer(t, np.uint8)
                self.joined[a[:-1], a[1:]] = True

    @staticmethod
    def _plain(text: str) -> bytes:
        return (text.replace("\u0100", "\0") if "\u0100" in text else text).encode("latin-1")

    def _keep(self, piece: str, ids: str, decoded: bytes) -> None:
        self.ids[piece] = ids
        self.bytes[ids] = decoded

    def _rounds(self, rows: pa.Table) -> None:
        """Encodes token-position rows (w, p, tok) of words that are all long or all short to the table `done` (w, ids)."""
        self.db.execute("CREATE OR REPLACE TABLE done (w INTEGER, ids INTEGER[])")
        self.db.register("start", rows)
        self.db.execute("CREATE OR REPLACE TABLE ini AS FROM start")
        if (self.db.execute("SELECT max(p) + 1 FROM start").fetchall()[0][0] or 0) < LONG_BYTES:
            return self._contract(ENCODE_SQL, QUERY_ROUNDS)
        rounds = max(1, min(QUERY_ROUNDS, QUERY_IDS // rows.num_rows))
        self._contract(LONG_SQL, rounds)
        # those whose pairs have to be contracted one at a time begin anew
        self.db.execute("CREATE OR REPLACE TABLE ini AS FROM start WHERE w NOT IN (SELECT w FROM done)")
        self._contract(ENCODE_SQL, rounds)

    def _contract(self, sql: str, rounds: int) -> None:
        """Encodes the words of `ini` to `done`, by queries of so many rounds; without those that come out early."""
        while self.db.execute("SELECT count(*) FROM ini").fetchall()[0][0]:
            self.db.execute(f"CREATE OR REPLACE TABLE got AS {sql.format(rounds=rounds)}")
            self.db.execute(f"INSERT INTO done SELECT w, ids FROM got WHERE step < {rounds} AND NOT early")
            self.db.execute(f"CREATE OR REPLACE TABLE ini AS SELECT w, generate_subscripts(ids, 1)::BIGINT AS p, unnest(ids) AS tok FROM got WHERE step = {rounds} AND NOT early")

    @staticmethod
    def _parts(rest: list[bytes]) -> Iterator[list[bytes]]:
        """Short and long pieces apart; what a query gathers of a part stays within QUERY_IDS, or a part is one piece."""
        for long in (False, True):
            part, size = [], 0
            for x in rest:
                n = len(x)
                if (n >= LONG_BYTES) != long:
                    continue
                n *= 32 if long else min(n, QUERY_ROUNDS)
                if part and (len(part) == QUERY_WORDS or size + n > QUERY_IDS):
                    yield part
                    part, size = [], 0
                part.append(x)
                size += n
            if part:
                yield part

    def _segments(self, data: bytes) -> list[bytes]:
        """A piece's stretches that no merge crosses; a short piece is one."""
        import numpy as np

        if len(data) < LONG_BYTES:
            return [data]
        x = np.frombuffer(data, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.joined[x[:-1], x[1:]]) + 1).tolist(), len(data)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, pieces: set[str]) -> None:
        """Encodes and decodes those of the pieces that aren't known yet."""
        import numpy as np

        segments = {p: self._segments(p.encode()) for p in pieces - self.ids.keys()}
        known: dict[bytes, tuple[str, bytes]] = {}
        rest: list[bytes] = []
        for b in {b for parts in segments.values() for b in parts}:
            if (k := self.ranks.get(b)) is not None:
                known[b] = str(k), self.token[k]
            elif b:
                rest.append(b)
        table = np.array(self.byte, np.int32)
        for part in self._parts(rest):
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            data = np.frombuffer(b"".join(part), np.uint8)
            w = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
            p = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self._rounds(pa.table({"w": w, "p": p, "tok": table[data]}))
            got = self.db.sql(BOTH_SQL).to_arrow_table()
            for k, ids, text in zip(got["w"].to_numpy().tolist(), got["ids"].to_numpy(), got["decoded"].to_numpy(), strict=True):
                known[part[k]] = ids, self._plain(text)
        for p, parts in segments.items():
            if len(parts) == 1:
                self._keep(p, *known[parts[0]])
            else:
                self._keep(p, ",".join([known[b][0] for b in parts]), b"".join([known[b][1] for b in parts]))

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        out = [b""] * len(ids)
        for at in range(0, len(ids), QUERY_WORDS):
            part = ids[at : at + QUERY_WORDS]
            self.db.register("encoded", pa.table({"w": pa.array(range(len(part)), pa.int32()), "ids": pa.array(part, pa.list_(pa.int32()))}))
            got = self.db.sql(DECODE_SQL).to_arrow_table()
            for k, text in zip(got["w"].to_pylist(), got["decoded"].to_pylist(), strict=True):
                out[at + k] = self._plain(text)
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each text its ids, as decimals joined by commas, and their decoded bytes."""
        at = 0
        while at < len(texts):
            words, size = [], 0
            while at < len(texts) and (not words or size + len(texts[at]) <= SLICE_CHARS):
                words.append(self.split(texts[at]))
                size += len(texts[at])
                at += 1
            wanted = set().union(*words)
            if len(self.ids) + len(wanted) > CACHE_WORDS:
                self.ids.clear()
                self.bytes.clear()
            self.learn(wanted)
            ids, decoded = self.ids.__getitem__, self.bytes.__getitem__
            for w in words:
                given = list(map(ids, w))
                yield ",".join(given), b"".join(map(decoded, given))


def encode(docs: DataFrame, vocabulary: Vocabulary, *, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row and, if asked for, the ids themselves (array<int>)."""
    spark = session(docs)
    kept = docs.select(key, "text")
    sent = spark.sparkContext.broadcast(vocabulary)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = Coder(sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b, all_ids = [], [], [], []
            for joined, decoded in coder.texts([t or "" for t in batch["text"].to_pylist()]):
                n.append(joined.count(",") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    all_ids.append([int(x) for x in joined.split(",")] if joined else [])
            arrays = [batch[key], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array(all_ids, pa.list_(pa.int32()))] * ids], names=names)

        return step

    return arrow_map(kept, make, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, *, key: str = "doc_id") -> DataFrame:
    """key and decoded (binary) of rows with ids; null ids decode to no bytes, an unknown id to none of its own."""
    spark = session(rows)
    sent = spark.sparkContext.broadcast(vocabulary)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        coder = Coder(sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch[key], pa.array(coder.decode([x or [] for x in batch["ids"].to_pylist()]), pa.binary())], names=[key, "decoded"])

        return step

    return arrow_map(rows.select(key, "ids"), make, f"`{key}` {rows.schema[key].dataType.simpleString()}, decoded binary")


def production_vocabulary() -> Vocabulary:
    import public_tokenizers

    return load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), production_vocabulary(), ids=False)
