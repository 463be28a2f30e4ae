"""Token ids in binary shard files, compressed document by document with one shared zstandard dictionary.

Format.  A folder holds `dictionary.bin`, `manifest.json` and one file for each shard.  A
shard is MAGIC, the header's length (4 bytes), a JSON header (vocabulary's and
dictionary's sha256, bytes of an id), one zstandard frame for each document, the offset
index (INDEX: a row for each document, in order), the index's crc32, its place, the
number of documents and MAGIC again.  A frame holds a document's ids as little-endian
numbers of 2 or 4 bytes, with a checksum.  The manifest lists the committed shards in
order, with their ids of first and last document and the tokens before each, so a
document is read with one search in the manifest, one in an index and one range read.

The dictionary is trained on the serialized ids of at most `sample` documents of at most
`sample_chars` characters (those with the least hashes of id and text, so it doesn't
depend on how rows are dealt): short documents are what it is for.  With too few of
those there is none, and the manifest says so.

Encoding.  The library encodes each different chunk of a task once.  A chunk is what
stands between single spaces and line ends, with the space or line end before it, less
the signs at its end: the pre-tokenizer's pattern always begins a match there.  A text where that isn't so (blanks
in a row or at an end, other white space beside them) is encoded whole.

Order.  Rows are dealt by ranges of doc_id and sorted; a repeated id's rows, and those
without id, come in order of their texts' hashes and may lie in several shards.  Null ids
come first and stay null.  Null and empty texts are documents of the end id alone.  An
empty table gives a manifest without shards.  Extra columns are ignored.

Recovery.  A task writes a file of its own name for each attempt; Spark commits one
attempt of each task, and only those come into the manifest, which is written last.
Files of other attempts are deleted then.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ._common import arrow_map, release_memory, session, table, work_path

MAGIC = b"TOKSHRD1"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("at", "<u8"), ("size", "<u8"), ("tokens", "<u8"), ("start", "<u8")])
ENCODED = "doc_id long, ids binary"
#: Bytes of texts that are split at once.
SLICE = 8 << 20
#: Chunks whose ids a worker remembers, and bytes of a batch of documents that is read back.
CACHE, READ_BYTES = 2_000_000, 4 << 20
#: Signs that are cut from a chunk's end where a letter or digit stands before them.
SIGNS, LETTER_LAST = ".,;:!?", "[A-Za-z0-9À-ÖØ-öø-ɏ]$"


# ---- encoding

class _Chunks:
    """The ids of chunks seen, on end in one array; by what a chunk follows, its text and the number of its entry."""

    def __init__(self, library: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], line_end: int) -> None:
        self.library, self.line_end = library, line_end
        self.clear()

    def clear(self) -> None:
        self.words = [pa.array([], pa.string())] * 3
        self.entries = [np.empty(0, np.int64)] * 3
        self.tails: dict[str, np.ndarray] = {}
        self.ids, self.starts = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)
        self.n = 0  # entries; entry i has ids starts[i] to starts[i + 1]

    def _add(self, kind: int, words: pa.Array, new: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        begin, end, m = int(self.starts[self.n]), int(self.starts[self.n]) + len(new), len(words)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + m >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[begin:end] = new
        self.starts[self.n + 1 : self.n + 1 + m] = begin + np.cumsum(sizes)
        numbers = np.arange(self.n, self.n + m)
        self.words[kind], self.entries[kind] = pa.concat_arrays([self.words[kind], words]), np.concatenate([self.entries[kind], numbers])
        self.n += m
        return numbers

    def find(self, kind: int, words: pa.Array) -> np.ndarray:
        """The entries of different words; those that aren't there are encoded, a stem and the signs at its end apart."""
        stems = pc.utf8_rtrim(words, characters=SIGNS)
        stems = pc.if_else(pc.match_substring_regex(stems, LETTER_LAST), stems, words)  # a match ends between a letter or digit and a sign
        at = pc.index_in(pa.concat_arrays([words, stems]), value_set=self.words[kind]).fill_null(-1).to_numpy()
        entry = np.full(len(at), -1, np.int64)
        entry[at >= 0] = self.entries[kind][at[at >= 0]]
        out, of_stem = entry[: len(words)], entry[len(words) :]
        missing = np.flatnonzero(out < 0)
        if len(missing):
            need = missing[of_stem[missing] < 0]
            new = stems.take(pa.array(need)).dictionary_encode()
            of_stem[need] = self._encode(kind, new.dictionary)[new.indices.to_numpy()]
            cut = missing[pc.not_equal(stems, words).to_numpy(zero_copy_only=False)[missing]]
            out[missing] = of_stem[missing]
            if len(cut):
                longer = words.take(pa.array(cut))
                ends = [w[len(x) :] for w, x in zip(_strings(longer), _strings(stems.take(pa.array(cut))), strict=True)]
                tails = list(set(ends) - self.tails.keys())
                ids, sizes = self.library(tails)
                self.tails.update(zip(tails, np.split(ids, np.cumsum(sizes)[:-1]) if tails else [], strict=True))
                begins, stops = self.starts[of_stem[cut]].tolist(), self.starts[of_stem[cut] + 1].tolist()
                parts = [y for i, j, t in zip(begins, stops, ends, strict=True) for y in (self.ids[i:j], self.tails[t])]
                lens = np.fromiter(map(len, parts), np.int64, len(parts))
                out[cut] = self._add(kind, longer, np.concatenate(parts), lens[::2] + lens[1::2])
        return out

    def _encode(self, kind: int, words: pa.Array) -> np.ndarray:
        numbers = [np.empty(0, np.int64)]
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            if kind < 2:
                numbers.append(self._add(kind, part, *self.library([" " * kind + w for w in _strings(part)])))
            else:  # a line end is a match of its own
                ids, sizes = self.library(_strings(part))
                numbers.append(self._add(kind, part, np.insert(ids, np.cumsum(sizes) - sizes, self.line_end), sizes + 1))
        return np.concatenate(numbers)


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Texts to ids, each different chunk once; `special` takes the strings of special tokens in a text as such."""

    def __init__(self, tokenizer_json: str, special: bool = False) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = not special
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids  # of a byte-level vocabulary
        self.known = _Chunks(self.pieces, self.line_end)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short texts on end, and their numbers.  Texts without line ends go to the library on lines of one text; no other id holds a line end."""
        if texts and not any(not x or "\n" in x for x in texts):
            ids = self.library(["\n".join(texts)])[0]
            cuts = np.flatnonzero(ids == self.line_end)
            if len(cuts) == len(texts) - 1:
                return ids[ids != self.line_end], np.diff(np.r_[-1, cuts, len(ids)]) - 1
        each = self.library(texts)
        return np.concatenate([np.empty(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and each text's number of ids; end_id is added to each."""
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
        parts = [self._encode(pc.fill_null(texts[a:b], ""), end_id) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return np.concatenate([np.empty(0, np.uint32), *[x for x, _ in parts]]), np.concatenate([np.empty(0, np.int64), *[x for _, x in parts]])

    def _encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self.known.n > CACHE:
            self.known.clear()
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_at, word_at = lines.offsets.to_numpy(), words.offsets.to_numpy()
        flat = words.flatten().dictionary_encode()
        at, names = flat.indices.to_numpy(), flat.dictionary
        first = word_at[line_at]  # of each text, and the end
        kind = np.ones(len(at), np.int8)  # what a chunk follows: 0 nothing, 1 a space, 2 a line end
        kind[word_at[:-1]] = 2
        kind[first[:-1]] = 0
        empty = pc.equal(names, "").to_numpy(zero_copy_only=False)[at]
        odd = pc.not_equal(pc.utf8_trim_whitespace(names), names).to_numpy(zero_copy_only=False)[at] | empty
        # an empty line between two that aren't: both line ends are matches of their own
        good, ends = np.r_[~odd, False], np.r_[kind == 2, False]
        odd &= ~(empty & (kind == 2) & np.r_[False, good[:-2]] & good[1:] & ends[1:])
        whole = np.logical_or.reduceat(odd, first[:-1])
        whole[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = False
        used = np.repeat(~whole, np.diff(first))
        entry = np.zeros(len(at), np.int64)
        for k in range(3):
            mine = used & (kind == k)
            which = at[mine]
            seen = np.zeros(len(names), bool)
            seen[which] = True
            entry_of = np.zeros(len(names), np.int64)
            entry_of[seen] = self.known.find(k, names.filter(pa.array(seen)))
            entry[mine] = entry_of[which]
        starts, ids = self.known.starts, self.known.ids
        sizes = np.where(used, starts[entry + 1] - starts[entry], 0)
        counts = np.add.reduceat(sizes, first[:-1])
        others = np.flatnonzero(whole)
        alone = self.library(texts.take(pa.array(others)).to_pylist()) if len(others) else []
        counts[others] = [len(x) for x in alone]
        counts += end_id is not None
        place = np.cumsum(counts) - counts
        out = np.full(int(counts.sum()), end_id or 0, np.uint32)
        before = np.cumsum(sizes) - sizes
        steps = np.arange(int(sizes.sum()))
        shift = np.repeat(place - before[first[:-1]], np.diff(first))  # from places among the chunks' ids to places in out
        out[steps + np.repeat(shift, sizes)] = ids[steps + np.repeat(starts[entry] - before, sizes)]
        for i, x in zip(others.tolist(), alone, strict=True):
            out[place[i] : place[i] + len(x)] = x
        return out, counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(tokenizer_json: str, special: bool) -> Encoder:
    """One for each worker process: later tasks find its chunks."""
    name = (hashlib.sha256(tokenizer_json.encode()).hexdigest(), special)
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(tokenizer_json, special)
    return _encoders[name]


def encoded(docs: DataFrame, tokenizer_json: str, *, end_id: int | None = None, special: bool = False) -> DataFrame:
    """doc_id, ids (little-endian numbers of 4 bytes) of each row, in the rows' order."""
    sent = session(docs).sparkContext.broadcast(tokenizer_json)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encoder = _encoder(sent.value, special)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = encoder.encode(batch["text"], end_id)
            offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            return pa.RecordBatch.from_arrays([batch["doc_id"], packed], names=["doc_id", "ids"])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, ENCODED)


# ---- files

def _store(path: str):
    """The file system that path is in, and path there: anything that pyarrow opens, so executors need no local copy."""
    from pyarrow.fs import FileSystem

    if "://" not in path and not path.startswith("file:/"):
        return FileSystem.from_uri(f"file://{path}")
    return FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else path.replace("file:", "file://", 1))


def _read(path: str, begin: int = 0, size: int | None = None) -> bytes:
    fs, at = _store(path)
    with fs.open_input_file(at) as f:
        return f.read_at(f.size() if size is None else size, begin)


def _write(path: str, content: bytes) -> None:
    fs, at = _store(path)
    with fs.open_output_stream(at) as f:
        f.write(content)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most size bytes; none (b"") from too few samples."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=3).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


@dataclass
class Shard(WriterCommitMessage):
    """A committed file: what the manifest says of it."""

    partition: int
    file: str
    docs: int
    tokens: int
    first: int | None
    last: int | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, level: int, vocabulary: str) -> None:
        self.path, self.width, self.level, self.vocabulary = path, width, level, vocabulary

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        import zstandard

        dictionary = _read(f"{self.path}/dictionary.bin")
        how = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        zip_ = zstandard.ZstdCompressor(level=self.level, write_checksum=True, **how)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        head = json.dumps({"vocabulary": self.vocabulary, "dictionary": hashlib.sha256(dictionary).hexdigest(), "width": self.width}).encode()
        kind = f"<u{self.width}"
        rows: list[np.ndarray] = []
        fs, at = _store(f"{self.path}/{name}")
        with fs.open_output_stream(at) as f:
            f.write(MAGIC + len(head).to_bytes(4, "little") + head)
            place, start = len(MAGIC) + 4 + len(head), 0
            for batch in iterator:
                keys, index = batch["doc_id"], np.zeros(len(batch), INDEX)
                index["has_id"] = keys.is_valid().to_numpy(zero_copy_only=False)
                index["doc_id"] = keys.fill_null(0).to_numpy()
                for i, x in enumerate(batch["ids"]):
                    ids = np.frombuffer(x.as_buffer(), "<u4")
                    small = ids.astype(kind)
                    if self.width < 4 and len(ids) and int(ids.max()) >> 8 * self.width:
                        raise ValueError(f"an id needs more than {self.width} bytes")
                    frame = zip_.compress(small.tobytes())
                    f.write(frame)
                    index[i]["at"], index[i]["size"], index[i]["tokens"], index[i]["start"] = place, len(frame), len(ids), start
                    place += len(frame)
                    start += len(ids)
                rows.append(index)
            index = np.concatenate(rows) if rows else np.zeros(0, INDEX)
            f.write(index.tobytes() + zlib.crc32(index.tobytes()).to_bytes(4, "little") + place.to_bytes(8, "little") + len(index).to_bytes(8, "little") + MAGIC)
        release_memory()
        named = index["doc_id"][index["has_id"] > 0]
        return Shard(part, name, len(index), start, int(named[0]) if len(named) else None, int(named[-1]) if len(named) else None)

    def commit(self, messages: list[Shard | None]) -> None:
        from pyarrow.fs import FileSelector

        shards, before = [], 0
        for s in sorted((m for m in messages if m and m.docs), key=lambda m: m.partition):
            shards.append(asdict(s) | {"start": before})
            before += s.tokens
        fs, at = _store(self.path)
        ours = {s["file"] for s in shards}
        for f in fs.get_file_info(FileSelector(at)):
            if f.base_name.endswith(".tok") and f.base_name not in ours:
                fs.delete_file(f.path)  # of attempts that weren't committed, and of tasks without rows
        dictionary = _read(f"{self.path}/dictionary.bin")
        _write(f"{self.path}/manifest.json", json.dumps({"vocabulary": self.vocabulary, "dictionary": hashlib.sha256(dictionary).hexdigest(), "width": self.width, "tokens": before, "shards": shards}).encode())

    def abort(self, messages: list[Shard | None]) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m:
                fs.delete_file(_store(f"{self.path}/{m.file}")[1])


class Shards:
    """A folder of shard files, opened for reading."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.manifest = json.loads(_read(f"{path}/manifest.json"))
        self._zip = None
        self._index: dict[str, np.ndarray] = {}

    def decompress(self, frame: bytes) -> np.ndarray:
        import zstandard

        if self._zip is None:
            dictionary = _read(f"{self.path}/dictionary.bin")
            if hashlib.sha256(dictionary).hexdigest() != self.manifest["dictionary"]:
                raise ValueError("the dictionary isn't the one that these files were written with")
            self._zip = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
        return np.frombuffer(self._zip.decompress(frame), f"<u{self.manifest['width']}").astype("<u4")

    def index(self, file: str) -> np.ndarray:
        if file not in self._index:
            at = f"{self.path}/{file}"
            fs, p = _store(at)
            with fs.open_input_file(p) as f:
                tail = f.read_at(20 + len(MAGIC), f.size() - 20 - len(MAGIC))
                crc, place, docs, magic = int.from_bytes(tail[:4], "little"), int.from_bytes(tail[4:12], "little"), int.from_bytes(tail[12:20], "little"), tail[20:]
                found = f.read_at(docs * INDEX.itemsize, place)
            if magic != MAGIC or zlib.crc32(found) != crc:
                raise ValueError(f"{at} is damaged")
            self._index[file] = np.frombuffer(found, INDEX)
        return self._index[file]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents of an id: a search in the manifest, one in each index that can hold it, a range read for each document."""
        found = []
        shards = [s for s in self.manifest["shards"] if s["last"] is not None]
        at = bisect.bisect_left([s["last"] for s in shards], doc_id)
        while at < len(shards) and shards[at]["first"] <= doc_id:
            index = self.index(shards[at]["file"])
            named = index[int((index["has_id"] == 0).sum()) :]  # null ids come first
            for row in named[np.searchsorted(named["doc_id"], doc_id) : np.searchsorted(named["doc_id"], doc_id, "right")]:
                found.append(self.decompress(_read(f"{self.path}/{shards[at]['file']}", int(row["at"]), int(row["size"]))))
            at += 1
        return found


@dataclass
class _Part(InputPartition):
    file: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, doc_ids: list[int] | None) -> None:
        self.path, self.wanted = path, doc_ids if doc_ids is None else sorted(set(doc_ids))

    def partitions(self) -> list[_Part]:
        def may(s: dict) -> bool:
            if self.wanted is None:
                return True
            return s["last"] is not None and bisect.bisect_left(self.wanted, s["first"]) < bisect.bisect_right(self.wanted, s["last"])

        return [_Part(s["file"], s["start"]) for s in Shards(self.path).manifest["shards"] if may(s)]

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's way to read without partitions
            return
        shards = Shards(self.path)
        index = shards.index(part.file)
        if self.wanted is not None:
            index = index[(index["has_id"] > 0) & np.isin(index["doc_id"], self.wanted)]
        fs, at = _store(f"{self.path}/{part.file}")
        with fs.open_input_file(at) as f:
            begin = 0
            while begin < len(index):
                end = begin + max(1, int(np.searchsorted(np.cumsum(index["tokens"][begin:]) * 4, READ_BYTES, "right")))
                rows = index[begin:end]
                ids = [shards.decompress(f.read_at(int(r["size"]), int(r["at"]))).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows["doc_id"], pa.int64(), mask=rows["has_id"] == 0), pa.array(rows["start"].astype(np.int64) + part.start), pa.array(rows["tokens"].astype(np.int64)), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])
                begin = end
        release_memory()


class TokenShards(DataSource):
    """Format "token_shards".  Written: doc_id, ids (binary, 4 bytes an id), one shard for each partition, to the option path, whose
    dictionary.bin is there.  Read: doc_id, start, n_tokens, ids; the option doc_ids (JSON list) leaves out shards and frames of
    others.  (No pushed filter: Spark would keep the first one for a frame's other uses.)"""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        o = self.options
        return _Writer(o["path"], int(o.get("width", 4)), int(o.get("level", 3)), o.get("vocabulary", ""))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], json.loads(self.options["doc_ids"]) if "doc_ids" in self.options else None)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TokenShards)
    return spark


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, *, end_id: int | None = None, special: bool = False, shards: int | None = None, dictionary_size: int = 65_536, sample: int = 2_000, sample_chars: int = 8_192, level: int = 3) -> None:
    """Encodes docs and writes them to the folder path, which mustn't exist; see the module's text."""
    spark = _registered(session(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_text = F.xxhash64("text")
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)).between(1, sample_chars)).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample)
    vocabulary = json.loads(tokenizer_json)["model"]["vocab"]
    top = max([max(vocabulary.values()), *[t["id"] for t in json.loads(tokenizer_json).get("added_tokens", [])], end_id or 0])
    width = 2 if top < 1 << 16 else 4
    samples = [np.frombuffer(r.ids, "<u4").astype(f"<u{width}").tobytes() for r in encoded(short, tokenizer_json, end_id=end_id, special=special).select("ids").collect()]
    fs, at = _store(path)
    fs.create_dir(at, recursive=True)
    _write(f"{path}/dictionary.bin", train_dictionary(samples, dictionary_size))
    dealt = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first(), by_text, F.monotonically_increasing_id())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), by_text)
    made = encoded(ordered, tokenizer_json, end_id=end_id, special=special)
    made.write.format("token_shards").mode("append").options(width=width, level=level, vocabulary=hashlib.sha256(tokenizer_json.encode()).hexdigest()).save(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids of the documents in the folder, or of some (a list for lookups; larger sides join)."""
    reader = _registered(spark).read.format("token_shards")
    return (reader if doc_ids is None else reader.option("doc_ids", json.dumps([int(i) for i in doc_ids]))).load(path)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathlib import Path

    import public_tokenizers

    path = work_path(session(table(spark, sf_dir, "documents")), "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), end_id=0)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
