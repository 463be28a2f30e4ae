"""Tokens of prompts: ids and counts by a public vocabulary, as columns.

A vocabulary is a file: ranks (a base64 token and its rank on each line) or a tokenizer's
JSON.  It is read once on the driver and goes with the function (Spark broadcasts what is
larger than a megabyte); each worker builds its encoder once; texts go through in Arrow
batches, equal texts of a batch once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

#: How texts are split before merges, where a ranks file doesn't say (a public pattern, fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoder(content: bytes, pattern: str) -> Callable[[list[str]], list[list[int]]]:
    if content.lstrip()[:1] == b"{":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(content.decode())
        made.encode_special_tokens = True
        return lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}
    name = hashlib.sha256(content).hexdigest()
    made = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [made.encode_ordinary(t) for t in texts]


@dataclass(frozen=True)
class PromptTokenizer:
    """A vocabulary in which each of `letters` is one token, also after `before`, the end of what stands in front of an answer.

    Strings of special tokens in a text are ordinary text.  Null texts have null ids and
    no count; an empty text has none.
    """

    content: bytes
    pattern: str = PATTERN
    letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    before: str = "\n\n"

    @classmethod
    def read(cls, path: str, **how: str) -> PromptTokenizer:
        return cls(Path(path).read_bytes(), **how)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return _encoder(self.content, self.pattern)(texts)

    def letter_ids(self) -> list[int]:
        """The id of each letter; an error if one isn't a token of its own, alone and after `before`."""
        ids = []
        for letter, alone, behind in zip(self.letters, self.encode(list(self.letters)), self.encode([self.before + x for x in self.letters]), strict=True):
            if len(alone) != 1:
                raise ValueError(f"letter {letter!r} is {len(alone)} tokens")
            if behind[-1] != alone[0]:
                raise ValueError(f"letter {letter!r} merges with what stands before it")
            ids.append(alone[0])
        return ids

    def _over(self, text: Column, value: Callable[[list[int]], object], kind) -> Column:  # noqa: ANN001
        sent = self

        def run(s: pd.Series) -> pd.Series:
            given = s.dropna()
            different = given.unique().tolist()
            found = dict(zip(different, map(value, sent.encode(different)), strict=True))
            return s.map(lambda x: None if x is None else found[x]).astype("Int64" if kind == LongType() else object)

        return F.pandas_udf(run, kind)(text)

    def ids(self, text: Column) -> Column:
        return self._over(text, list, ArrayType(IntegerType()))

    def count(self, text: Column) -> Column:
        return self._over(text, len, LongType())
