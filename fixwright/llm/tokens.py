"""Counting subword tokens with a whole-token shortcut.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then merges each of
them. Before any text is read, every string of the vocabulary is encoded alone; the ones
that come out as the single token they stand for are proven whole. A pre-token that is
one of them counts as one, without merging. Only the other pre-tokens are merged, each
distinct one once while it stays in a bounded memory. Where the tokenizer's merges are
listed in the order of the ids they make, which is checked, they run as ranks in the
fast merge loop of a second library; otherwise the tokenizer's own library merges.

The cut is made with the tokenizer's own pattern. For each distinct character outside
ASCII the library is asked once whether it puts the character in the same class; a text
with a character on which the two disagree, or with one of the tokenizer's added
strings, is encoded by the library as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shadowed

NAME = "byte_bpe_50k.json"
LIMIT = 512
REMEMBERED = 400_000  # merged pre-tokens that a worker keeps
ADDED = ("n_bytes", "n_tokens", "over_limit")
#: The pre-token pattern of byte-level BPE tokenizers of this kind; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_file(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Token counts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values() if t.content)
        self.cut = regex.compile(PATTERN).findall
        self.letter = regex.compile(r"(\p{L})|(\p{N})|(\s)").match
        self.whole = self._proven()
        self.merge = self._ranked(path) or self._by_library
        self.merged: dict[str, int] = {}
        self.same: dict[str, bool] = {}

    def _proven(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as their one token."""
        ids = self.library.get_vocab(with_added_tokens=False)
        texts = [self.library.decode([i], skip_special_tokens=False) for i in ids.values()]
        alone = self.library.encode_batch(texts, add_special_tokens=False)
        return frozenset(
            t for t, i, e in zip(texts, ids.values(), alone, strict=True) if e.ids == [i] and self.cut(t) == [t] and t not in self.added
        )

    def _by_library(self, pieces: list[str]) -> list[int]:
        return list(map(len, self.library.encode_batch_fast(pieces, add_special_tokens=False)))

    def _ranked(self, path: str):
        """A merge loop over ranks, if ids are ranks: single bytes first, then one id for each merge in order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of_letter()
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or model.get("ignore_merges"):
            return None
        named = {t: i for t, i in vocab.items() if i < 256 + len(merges)}
        if sorted(i for t, i in named.items() if len(t) == 1) != list(range(256)) or not all(c in byte for t in named for c in t):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in named.items()}
        one = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        return lambda pieces: [len(one(p.encode())) for p in pieces]

    def _agrees(self, char: str) -> bool:
        """Whether the library puts a character in the class in which the pattern puts it."""
        found = self.letter(char)
        kind = found.lastindex if found else 0
        pieces = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        theirs = 1 if pieces(f"a{char}a") == 1 else 2 if pieces(f"1{char}1") == 1 else 0 if pieces(f"!{char}!") == 1 else 3
        return kind == theirs

    def _regular(self, text: str) -> bool:
        if any(s in text for s in self.added):
            return False
        if text.isascii():
            return True
        for c in set(text):
            if c not in self.same:
                self.same[c] = c.isascii() or self._agrees(c)
            if not self.same[c]:
                return False
        return True

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) if self._regular(t) else None for t in texts]
        rest = [[p for p in c if p not in self.whole] if c is not None else [] for c in cut]
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        new = list({p for r in rest for p in r if p not in self.merged})
        self.merged.update(zip(new, self.merge(new), strict=True))
        merged = self.merged.__getitem__
        return [
            len(self.library.encode(t, add_special_tokens=False).ids) if c is None
            else len(c) - len(r) + sum(map(merged, r))
            for t, c, r in zip(texts, cut, rest, strict=True)
        ]


def _byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every row with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    The counts are the library's for the tokenizer file at ``path``, without begin, end or
    added special tokens, truncation or padding; an added string inside a text counts as
    the library counts it by default. A null text counts as empty: no bytes, no tokens.
    Input columns with these names are replaced; rows are neither merged nor dropped.
    """
    kept = shadowed(docs, *ADDED)
    names = kept.columns
    rows = docs.select(
        *[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")
    ).withColumn("n_bytes", F.octet_length("__text").cast("bigint"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for b in batches:
            at = b.schema.get_field_index("__text")
            texts = b.column(at).to_pylist()
            n = [x for i in range(0, len(texts), 500) for x in of(texts[i : i + 500])]
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(n, pa.int64())], [*(b.schema.names[i] for i in keep), "n_tokens"]
            )

    schema = T.StructType([*rows.drop("__text").schema.fields, T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(read, schema).withColumn("over_limit", F.col("n_tokens") > limit)
