"""Problem 5: byte-pair encoding of all documents with a public vocabulary, and decoding.

A text is split by the vocabulary's pattern and each piece is encoded by backtracking. One pass of an Aho-Corasick
automaton over all tokens gives the longest token that starts at each byte. The encoder takes these from left to right.
A token may stand after the one before only if merging both, in the order of ranks, would leave exactly the two: a look-up
in the table of pairs that merge, along the halves each token was merged from. If it may not, a shorter token is tried, then
the last one is taken back. No byte is visited twice with the same outcome, so the time is linear in the piece.
"""

from __future__ import annotations

import base64
import importlib
import importlib.util
import os
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.llm.shared import table

#: Pieces that one Python worker remembers the ids of; beyond it the memory is emptied, results stay the same.
MEMORY = 300_000
VOCABULARY = "byte_bpe_50k"


def folder(path: str | None = None) -> str:
    """Where the vocabularies lie: path, else TOKENIZERS, else the installed package, else /opt/tokenizers."""
    if path or os.environ.get("TOKENIZERS"):
        return path or os.environ["TOKENIZERS"]
    try:
        return os.path.dirname(importlib.import_module("public_tokenizers").__file__)
    except ImportError:
        return "/opt/tokenizers"


def ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    assert [r for r, _ in pairs] == list(range(len(pairs))), "ids have gaps"
    return [token for _, token in pairs]


def pattern(directory: str) -> str:
    """The splitting pattern given beside the vocabularies."""
    spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(directory, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def ascii_pattern(split: str) -> str | None:
    """A pattern of the standard library that splits ASCII texts as split does; None if split has other classes than letters and numbers."""
    out, inside, i = [], False, 0
    while i < len(split):
        two, five = split[i : i + 2], split[i : i + 5]
        if five in (r"\p{L}", r"\p{N}"):
            letters = "a-zA-Z" if five == r"\p{L}" else "0-9"
            out.append(letters if inside else f"[{letters}]")
            i += 5
        elif two in (r"\p", r"\P"):
            return None
        elif split[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = split[i] == "[" or inside and split[i] != "]"
            out.append(split[i])
            i += 1
    return "".join(out)


class Encoder:
    """Exact byte-pair encoding of a rank vocabulary."""

    def __init__(self, tokens: list[bytes], split: str) -> None:
        self.split = regex.compile(split)
        plain = ascii_pattern(split)
        self.split_ascii = re.compile(plain, re.ASCII) if plain else None
        self.number = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._longest_proper_prefix(t) for t in tokens]
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            self.halves.append(self._halves(i, t))
            if self.halves[i] != (i, i):
                self.merged[self.halves[i]] = i
        flat = b"".join(tokens)
        self.bytes = np.frombuffer(flat, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(self.length)))
        self.known: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str | None = None, name: str = VOCABULARY) -> Encoder:
        directory = folder(path)
        return cls(ranks(os.path.join(directory, f"{name}.tiktoken")), pattern(directory))

    def _longest_proper_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (found := self.number.get(token[:end])) is not None:
                return found
        return -1

    def _halves(self, i: int, token: bytes) -> tuple[int, int]:
        """The two tokens of lower rank that merge into token i; (i, i) for a single byte."""
        left = self.shorter[i]
        while left >= 0:
            right = self.number.get(token[self.length[left] :])
            if right is not None and left < i and right < i and self.compatible(left, right):
                return left, right
            left = self.shorter[left]
        return i, i

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes together leaves these two tokens side by side."""
        limit = 1 << 60
        while True:
            both = self.merged.get((left, right))
            if both is not None and both < limit:
                return False
            if left > right:  # left was merged last: undo it, its right half met right before
                limit = left
                left = self.halves[left][1]
                if left == limit:
                    limit = right + 1
                    right = self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = self.halves[right][0]
                if right + 1 == limit:
                    limit = left
                    left = self.halves[left][1]
                    if left == limit:
                        return True

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.number.get(raw)) is not None and self._alone(whole):
            return [whole]
        n, length, shorter = len(raw), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            start = end - length[token] + 1
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        open_ends = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if open_ends[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def _alone(self, token: int) -> bool:
        """Whether token's own bytes merge into it (true but for bytes no merge makes)."""
        return self.length[token] == 1 or self.halves[token] != (token, token)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for null and empty texts."""
        if not text:
            return []
        pieces = (self.split_ascii if self.split_ascii and text.isascii() else self.split).findall(text)
        known = self.known
        try:
            return list(chain.from_iterable([known[p] for p in pieces]))
        except KeyError:
            return list(chain.from_iterable([known.get(p) or self._learn(p) for p in pieces]))

    def _learn(self, piece: str) -> list[int]:
        ids = self.piece(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their bytes lie between two entries of the offset table."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        size = self.offsets[ids + 1] - self.offsets[ids]
        at = np.repeat(self.offsets[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.bytes[at].tobytes().decode("utf-8", "replace")


_encoders: dict[tuple[str | None, str], Encoder] = {}


def encoder(path: str | None = None, name: str = VOCABULARY) -> Encoder:
    """The encoder of this process, built on first use."""
    if (path, name) not in _encoders:
        _encoders[path, name] = Encoder.load(path, name)
    return _encoders[path, name]


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """df with its column text replaced by ids (array of int): empty for null and empty texts, whole texts of any length.

    Rows are kept one for one, repeated ones too; an empty table stays empty; the other columns pass through.
    """
    schema = T.StructType([f for f in df.schema if f.name not in (text, ids)] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, name)
        for b in batches:
            rows = [e.encode(t) for t in b.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(rows), np.int32, ends[-1])
            keep = [n for n in b.schema.names if n not in (text, ids)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*keep, ids])

    return df.mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", n: str = "n_tokens", path: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """df with its column text replaced by its number of tokens (0 for null and empty texts)."""
    schema = T.StructType([f for f in df.schema if f.name not in (text, n)] + [T.StructField(n, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, name)
        for b in batches:
            keep = [x for x in b.schema.names if x not in (text, n)]
            sizes = pa.array([len(e.encode(t)) for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), sizes], [*keep, n])

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """df with its column ids replaced by the text they stand for; null and empty lists give an empty text."""
    schema = T.StructType([f for f in df.schema if f.name not in (text, ids)] + [T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, name)
        for b in batches:
            keep = [x for x in b.schema.names if x not in (text, ids)]
            texts = pa.array([e.decode(i or []) for i in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), texts], [*keep, text])

    return df.mapInArrow(run, schema)


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def p5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of every document after encoding and decoding; null texts come back empty."""
    return decode_ids(p5_ids(spark, sf_dir))
