"""Encoding of a corpus with a public byte-level BPE tokenizer.

Arrow batches of texts go through the tokenizers library. A byte-level vocabulary with its standard cut
never joins characters across a change from black to white, so a text's ids are the ids of its chunks (a
word with the one space before it, or a run of white space) one after the other. Each worker has the
library encode a chunk once and gathers ids by offsets; how a chunk is cut further is the library's own
affair. Whether that holds is read from the tokenizer's file; any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = os.environ.get("MILLRACE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")

# Fixed value: the characters that Unicode calls white space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@lru_cache(maxsize=4)
def cuts_at_blanks(path: str) -> bool:
    """Whether the tokenizer's file says that it cuts texts at white space in the byte-level way."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made.get("pre_tokenizer") or {}
    standard = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    apart = all(t["special"] and not any(t.get(x) for x in ("lstrip", "rstrip", "single_word")) for t in made.get("added_tokens") or ())
    return bool(standard and apart and not made.get("normalizer") and not made.get("truncation") and not made.get("padding"))


class _Places(dict):
    """chunk -> place; a chunk not seen before gets the next place and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.new.append(chunk)
        return place


class Encoder:
    """Encodes texts; remembers chunks, their ids in one flat array, and forgets all when they grow too many."""

    LIMIT = 400_000

    def __init__(self, path: str):
        self.path, self.chunks = path, cuts_at_blanks(path)
        self.clear()

    def clear(self) -> None:
        self.places = _Places()
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self) -> None:
        new, self.places.new = self.places.new, []
        rows = [e.ids for e in _library(self.path).encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        total, n = int(sizes.sum()), len(self.places)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + total] = np.fromiter((i for r in rows for i in r), np.int32, total)
        self.start[n - len(new) : n + 1] = self.used + np.concatenate([[0], np.cumsum(sizes)])
        self.used += total

    def ragged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the texts' offsets into them); null is like empty."""
        if not self.chunks:
            rows = [e.ids for e in _library(self.path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            return np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1])), ends
        if len(self.places) > self.LIMIT:
            self.clear()
        cut = [_CHUNK.findall(t) if t else () for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter((self.places[c] for row in cut for c in row), np.int64, int(counts.sum()))
        if self.places.new:
            self._learn()
        starts = self.start[at]
        sizes = self.start[at + 1] - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[_ragged(starts, sizes)], ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    return _ENCODERS.setdefault(path, Encoder(path)) if path not in _ENCODERS else _ENCODERS[path]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def slices(batch: pa.RecordBatch, text: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of its column ``text``, so that long texts do not add up in memory."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def _over_texts(df: DataFrame, key: str, text: str, field: T.StructField, path: str, column: Callable[[np.ndarray, np.ndarray, list], pa.Array]) -> DataFrame:
    """(``key``, ``field``): ``column`` makes an Arrow column of a batch's ids, offsets and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), column(*encoder(path).ragged(texts), texts)], names=[key, field.name])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), field])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def encode_texts(df: DataFrame, key: str, text: str, path: str = TOKENIZER, out: str = "ids") -> DataFrame:
    """(``key``, ``out``): the ids of each text, without special tokens.

    One row per row of ``df``. Null and empty texts give an empty list; texts of any length are
    encoded whole; repeated rows give repeated rows; other columns are not read.
    """
    field = T.StructField(out, T.ArrayType(T.IntegerType(), False), False)
    return _over_texts(df, key, text, field, path, lambda ids, ends, _: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32())))


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """(``key``, ``out``): the number of tokens of each text; null and empty texts have none."""
    return _over_texts(df, key, text, T.StructField(out, T.LongType(), False), path, lambda ids, ends, _: pa.array(np.diff(ends), pa.int64()))


@lru_cache(maxsize=1)
def byte_of_character() -> dict[str, int]:
    """The table by which byte-level vocabularies write each byte as a printable character."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def _bytes_of_ids(path: str) -> list[bytes]:
    table = byte_of_character()
    vocab = _library(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def decode(ids: list[int], path: str = TOKENIZER) -> str:
    """The text of a list of ids: bytes are joined first, so characters split over tokens come back whole."""
    table = _bytes_of_ids(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def decode_ids(df: DataFrame, key: str, ids: str, path: str = TOKENIZER, out: str = "text") -> DataFrame:
    """(``key``, ``out``): the texts that ``encode_texts`` encoded; null lists give null."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, out])

    return df.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, schema)


def token_offsets(df: DataFrame, key: str, text: str, path: str = TOKENIZER, out: str = "spans") -> DataFrame:
    """(``key``, ``out``): first character (from 0) and length in characters of each token of each text.

    A character split over several tokens belongs to the one with its first byte; the others have length 0.
    Null and empty texts give an empty list.
    """

    def column(ids: np.ndarray, ends: np.ndarray, texts: list) -> pa.Array:
        table = _bytes_of_ids(path)
        first = np.array([sum((b & 0xC0) != 0x80 for b in token) for token in table], np.int32)  # characters that begin in each token
        lengths = first[ids].astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(lengths)])
        starts = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(lengths, pa.int32())], names=["start", "length"])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans)

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType())])
    return _over_texts(df, key, text, T.StructField(out, T.ArrayType(span), False), path, column)
