"""Filling containers of fixed capacity with texts, by lexical retrieval.

Texts are sized in tokens of a public tokenizer. Each becomes one item, or, over the capacity, full
pieces of exactly the capacity (containers of their own) and an item for the rest. Items are sorted by the
terms that tell most about them (by BM25 weight under the frequencies of the whole corpus), and range
partitions of that order are cut into shards of about ``SHARD`` items: the more there is of a subject, the
more of its items share a shard. A shard has its own BM25 inverted index, whose terms are token ids. The
largest unused item opens a container, and the index returns its unused neighbours, best first. The
window takes the best neighbour among those that leave the least space unused, as far as one more item
can tell: size is a constraint, and of what meets it the score decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import TOKENIZER, _library, _ragged, encoder, slices
from millrace.session import written

CAPACITY = 2048
SHARD = 2000  # items of a shard, on average
TASKS = 4_000  # tasks at most; beyond that a task fills more shards, one after the other
K1, B = 1.2, 0.75  # BM25
COMMON = 0.1  # terms in a larger share of all items do not tell neighbours apart and weigh nothing


def _bag(ids: np.ndarray) -> bytes:
    """Sorted distinct token ids and how often each occurs, as 16-bit (larger vocabularies: 32-bit) numbers."""
    terms, counts = np.unique(ids, return_counts=True)
    width = 2 if max(terms[-1], counts.max()) < 65536 else 4
    return np.concatenate([terms, counts]).astype(f"<u{width}").tobytes() + bytes([width])


def _unbag(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(bag[:-1], f"<u{bag[-1]}").astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def items(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """(``key``, piece_no, first_token, n_tokens, bag) of each piece; texts without tokens give none.

    ``bag`` is null for pieces that fill a container alone.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece_no int, first_token bigint, n_tokens int, bag binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, ends = encoder(path).ragged(batch.column(1).to_pylist())
            rows, piece, first, n, bags = [], [], [], [], []
            for i in range(len(batch)):
                own = ids[ends[i] : ends[i + 1]]
                for p, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append(i)
                    piece.append(p)
                    first.append(at)
                    n.append(len(part))
                    bags.append(None if len(part) == capacity else _bag(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int32()), pa.array(bags, pa.binary())],
                names=[key, "piece_no", "first_token", "n_tokens", "bag"],
            )

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def document_frequencies(rows: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many items each token id occurs, over all items: one vector a task, added up by the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                total[_unbag(bag)[0]] += 1
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(total[terms], pa.int64())], names=["term", "n"])

    parts = rows.where("bag is not null").select("bag").mapInArrow(run, "term bigint, n bigint")
    found = parts.groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    out = np.zeros(vocabulary, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _weights(tf: np.ndarray, idf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))).astype(np.float32)


def _largest(have: np.ndarray, room: int) -> np.ndarray:
    """For each space up to ``room`` the largest size in stock that fits it, 0 if none."""
    return np.maximum.accumulate(np.where(have[: room + 1] > 0, np.arange(room + 1), 0))


def _unused(sizes: np.ndarray, have: np.ndarray, room: int) -> np.ndarray:
    """The space left in ``room`` behind each of ``sizes`` (all in stock, all fitting) once the best single item follows it."""
    largest = _largest(have, room)
    rest = room - sizes
    follow = largest[rest]
    alone = (follow == sizes) & (have[sizes] == 1)  # an item cannot follow itself
    return rest - np.where(alone, largest[np.maximum(sizes - 1, 0)], follow)


def fill(sizes: np.ndarray, bags: list[bytes], idf: np.ndarray, mean: float, capacity: int = CAPACITY, choices: list | None = None) -> list[list[int]]:
    """Containers of one shard: lists of item numbers, the seed first.

    ``choices`` (for reports) gets, of each pick, among how many items of different score it was made.
    """
    n = len(sizes)
    sizes = np.asarray(sizes, np.int64)
    parts = [_unbag(b) for b in bags]
    counts = np.array([len(t) for t, _ in parts], np.int64)
    term = np.concatenate([t for t, _ in parts]) if parts else np.zeros(0, np.int64)
    tf = np.concatenate([c for _, c in parts]).astype(np.float64) if parts else np.zeros(0)
    doc = np.repeat(np.arange(n), counts)
    telling = idf[term] > 0
    term, tf, doc = term[telling], tf[telling], doc[telling]
    weight = _weights(tf, idf[term], sizes[doc], mean)
    # the inverted index: postings of each term stand together
    order = np.argsort(term, kind="stable")
    posting_doc, posting_weight = doc[order].astype(np.int32), weight[order]
    terms, first, length = np.unique(term[order], return_index=True, return_counts=True)
    own = np.searchsorted(terms, term)
    begin = np.searchsorted(doc, np.arange(n + 1))
    have = np.bincount(sizes, minlength=capacity + 1)
    free = np.ones(n, bool)
    out = []
    for seed in np.lexsort((np.arange(n), -sizes)):
        if not free[seed]:
            continue
        free[seed] = False
        have[sizes[seed]] -= 1
        chosen, room = [int(seed)], capacity - int(sizes[seed])
        scores = None
        while room > 0:
            fits = np.flatnonzero(free & (sizes <= room))
            if not len(fits):
                break
            if scores is None:
                at = own[begin[seed] : begin[seed + 1]]
                where = _ragged(first[at], length[at])
                scores = np.bincount(posting_doc[where], posting_weight[where], n)
            left = _unused(sizes[fits], have, room)
            best = fits[left == left.min()]
            pick = int(best[np.argmax(scores[best])])
            if choices is not None:
                choices.append(len(np.unique(scores[best])))
            free[pick] = False
            have[sizes[pick]] -= 1
            chosen.append(pick)
            room -= int(sizes[pick])
        out.append(chosen)
    return out


def _subjects(rows: DataFrame, idf: np.ndarray, mean: float) -> DataFrame:
    """``rows`` with ``t1``, ``t2``: the two terms that weigh most in each item (-1 if there are fewer)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    bag, size = rows.columns.index("bag"), rows.columns.index("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = np.full((len(batch), 2), -1, np.int32)
            for i, (b, n) in enumerate(zip(batch.column(bag).to_pylist(), batch.column(size).to_pylist(), strict=True)):
                terms, tf = _unbag(b)
                weight = _weights(tf, idf[terms], n, mean)
                best = np.argsort(-weight, kind="stable")[:2]
                tops[i, : len(best)] = np.where(weight[best] > 0, terms[best], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops[:, 0]), pa.array(tops[:, 1])], names=[*batch.schema.names, "t1", "t2"])

    return rows.mapInArrow(run, f"{schema}, t1 int, t2 int")


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(container, place, ``key``, piece_no, first_token, n_tokens): every token of every text once.

    No container holds more than ``capacity`` tokens. Null and empty texts are left out. A text over the
    capacity is divided into pieces of exactly the capacity and a rest; others stay whole. Repeated
    rows and rows of null keys are packed each; ties go to the item that stands first in the shard's order; an
    empty table gives no container.
    """
    rows = written(items(df, key, text, capacity, path), "items")
    part = rows.where("bag is not null")
    frequencies = document_frequencies(rows, _library(path).get_vocab_size(with_added_tokens=True))
    total = part.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).first()
    n, mean = total["n"], (total["t"] or 0) / max(1, total["n"])
    idf = np.log1p((n - frequencies + 0.5) / (frequencies + 0.5)).astype(np.float32)
    idf[frequencies > COMMON * n] = 0
    tasks = min(max(1, -(-n // shard)), TASKS)
    kind = df.schema[key].dataType.simpleString()
    schema = f"container string, place int, `{key}` {kind}, piece_no int, first_token bigint, n_tokens int"
    columns = [key, "piece_no", "first_token", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def filled(group: pa.Table) -> pa.RecordBatch:
            nonlocal made
            found = fill(group.column("n_tokens").to_numpy(), group.column("bag").to_pylist(), idf, mean, capacity)
            taken = group.select(columns).take(pa.array([i for c in found for i in c], pa.int64())).combine_chunks()
            names = pa.array([f"s{task}-{made + k}" for k, c in enumerate(found) for _ in c], pa.string())
            places = pa.array([p for c in found for p in range(len(c))], pa.int32())
            made += len(found)
            own = [taken.column(c).combine_chunks() for c in columns]
            own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
            return pa.RecordBatch.from_arrays([names, places, *own], names=["container", "place", *columns])

        held, rows_held = [], 0
        for batch in batches:
            held.append(batch)
            rows_held += len(batch)
            while rows_held >= 2 * shard:
                group = pa.Table.from_batches(held)
                yield filled(group.slice(0, shard))
                held, rows_held = group.slice(shard).to_batches(), rows_held - shard
        if rows_held:
            group = pa.Table.from_batches(held)
            half = rows_held if 2 * rows_held <= 3 * shard else rows_held // 2  # two shards of like size rather than a small last one
            for at in range(0, rows_held, half):
                yield filled(group.slice(at, half if at + 2 * half <= rows_held else rows_held))
                if at + 2 * half > rows_held:
                    break

    whole = rows.where("bag is null").select(
        F.concat(F.lit("w"), F.xxhash64(F.col(f"`{key}`")).cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string")).alias("container"),
        F.lit(0).alias("place"), F.col(f"`{key}`"), "piece_no", "first_token", "n_tokens",
    )
    # the hash splits subjects that are hot, so that no range is larger than others
    sorted_ = _subjects(part, idf, mean).withColumn("mix", F.xxhash64("bag", f"`{key}`", "piece_no"))
    sorted_ = sorted_.repartitionByRange(tasks, "t1", "t2", "mix").sortWithinPartitions("t1", "t2", "mix", "n_tokens")
    return sorted_.select(*[F.col(f"`{c}`") for c in columns], "bag").mapInArrow(run, schema).unionAll(whole)
