"""Items that appear together far more often than chance.

Items get 31-bit codes through a dictionary, so that a pair is one 64-bit number. Each task packs the
pairs of its records into a bounded buffer, sorts it and writes it out as a run of (code, count); the
shuffle brings equal codes together, an external sort merges the runs, and a second pass over the
sorted stream adds up the lengths.

Two exact cuts come first. A pair that must occur ``least`` times needs items that do. And as a pair
cannot occur more often than its rarer item, ``together * N >= lift * count_a * count_b`` needs
``N >= lift * count`` of either item: items in more than a ``lift``-th of all records, however hot,
are in no pair of the result and leave before pairs are made. What stays may still be frequent: items
in more than a ten-thousandth of all rows, of which there are few, get their codes by broadcast.

Codes have 31 bits, so one call tells at most 2,147,483,648 items apart that occur ``least`` times; more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.deliveries import sharded_ordinals
from millrace.operators.skew import lookup
from millrace.session import written

LEAST, LIFT = 5, 10
_SHARDS = 1024  # shards in which items are numbered
_CODES = 1 << 31
_RUN = 1 << 21  # pairs of one sorted run (16 MB)
_FIELDS = 100  # fields whose number of records the plan holds as literals
_BLOCK = 512  # items of a record whose pairs one row makes


def item_rows(df: DataFrame, record: str, items: str, field: str) -> DataFrame:
    """Distinct (field, record, item); null and empty items and records do not count."""
    return (
        df.select(F.lit(field).alias("field"), F.col(f"`{record}`").cast("string").alias("record"), F.explode(f"`{items}`").alias("item"))
        .where("record <> '' and item <> ''")
        .distinct()
    )


def _emit(runs: list[np.ndarray]) -> pa.RecordBatch:
    codes, counts = np.unique(np.concatenate(runs), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["pair", "n"])


def _pair_runs(batches: Iterator[pa.RecordBatch], block: int, run: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of packed pairs. Input: sorted item codes of a record, and the number of the block of left items."""
    buffer: list[np.ndarray] = []
    held = 0
    for batch in batches:
        codes, blocks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))])
        sizes = np.diff(offsets)
        # records of one size are packed together
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size <= block:
                a, b = np.triu_indices(size, 1)
                step = max(1, run // max(1, len(a)))
                for i in range(0, len(rows), step):
                    m = flat[offsets[rows[i : i + step]][:, None] + np.arange(size)]
                    buffer.append(((m[:, a] << 32) | m[:, b]).ravel())
                    held += buffer[-1].size
                    if held >= run:
                        yield _emit(buffer)
                        buffer, held = [], 0
            else:
                for r in rows:
                    m = flat[offsets[r] : offsets[r + 1]]
                    lo = blocks[r] * block
                    for i in range(lo, min(lo + block, size)):
                        buffer.append((m[i] << 32) | m[i + 1 :])
                        held += buffer[-1].size
                        if held >= run:
                            yield _emit(buffer)
                            buffer, held = [], 0
    if held:
        yield _emit(buffer)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of a sorted stream of (pair, n); a pair at the end of a batch waits for the next."""
    last, count = None, 0
    for batch in batches:
        pairs = batch.column(0).to_numpy(zero_copy_only=False)
        ns = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(pairs):
            continue
        at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        keys, sums = pairs[at], np.add.reduceat(ns, at)
        if last is not None:
            if keys[0] == last:
                sums[0] += count
            else:
                keys, sums = np.concatenate([[last], keys]), np.concatenate([[count], sums])
        last, count = int(keys[-1]), int(sums[-1])
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1], pa.int64()), pa.array(sums[:-1], pa.int64())], names=["pair", "together"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([count], pa.int64())], names=["pair", "together"])


def together(rows: DataFrame, least: int = LEAST, lift: int = LIFT, block: int = _BLOCK, run: int = _RUN) -> DataFrame:
    """Pairs of ``rows`` (field, record, item; distinct) that occur together often enough.

    Columns: ``field, item_a, item_b`` (in code point order), ``together, count_a, count_b, records``
    and ``odds``, the odds ratio with 0.5 added to each cell. Kept are pairs with
    ``together >= least`` and ``together * records >= lift * count_a * count_b``. Ties need no rule: all pairs that
    pass are kept. An empty input gives an empty result. ``block`` items of a record are paired in one go
    (larger records are shared out), ``run`` pairs make a sorted run; neither changes the result.
    """
    rows = written(rows, "items")
    spark = rows.sparkSession
    sizes = rows.groupBy("field").agg(F.count_distinct("record").alias("records"))
    counts = rows.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # a field is a name that the caller gave, so there are a handful; only more than that are joined
    few = sizes.limit(_FIELDS + 1).collect()
    if len(few) > _FIELDS:
        counts = counts.join(sizes, "field")
    else:
        records = F.lit(0).cast("bigint")
        for r in few:
            records = F.when(F.col("field") == r["field"], F.lit(r["records"]).cast("bigint")).otherwise(records)
        counts = counts.withColumn("records", records)
    counts = counts.where(F.col("n") * lift <= F.col("records"))
    keyed = counts.withColumn("key", F.concat_ws("\x01", "field", "item"))
    numbered = written(sharded_ordinals(keyed, "key", _SHARDS).drop("key"), "item-numbers")
    # shards follow one another without gaps: a code is what stands in the shards before, and the ordinal
    sizes_of = sorted((r["shard"], r["n"]) for r in numbered.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect())  # at most _SHARDS rows
    total, starts = 0, []
    for number, n in sizes_of:
        starts.append((number, total))
        total += n
    if total > _CODES:
        raise OverflowError(f"{total} items are more than {_CODES} codes can tell apart")
    offsets = spark.createDataFrame(starts or [(-1, 0)], "shard int, start bigint")
    coded = numbered.join(offsets, "shard").select("field", "item", "n", "records", (F.col("start") + F.col("ordinal")).alias("code"))
    coded = written(coded, "item-codes")

    baskets = (
        lookup(rows, coded.select("field", "item", "code", "n"), ["field", "item"], "n")
        .groupBy("field", "record")
        .agg(F.sort_array(F.collect_list("code")).alias("codes"))
        .where(F.size("codes") > 1)
        .select("codes", F.explode(F.sequence(F.lit(0), F.when(F.size("codes") > block, F.expr(f"(size(codes) - 1) div {block}")).otherwise(0))).alias("block"))
    )
    runs = baskets.mapInArrow(partial(_pair_runs, block=block, run=run), "pair bigint, n bigint")
    merged = runs.repartition("pair").sortWithinPartitions("pair").mapInArrow(_merge_runs, "pair bigint, together bigint")
    pairs = merged.where(F.col("together") >= least).select(
        F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "together"
    )
    left = coded.select(F.col("code").alias("a"), "field", "records", F.col("item").alias("__x"), F.col("n").alias("__nx"))
    right = coded.select(F.col("code").alias("b"), F.col("item").alias("__y"), F.col("n").alias("__ny"))
    both = pairs.join(left, "a").join(right, "b").where(
        f"cast(together as decimal(19)) * records >= cast(__nx as decimal(19)) * __ny * {lift}"  # no overflow
    )
    first = F.col("__x") < F.col("__y")
    n11, n10, n01 = F.col("together"), F.col("__nx") - F.col("together"), F.col("__ny") - F.col("together")
    n00 = F.col("records") - F.col("__nx") - F.col("__ny") + F.col("together")
    return both.select(
        "field",
        F.when(first, F.col("__x")).otherwise(F.col("__y")).alias("item_a"),
        F.when(first, F.col("__y")).otherwise(F.col("__x")).alias("item_b"),
        "together",
        F.when(first, F.col("__nx")).otherwise(F.col("__ny")).alias("count_a"),
        F.when(first, F.col("__ny")).otherwise(F.col("__nx")).alias("count_b"),
        "records",
        ((n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))).alias("odds"),
    )
