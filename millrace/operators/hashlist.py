"""Lists of commit hashes: reading, checking, ordered distinct, dense indexes and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import LINE_END, is_hash, lines, strip
from millrace.session import uri, written


class HashListError(ValueError):
    """A hash list that cannot be used."""


def first_of_each(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row, by ``order``, of each value of ``key``; unlike dropDuplicates never another one.

    Only the ordering and the key are aggregated before the shuffle, so hot keys cost one row a task.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    firsts = df.groupBy(key.alias("__key")).agg(F.min_by(whole, F.struct(*order)).alias("__row"))
    return firsts.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])


def dense_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... in the order of ``order``, without a window over all rows.

    Rows are range-partitioned; what the driver adds up is one count a partition.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets or [(-1, 0)], "__part int, __start bigint")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(starts, "__part").withColumn(out, F.col("__start") + place).drop("__part", "__start")


def token_lines(df: DataFrame, text: str) -> DataFrame:
    """(pos from 0, token) of the lines of ``text`` that are neither blank nor comments, stripped."""
    found = df.select(F.posexplode(lines(F.regexp_replace(F.col(text), "^\\x{FEFF}", ""))).alias("pos", "line"))
    found = found.select(F.col("pos").cast("bigint").alias("pos"), strip(F.col("line")).alias("token"))
    return found.where((F.col("token") != "") & ~F.col("token").startswith("#"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of a text file, read in as many tasks as it has blocks; ``at`` sorts the lines as they stand.

    A byte order mark is dropped. Lines end where Python's ``splitlines`` ends them.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), "value")
    bare = F.when((F.col("block") == 0) & F.col("value").startswith("\ufeff"), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    # a line that ends where the file ends is one line, an empty one included
    split = read.select("block", "no", F.posexplode(F.split(bare, LINE_END, -1)).alias("part", "line"))
    return split.select(F.struct("block", "no", "part").alias("at"), "line")


def read_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(input_index, requested_hash) of a hash file, in its order.

    Hashes that differ only in case count once, with the spelling that stands first. A line that is
    no hash makes the whole file an error that names the line; so does a file without hashes.
    """
    every = file_lines(spark, uri(path)).select("at", strip(F.col("line")).alias("token"))
    tokens = every.where((F.col("token") != "") & ~F.col("token").startswith("#"))
    wrong = tokens.where(~is_hash(F.col("token"))).agg(F.min_by("token", "at").alias("token"), F.min("at").alias("at")).first()
    if wrong["at"] is not None:
        place = F.struct(*[F.lit(wrong["at"][n]).alias(n) for n in ("block", "no", "part")])
        number = every.where(F.col("at") <= place).count()
        raise HashListError(f"{path}, line {number}: not a hash: {wrong['token']!r}")
    firsts = first_of_each(tokens, F.lower("token"), [F.col("at")])
    out = dense_index(firsts.select("at", F.col("token").alias("requested_hash")), ["at"], "input_index").select("input_index", "requested_hash")
    if out.isEmpty():
        raise HashListError(f"{path} holds no hash")
    return out


def index_slice(df: DataFrame, start: int = 0, end: int = -1, index: str = "input_index") -> DataFrame:
    """Rows with ``start <= index < end``; an ``end`` of -1 means all."""
    if start < 0 or end < -1 or (end != -1 and end < start):
        raise HashListError("need 0 <= start <= end, or end -1")
    kept = df.where(F.col(index) >= start)
    return kept if end == -1 else kept.where(F.col(index) < end)
