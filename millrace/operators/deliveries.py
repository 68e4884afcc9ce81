"""Messages delivered more than once: exactly one arrival of each stays.

Identifiers are dictionary-encoded exactly: each gets a shard (a hash of the identifier) and a dense
ordinal within the shard. What has been seen is one bit an ordinal, in bitmaps of 64 bits sharded by
(shard, word) and compressed in Parquet. A batch first extends the dictionary, then keeps, of each
identifier whose bit is unset, the arrival that stands first, and unites its bits with the old ones. Both
steps become visible by making one numbered state file, which only one writer can: whoever comes second
looks again at what the first has changed.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD = 64  # bits of one bitmap
SEGMENTS = 8  # parts of the dictionary that are read together; more are merged into one
KEYS_OF_SHARD = 250_000  # identifiers of a shard in the first batch
KEEP_STATES = 8  # states whose files a slower reader may still need


def message_key(message_id: Column, epoch: Column, storage_commit: Column) -> Column:
    """The identity of a delivered mail, or null if it has none.

    The identifier counts regardless of case, surrounding blanks and surrounding angle brackets;
    where nothing is left of it, epoch and storage commit stand for it.
    """
    bare = F.lower(F.regexp_replace(message_id, r"^[\s\x{A0}<]+|[\s\x{A0}>]+\z", ""))
    stored = F.concat_ws(":", F.lit("git"), epoch.cast("string"), storage_commit)
    return F.when(F.coalesce(bare, F.lit("")) != "", F.concat(F.lit("id:"), bare)).when(
        epoch.isNotNull() & storage_commit.isNotNull(), stored
    )


def sharded_ordinals(keys: DataFrame, key: str, shards: int, base: DataFrame | None = None) -> DataFrame:
    """``keys`` (distinct in ``key``) with ``shard`` and a dense 0-based ``ordinal`` within it.

    ``base`` (shard, used) gives the ordinals that are taken already. Only a shard's keys are
    sorted together; the number of shards is the parallelism, so give more shards to more keys.
    """
    df = keys.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(key)).cast("bigint") - 1
    df = df.withColumn("ordinal", rank)
    if base is None:
        return df
    return (
        df.join(base.withColumnRenamed("shard", "__s"), F.col("shard") == F.col("__s"), "left")
        .withColumn("ordinal", F.col("ordinal") + F.coalesce("used", F.lit(0)))
        .drop("__s", "used")
    )


class _Taken(Exception):
    """Another writer has made the next state."""


class DeliveryLedger:
    """What has been delivered so far, in a folder that all executors share.

    ``states/<n>`` is JSON: the dictionary's segments (key, shard, ordinal), how many ordinals each shard has used,
    the bitmaps (shard, word, seen), and the batch that made it. The highest number counts.
    A batch that fails leaves at most identifiers whose bits are unset, so it can simply run again.

    An identifier seen for the first time costs one dictionary row; a batch reads the dictionary once, as
    at most ``SEGMENTS`` sorted parts, and the bitmaps, which are about a thousandth of it.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self._at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- states

    def _load(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _save(self, path: str, text: str, new: bool = False) -> None:
        """Writes a small file that appears at once; a ``new`` one may not be there yet."""
        draft = self._at(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":
            source, target = draft.toUri().getPath(), self._at(path).toUri().getPath()
            try:
                (os.link if new else os.replace)(source, target)
            except FileExistsError as e:
                raise _Taken from e
            finally:
                if os.path.exists(source):
                    self._fs.delete(draft, False)
            return
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(rename, 1)
        flags[0] = rename.NONE if new else rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._at(path), flags)
        except Exception as e:  # the file system says that the target exists
            if new and self._fs.exists(self._at(path)):
                self._fs.delete(draft, False)
                raise _Taken from e
            raise

    def _state(self) -> dict:
        folder = self._at(f"{self.path}/states")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return {"n": 0, "shards": self.shards, "dictionary": [], "used": {}, "bits": None, "batch": None, "kept": None, "old": []}
        return json.loads(self._load(f"{self.path}/states/{max(numbers):012d}"))

    def _commit(self, state: dict, **changes) -> dict:
        """The next state, made by this writer alone; raises ``_Taken`` if another one was faster."""
        new = state | {"batch": None, "kept": None} | changes
        new["n"] = state["n"] + 1
        gone = [p for p in [*state["dictionary"], state["bits"]] if p and p not in [*new["dictionary"], new["bits"]]]
        new["old"] = [*state["old"], *([new["n"], p] for p in gone)]
        expired = [p for n, p in new["old"] if n <= new["n"] - KEEP_STATES]
        new["old"] = [x for x in new["old"] if x[1] not in expired]
        self._fs.mkdirs(self._at(f"{self.path}/states"))
        self._save(f"{self.path}/states/{new['n']:012d}", json.dumps(new), new=True)
        for p in [*expired, f"{self.path}/states/{new['n'] - KEEP_STATES:012d}"]:
            self._fs.delete(self._at(p), True)
        return new

    def _mark(self, batch: str) -> str:
        return f"{self.path}/batches/{hashlib.sha1(batch.encode()).hexdigest()}"

    def _done(self, state: dict, batch: str) -> str | None:
        """Where the rows are that a batch kept when it was applied before. Costs the same however many there were."""
        if state["batch"] == batch:
            return state["kept"]
        mark = self._mark(batch)
        return self._load(mark) if self._fs.exists(self._at(mark)) else None

    # --- tables

    # a batch's codes are a segment of the dictionary, too: those of them that are new
    _DICTIONARY = "key string, shard int, ordinal bigint, new boolean"
    _BITS = "shard int, word bigint, seen bigint"

    def _written(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/tables/{name}-{uuid.uuid4().hex[:16]}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, paths: list[str] | str | None, schema: str | T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))

    def _known(self, segments: list[str]) -> DataFrame:
        return self._read(segments, self._DICTIONARY).where("new").drop("new")

    def dictionary(self) -> DataFrame:
        return self._known(self._state()["dictionary"])

    def bits(self) -> DataFrame:
        return self._read(self._state()["bits"], self._BITS)

    # --- batches

    def _encode(self, firsts: DataFrame) -> tuple[dict, str]:
        """(state, path of (key, rid, shard, ordinal, new) of all keys of a batch), the dictionary extended by the new ones."""
        while True:
            state = self._state()
            if not state["shards"]:
                state["shards"] = max(8, -(-firsts.count() // KEYS_OF_SHARD))
            if state["dictionary"]:
                looked = firsts.join(self._known(state["dictionary"]), "key", "left")
                used = self.spark.createDataFrame([(int(k), n) for k, n in state["used"].items()], "shard int, used bigint")
                fresh = sharded_ordinals(looked.where("ordinal is null").select("key", "rid"), "key", state["shards"], used)
                coded = looked.where("ordinal is not null").withColumn("new", F.lit(False)).unionByName(fresh.withColumn("new", F.lit(True)))
            else:
                coded = sharded_ordinals(firsts, "key", state["shards"]).withColumn("new", F.lit(True))
            path = self._written(coded.select("key", "rid", "shard", "ordinal", "new"), "codes")
            more = self._known([path]).groupBy("shard").agg((F.max("ordinal") + 1).alias("used")).collect()  # a row a shard
            if not more:
                return state, path
            segments = [*state["dictionary"], path]
            if len(segments) > SEGMENTS:
                whole = self._known(segments).withColumn("new", F.lit(True))
                segments = [self._written(whole.repartition("shard").sortWithinPartitions("shard", "key"), "dictionary")]
            try:
                return self._commit(state, dictionary=segments, used=state["used"] | {str(r["shard"]): r["used"] for r in more}), path
            except _Taken:
                for p in {path, segments[-1]}:
                    self._fs.delete(self._at(p), True)

    def apply(self, batch: DataFrame, key: Column, order: list[Column], row_id: str, batch_id: str | None = None) -> DataFrame:
        """The ``row_id`` values of ``batch`` that stay; rows whose ``key`` is null all stay.

        Of several arrivals of one key in the batch the first by ``order`` (then ``row_id``) stays, and
        none if the key was kept from an earlier batch. A ``batch_id`` applied before gives the same
        rows again and changes nothing. Columns of ``batch`` may have any names; nulls in ``order``
        sort first; an empty batch keeps nothing. Several writers may apply batches at once.
        """
        kind = batch.schema[row_id].dataType
        ids = T.StructType([T.StructField(row_id, kind)])
        name = batch_id if batch_id is not None else uuid.uuid4().hex
        state = self._state()
        if state["batch"] is not None and not self._fs.exists(self._at(self._mark(state["batch"]))):
            self._save(self._mark(state["batch"]), state["kept"])  # its writer got no further
        if (kept := self._done(state, name)) is not None:
            return self._read(kept, ids)

        arrivals = batch.select(F.col(f"`{row_id}`").alias("rid"), key.alias("key"), F.struct(*order, F.col(f"`{row_id}`")).alias("ord"))
        # partial aggregation runs before the shuffle, so a hot identifier costs one row a task
        firsts = arrivals.where("key is not null").groupBy("key").agg(F.min_by("rid", "ord").alias("rid"))
        state, coded = self._encode(firsts)
        coded_schema = f"key string, rid {kind.simpleString()}, shard int, ordinal bigint"
        while True:
            codes = self._read(coded, coded_schema).withColumn("word", F.expr(f"ordinal div {WORD}")).withColumn("bit", F.expr(f"cast(ordinal % {WORD} as int)"))
            bits = self._read(state["bits"], self._BITS)
            unseen = codes.join(bits, ["shard", "word"], "left").where("seen is null or (shiftright(seen, bit) & 1) = 0")
            stay = unseen.select(F.col("rid").alias(row_id)).unionByName(arrivals.where("key is null").select(F.col("rid").alias(row_id)))
            kept = self._written(stay, "kept")
            fresh = codes.groupBy("shard", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("seen"))
            united = bits.unionByName(fresh).groupBy("shard", "word").agg(F.bit_or("seen").alias("seen"))
            bitmaps = self._written(united.sortWithinPartitions("shard", "word"), "bits")
            try:
                self._commit(state, bits=bitmaps, batch=name, kept=kept)
                break
            except _Taken:
                for p in (kept, bitmaps):
                    self._fs.delete(self._at(p), True)
                state = self._state()  # the codes are still right: a dictionary is only added to
                if (other := self._done(state, name)) is not None:  # the same batch, applied by another writer
                    return self._read(other, ids)
        self._save(self._mark(name), kept)
        if coded not in [*state["dictionary"], *(p for _, p in state["old"])]:
            self._fs.delete(self._at(coded), True)
        return self._read(kept, ids)


MAIL_ORDER = ("epoch", "seq")


def kept_mails(mails: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    """The ``mail_id`` of each mail's row with the lowest (epoch, seq), through a ledger at ``path``.

    Each epoch is a batch, in their order, so that the arrival that a bit lets through is also the lowest.
    (A ledger that is fed in another order keeps the first that arrived.) An archive has a handful of
    epochs, each a repository of its own; their numbers are all that the driver learns.
    """
    ledger = DeliveryLedger(mails.sparkSession, path, shards)
    key = message_key(F.col("message_id"), F.col("epoch"), F.col("storage_commit"))
    numbers = sorted((r["epoch"] for r in mails.select("epoch").distinct().collect()), key=lambda e: (e is not None, e))
    kept = mails.select("mail_id").limit(0)
    for e in numbers:
        own = mails.where(F.col("epoch").isNull() if e is None else F.col("epoch") == e)
        kept = kept.unionAll(ledger.apply(own, key, [F.col(c) for c in MAIL_ORDER], "mail_id", f"epoch {e}"))
    return kept


def repeated_mails(mails: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    """The ``mail_id`` of every row to drop."""
    return mails.select("mail_id").join(kept_mails(mails, path, shards), "mail_id", "left_anti")
