"""Mails as a stream: each micro-batch goes against the delivery ledger, so that every mail is kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.deliveries import DeliveryLedger, message_key


def keep_once(mails: DataFrame, ledger: str, out: str, checkpoint: str, shards: int | None = None) -> StreamingQuery:
    """Appends the first arrival of each streamed mail to ``out`` (Parquet), available rows only, then ends.

    A repeated micro-batch is recognised by its number: the ledger gives the same rows again and the output
    folder of the batch is overwritten, so nothing is written twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        book = DeliveryLedger(batch.sparkSession, ledger, shards)
        key = message_key(F.col("message_id"), F.col("epoch"), F.col("storage_commit"))
        kept = book.apply(batch, key, [F.col("epoch"), F.col("seq")], "mail_id", batch_id=str(number))
        batch.join(kept, "mail_id", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return mails.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
