import pytest
from conftest import same_rows

from millrace.plans import repositories, triage, triage_sql
from millrace.streaming.ingest import keep_once


@pytest.mark.parametrize("name", sorted(triage_sql.SQL))
def test_query_and_sql(spark, data, sql, name):
    same_rows(triage.QUERIES[name](spark, data), sql, triage_sql.SQL[name])


@pytest.mark.parametrize("name", sorted(triage_sql.FILE_SQL))
def test_file_query_and_sql(spark, data, sql, name):
    assert same_rows(repositories.QUERIES[name](spark, data), sql, triage_sql.FILE_SQL[name])


def test_every_query_has_sql_or_is_known_not_to():
    assert set(triage.QUERIES) - set(triage_sql.SQL) == {"mail_parse", "pipeline_end_to_end"}
    assert set(triage_sql.SQL) <= set(triage.QUERIES) and set(triage_sql.FILE_SQL) == set(repositories.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_streamed_mails_are_kept_once(spark, data, tmp_path):
    mails = spark.read.parquet(f"{data}/cve_mails.parquet")
    for i in range(3):
        mails.where(f"batch_id % 3 = {i}").write.parquet(str(tmp_path / "in" / f"part{i}"))
    stream = spark.readStream.schema(mails.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        query = keep_once(stream, f"file://{tmp_path}/ledger", str(tmp_path / "out"), str(tmp_path / "checkpoint"), shards=4)
        query.awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out"))
    from pyspark.sql import functions as F

    from millrace.operators.deliveries import message_key

    key = message_key(F.col("message_id"), F.col("epoch"), F.col("storage_commit"))
    assert kept.count() == kept.select(key.alias("k")).distinct().count() == mails.select(key.alias("k")).distinct().count()
