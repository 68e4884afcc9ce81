"""Resuming: what earlier reports settled, what is left to do, and the results in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.hashlist import first_of_each


def finished(reports: DataFrame) -> DataFrame:
    """(hash, subject) of the reports (hash, content) that succeeded."""
    return reports.where(X.is_finished(F.col("content"))).select(F.lower("hash").alias("hash"), X.subject_in_report(F.col("content")).alias("subject"))


def split_work(wanted: DataFrame, reports: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending, reused results, failed results) of ``wanted`` (input_index, requested_hash, canonical_hash).

    Rows without canonical hash fail at once, under the requested one. Rows whose canonical hash has a
    successful report are reused unless ``force``; the rest is pending.
    """
    unknown = X.given(F.col("canonical_hash")) == ""
    failed = wanted.where(unknown).select(
        "input_index", "requested_hash", F.col("requested_hash").alias("hash"), F.lit(X.FAILED_SUBJECT).alias("subject"),
        F.lit("").alias("author"), F.lit("").alias("date"), F.lit("").alias("analysis"), F.lit("no such commit").alias("error"),
    )
    known = wanted.where(~unknown)
    done = finished(reports).dropDuplicates(["hash"]) if not force else finished(reports).limit(0)
    done = done.withColumnRenamed("hash", "__h")
    same = F.lower("canonical_hash") == F.col("__h")
    reused = known.join(done, same).select(
        "input_index", "requested_hash", F.col("canonical_hash").alias("hash"), "subject",
        F.lit("").alias("author"), F.lit("").alias("date"), F.lit(X.REUSED_NOTE).alias("analysis"), F.lit("").alias("error"),
    )
    return known.join(done, same, "left_anti"), reused, failed


def once_per_commit(pending: DataFrame) -> DataFrame:
    """The first request of each commit: several spellings of one are analysed once."""
    return first_of_each(pending, F.lower("canonical_hash"), [F.col("input_index")])


def in_input_order(wanted: DataFrame, analysed: DataFrame, reused: DataFrame, failed: DataFrame) -> DataFrame:
    """Every row of ``wanted`` with its result, including each spelling of one commit."""
    own = wanted.select("input_index", F.col("requested_hash").alias("asked"), F.lower("canonical_hash").alias("__c"))
    results = analysed.drop("requested_hash", "input_index").withColumn("__h", F.lower("hash"))
    settled = reused.unionByName(failed)
    fresh = own.join(settled.select("input_index"), "input_index", "left_anti").join(results, F.col("__c") == F.col("__h"))
    return fresh.select("input_index", F.col("asked").alias("requested_hash"), "hash", "subject", "author", "date", "analysis", "error").unionByName(settled)


def with_evidence(commits: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """``commits`` with ``evidence``: of the side files (name, content) ``<hash>.md``, else ``<hash>.txt``, else ''."""
    if evidence is None:
        return commits.withColumn("evidence", F.lit(""))
    named = evidence.select(F.regexp_extract("name", r"^([0-9a-f]+)\.(md|txt)\z", 1).alias("__h"), F.regexp_extract("name", r"\.(md|txt)\z", 1).alias("__kind"), "content")
    best = named.where("__h <> ''").groupBy("__h").agg(F.min_by("content", "__kind").alias("evidence"))
    return commits.join(best, F.col("hash") == F.col("__h"), "left").drop("__h").withColumn("evidence", X.given(F.col("evidence")))


def work_counts(pending: DataFrame, reused: DataFrame, failed: DataFrame) -> DataFrame:
    """(selected, pending, reused, failed) of a split: all requests, and how many of them went where."""
    own = lambda part, name: part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    parts = own(pending, "pending").unionAll(own(reused, "reused")).unionAll(own(failed, "failed"))
    each = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p) for p in ("pending", "reused", "failed")]
    return parts.agg(F.sum("n").alias("selected"), *each)


def result_counts(results: DataFrame) -> DataFrame:
    """(total, failures, exit_code)."""
    failures = F.count_if(X.given(F.col("error")) != "")
    return results.agg(F.count(F.lit(1)).alias("total"), failures.alias("failures"), F.when(failures > 0, 1).otherwise(0).cast("bigint").alias("exit_code"))
