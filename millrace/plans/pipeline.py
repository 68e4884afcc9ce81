"""The three stages end to end, as DataFrame plans over any source of mails and commits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import references as R
from millrace.operators.hashlist import dense_index, first_of_each
from millrace.session import written
from millrace.sources.mail import parse_mails


@dataclass
class Extracted:
    """What extraction gives: an audit row per mail and the candidate hashes in order of emission."""

    mails: DataFrame
    candidates: DataFrame


def first_mails(parsed: DataFrame) -> DataFrame:
    """One row per message id, regardless of case, the first in (epoch, seq); mails without one stand for themselves."""
    own = F.when(X.given(F.col("message_id")) != "", F.lower("message_id")).otherwise(F.concat_ws(":", F.lit("git"), F.col("epoch").cast("string"), F.col("storage_commit")))
    return first_of_each(parsed, own, [F.col("epoch"), F.col("seq")])


def extract(
    messages: DataFrame, commits: DataFrame | None, prefer_known: bool = True, fall_back: bool = False, host: str = X.COMMIT_HOST,
    resolver: Callable[[DataFrame], DataFrame] | None = None,
) -> Extracted:
    """Raw ``messages`` to candidates. With ``prefer_known`` either ``commits`` (hash), which are all that is known, or a
    ``resolver``, from fixes (reported_hash) to (reported_hash, canonical_hash), says which references are in the repository.
    """
    if prefer_known and commits is None and resolver is None:
        raise ValueError("prefer_known needs commits or a resolver")
    parsed = first_mails(parse_mails(messages))
    mails = parsed.withColumn("cve_ids", X.cve_ids(F.col("subject"), F.col("body"))).withColumn("mail", F.struct("epoch", "seq"))
    # several branches follow, so what parsing and extraction gave is written once; bodies aren't needed any more
    mails = written(mails.withColumn("refs", R.merged_in_row(F.col("body"), host)).drop("body"), "parsed-mails")
    fixes = mails.select("mail", F.posexplode("refs").alias("fix_idx", "f")).select("mail", "fix_idx", "f.*")
    mails = mails.drop("refs")
    resolver = resolver or (lambda f: R.resolve(f, "reported_hash", commits))
    resolved = resolver(fixes) if prefer_known else None
    decided, marked = R.select_fixes(mails, R.attach(fixes, resolved), "mail", ["epoch", "seq"], prefer_known, fall_back)
    audit = R.audit(decided.withColumn("permalink", X.permalink(F.col("message_id"))), marked, "mail")
    emitted = marked.where("emitted").select(F.col("mail.epoch").alias("epoch"), F.col("mail.seq").alias("seq"), "fix_idx", "output_hash")
    columns = ["epoch", "seq", "storage_commit", "message_id", "permalink", "subject", "date", "cve_ids", "status", "reason", "fixes"]
    return Extracted(audit.select(*columns), emitted)


def numbered(candidates: DataFrame) -> DataFrame:
    """(input_index, requested_hash) of extracted candidates, in order of emission."""
    ranked = dense_index(candidates, ["epoch", "seq", "fix_idx"], "input_index")
    return ranked.select("input_index", F.col("output_hash").alias("requested_hash"))
