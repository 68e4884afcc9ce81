"""Queries of the package's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import encodings, names, packing, personal, pieces, together, tokens
from millrace.operators.deliveries import kept_mails
from millrace.session import table, work_path


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    mails = table(spark, folder, "cve_mails")
    kept = mails.join(kept_mails(mails, work_path(spark, "ledger")), "mail_id", "left_semi")
    ids = kept.select("mail_id", F.transform("cve_ids", F.upper).alias("ids"))
    rows = together.item_rows(table(spark, folder, "commits"), "hash", "files", "files")
    return together.together(rows.unionByName(together.item_rows(ids, "mail_id", "ids", "cve_ids")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("field", "item_a", "item_b")


def p2_odds(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_names(table(spark, folder, "commits"), "author", table(spark, folder, "nicknames"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.oversized(table(spark, folder, "commits"), "commit_id", "diff")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    parts = pieces.split_oversized(table(spark, folder, "commits"), "commit_id", "diff")
    return parts.where("piece_no is not null").drop("line_no")


def p5_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Each oversized text put together again from its pieces, with what must hold for them.

    ``at_lines``: cuts are hard only where no line begins behind the overlap.
    """
    overlap, limit = pieces.OVERLAP, pieces.LIMIT
    own = p5_pieces(spark, folder).select("commit_id", F.struct("piece_no", "start_pos", "end_pos", "cut", "piece").alias("p"))
    parts = own.groupBy("commit_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    added = lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substr(x["piece"], F.lit(overlap + 1)))
    text = F.array_join(F.transform("p", added), "")
    fresh = F.transform("p", lambda x: F.struct(x["cut"].alias("cut"), F.substr(x["piece"], F.lit(overlap + 1), F.length(x["piece"]) - overlap - 1).alias("new")))
    repeated = F.expr(f"forall(sequence(1, size(p) - 1), i -> left(p[i].piece, {overlap}) = right(p[i - 1].piece, {overlap}) and p[i].piece_no = i)")
    return parts.select(
        "commit_id",
        F.md5(text).alias("diff_md5"),
        F.length(text).cast("bigint").alias("chars"),
        F.forall("p", lambda x: F.length(x["piece"]) <= limit).alias("within"),
        repeated.alias("overlapping"),
        F.forall(fresh, lambda x: (x["cut"] != "hard") | ~F.contains(x["new"], F.lit("\n"))).alias("at_lines"),
    )


def _misread(spark: SparkSession, folder: str) -> DataFrame:
    mails = encodings.mail_text_rows(table(spark, folder, "inbox_messages"))
    texts = mails.select(F.lit("inbox_messages").alias("src"), F.col("mail_id").alias("row_id"), F.lit("raw_message").alias("field"), "text")
    commits = table(spark, folder, "commits")
    for field in ("author", "body"):
        texts = texts.unionAll(commits.select(F.lit("commits"), "commit_id", F.lit(field), field))
    return encodings.find_misread(texts)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _misread(spark, folder).select("src", "row_id", "field")


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    return _misread(spark, folder)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_mentions(table(spark, folder, "documents"), "doc_id", "text").drop("end_pos")


def p9_replaced(spark: SparkSession, folder: str) -> DataFrame:
    secret = os.environ.get("MILLRACE_SECRET", "a key for tests").encode()
    return personal.replace_mentions(table(spark, folder, "documents"), "doc_id", "text", secret)


QUERIES = {
    "p2_found": p2_found,
    "p2_odds": p2_odds,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_rejoined": p5_rejoined,
    "p6_found": p6_found,
    "p6_restored": p6_restored,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_replaced": p9_replaced,
}

_PAIRS = r"""
    WITH keyed AS (
        SELECT mail_id, epoch, seq, storage_commit, cve_ids,
               lower(regexp_replace(message_id, '^[\s\x{A0}<]+|[\s\x{A0}>]+$', '', 'g')) AS bare
        FROM cve_mails
    ), named AS (
        SELECT *, CASE WHEN coalesce(bare, '') <> '' THEN 'id:' || bare
                       WHEN epoch IS NOT NULL AND storage_commit IS NOT NULL
                           THEN 'git:' || CAST(epoch AS VARCHAR) || ':' || storage_commit
                       ELSE 'row:' || CAST(mail_id AS VARCHAR) END AS key
        FROM keyed
    ), kept AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch, seq, mail_id) AS place FROM named)
        WHERE place = 1
    ), rows AS (
        SELECT DISTINCT field, record, item FROM (
            SELECT 'files' AS field, hash AS record, unnest(files) AS item FROM commits
            UNION ALL
            SELECT 'cve_ids', CAST(mail_id AS VARCHAR), upper(unnest(cve_ids)) FROM kept
        ) WHERE item <> '' AND record <> ''
    ), sizes AS (SELECT field, count(DISTINCT record) AS records FROM rows GROUP BY field),
    counts AS (SELECT field, item, count(*) AS n FROM rows GROUP BY field, item),
    pairs AS (
        SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS together
        FROM rows a JOIN rows b ON a.field = b.field AND a.record = b.record AND a.item < b.item
        GROUP BY 1, 2, 3 HAVING count(*) >= 5
    )
    SELECT p.field, item_a, item_b, together, x.n AS count_a, y.n AS count_b, records,
           (together + 0.5::DOUBLE) * (records - x.n - y.n + together + 0.5::DOUBLE)
               / ((x.n - together + 0.5::DOUBLE) * (y.n - together + 0.5::DOUBLE)) AS odds
    FROM pairs p JOIN sizes s ON p.field = s.field
    JOIN counts x ON x.field = p.field AND x.item = item_a JOIN counts y ON y.field = p.field AND y.item = item_b
    WHERE together * records >= 10 * x.n * y.n
"""

SQL = {
    "p2_found": f"SELECT field, item_a, item_b FROM ({_PAIRS})",
    "p2_odds": _PAIRS,
    "p5_found": r"""
        WITH big AS (SELECT commit_id, diff FROM commits WHERE length(diff) > 6000),
        cut AS (SELECT commit_id, string_split(diff, chr(10)) AS lines FROM big),
        numbered AS (SELECT commit_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM cut)
        SELECT commit_id, CAST(0 AS BIGINT) AS line_no FROM big
        UNION ALL
        SELECT commit_id, CAST(line_no AS BIGINT) FROM numbered WHERE length(line) > 6000
    """,
    # the pieces hold the whole text: each but its overlap follows the one before, and none is too long
    "p5_rejoined": r"""
        SELECT commit_id, md5(diff) AS diff_md5, CAST(length(diff) AS BIGINT) AS chars, TRUE AS within, TRUE AS overlapping, TRUE AS at_lines
        FROM commits WHERE length(diff) > 6000
    """,
}
