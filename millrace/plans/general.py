"""Queries of the general problems: timestamps and repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.deliveries import repeated_mails
from millrace.operators.timestamps import normalise_timestamps
from millrace.session import table, work_path


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    dates = (
        table(spark, folder, "cve_mails")
        .select(F.lit("cve_mails").alias("src"), F.col("mail_id").alias("row_id"), "date", "origin")
        .unionAll(table(spark, folder, "commits").select(F.lit("commits").alias("src"), F.col("commit_id").alias("row_id"), "date", "origin"))
    )
    found = normalise_timestamps(dates, "date", "origin", table(spark, folder, "origins"), table(spark, folder, "zone_abbrevs"))
    return found.where("utc_micros is not null").select("src", "row_id", "utc_micros")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_mails(table(spark, folder, "cve_mails"), work_path(spark, "ledger"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found}

# --- SQL of p1_found: each notation on its own, zones through the engine's own calendar --------

_B = r"[\s\x{A0}\x{3000}]"
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_WEEKDAY = rf"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?{_B}+)?"
_ZONE_NAME = "[a-z][a-z0-9_]*(?:[/+-][a-z0-9_]+)*"
_CLOCK = rf"(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?:{_B}*([ap])\.?m\b\.?)?"
_ZONE = rf"(?:{_B}*(?:(z)\b|(?:gmt|utc?)?([+-]\d{{2}}(?::?\d{{2}})?)|({_ZONE_NAME})))?(?:{_B}*[\[(]{_B}*({_ZONE_NAME})?[^\])]*[\])])?"
_AFTER = rf"(?:{_B}*t{_B}*|,?{_B}+)"
_FIELDS = ("y", "m", "d", "na", "nb", "sa", "sb", "w", "h", "mi", "s", "f", "ap", "z", "zo", "zn", "br")
_TIME = ("h", "mi", "s", "f", "ap", "z", "zo", "zn", "br")
_DATES = (
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", ("y", "m", "d")),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", ("y", "m", "d")),
    (rf"(\d{{4}}){_B}*年{_B}*(\d{{1,2}}){_B}*月{_B}*(\d{{1,2}}){_B}*日", ("y", "m", "d")),
    (r"(\d{4})(\d{2})(\d{2})", ("y", "m", "d")),
    (r"(\d{1,2})([/.-])(\d{1,2})([/.-])(\d{4}|\d{2})", ("na", "sa", "nb", "sb", "y")),
    (rf"(\d{{1,2}})(?:{_B}+|-){_MONTH}\.?,?(?:{_B}+|-)(\d{{4}}|\d{{2}})", ("d", "w", "y")),
    (rf"{_MONTH}\.?{_B}+(\d{{1,2}}),?{_B}+(\d{{4}})", ("w", "d", "y")),
)


def _notations() -> str:
    """One SELECT for each notation: its fields, empty where it has none."""
    found = []
    for date, names in _DATES:
        found += [
            (f"{_WEEKDAY}{date}", names),
            (f"{_WEEKDAY}{date}{_AFTER}{_CLOCK}{_ZONE}", names + _TIME),
            (rf"{_WEEKDAY}{date}{_AFTER}(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}", names + ("h", "mi", "s", "f", "z", "zo", "zn", "br")),
        ]
    found.append((rf"{_WEEKDAY}{_MONTH}{_B}+(\d{{1,2}}){_B}+{_CLOCK}{_B}+(\d{{4}}){_ZONE}", ("w", "d", "h", "mi", "s", "f", "ap", "y", "z", "zo", "zn", "br")))
    found.append((rf"{_WEEKDAY}{_MONTH}{_B}+(\d{{1,2}}){_B}+{_CLOCK}{_B}+([a-z]{{2,5}}){_B}+(\d{{4}})", ("w", "d", "h", "mi", "s", "f", "ap", "zn", "y")))
    parts = []
    for n, (pattern, names) in enumerate(found):
        own = ", ".join(f"'{x}'" for x in names)
        fields = ", ".join(f"g.{x}" if x in names else f"'' AS {x}" for x in _FIELDS)
        parts.append(f"SELECT src, row_id, origin, {n} AS notation, {fields} FROM (SELECT *, regexp_extract(t, '^{pattern}$', [{own}]) AS g FROM texts WHERE regexp_matches(t, '^{pattern}$'))")
    return " UNION ALL ".join(parts)


_MONTHS = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], left(w, 3))"
_SHIFT = "(epoch_us(timezone(zone, make_timestamptz({0}))) - ({0}))"  # offset in force at an instant
_SQL_P1 = f"""
    WITH texts AS (
        SELECT src, row_id, origin, lower(regexp_replace(date, '^{_B}+|{_B}+$', '', 'g')) AS t FROM (
            SELECT 'cve_mails' AS src, mail_id AS row_id, date, origin FROM cve_mails UNION ALL SELECT 'commits', commit_id, date, origin FROM commits)
    ), counts AS (
        SELECT src, row_id, regexp_extract(t, '^(\\d{{9,17}})', 1) AS n FROM texts WHERE regexp_matches(t, '^\\d{{9,17}}(?:{_B}+[+-]\\d{{4}})?$')
    ), read AS (
        SELECT * FROM ({_notations()}) WHERE sa = sb QUALIFY row_number() OVER (PARTITION BY src, row_id ORDER BY notation) = 1
    ), named AS (
        SELECT r.*, o.zone_name AS home, o.day_first, upper(coalesce(nullif(zn, ''), nullif(br, ''))) AS ab FROM read r LEFT JOIN origins o ON o.origin = r.origin
    ), numbers AS (
        SELECT n.* EXCLUDE (y, m, d, h, mi, s), offset_minutes, p.name AS named_zone, CAST(y AS INT) + CASE WHEN length(y) = 2 THEN 2000 ELSE 0 END AS y,
               CASE WHEN na <> '' THEN CAST(CASE WHEN day_first THEN nb ELSE na END AS INT) WHEN w <> '' THEN {_MONTHS} ELSE CAST(m AS INT) END AS m,
               CASE WHEN na <> '' THEN CAST(CASE WHEN day_first THEN na ELSE nb END AS INT) ELSE CAST(d AS INT) END AS d,
               coalesce(TRY_CAST(h AS INT), 0) AS h, coalesce(TRY_CAST(mi AS INT), 0) AS mi, coalesce(TRY_CAST(s AS INT), 0) AS s
        FROM named n LEFT JOIN zone_abbrevs a ON upper(a.abbrev) = ab LEFT JOIN (SELECT upper(name) AS u, min(name) AS name FROM pg_timezone_names() GROUP BY 1) p ON p.u = ab
        WHERE na = '' OR day_first IS NOT NULL
    ), valid AS (
        SELECT *, CASE WHEN ap = '' THEN h ELSE h % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END END AS hour FROM numbers
        WHERE m BETWEEN 1 AND 12 AND d >= 1 AND y >= 1 AND d <= day(last_day(make_date(greatest(y, 1), CAST(least(greatest(m, 1), 12) AS INT), 1)))
          AND mi <= 59 AND s <= 59 AND CASE WHEN ap = '' THEN h <= 23 ELSE h BETWEEN 1 AND 12 END
    ), placed AS (
        SELECT src, row_id, epoch_us(CAST(make_date(y, CAST(m AS INT), d) AS TIMESTAMP)) + CAST((hour * 60 + mi) * 60 + s AS BIGINT) * 1000000 + CAST(rpad(left(f, 6), 6, '0') AS BIGINT) AS local,
               zo <> '' OR z <> '' OR ab IS NOT NULL AS written,
               CASE WHEN zo <> '' THEN CASE WHEN abs(hh) <= 18 AND mm <= 59 THEN (abs(hh) * 60 + mm) * CASE left(zo, 1) WHEN '-' THEN -1 ELSE 1 END END WHEN z <> '' THEN 0 ELSE offset_minutes END AS minutes,
               CASE WHEN zo <> '' OR z <> '' OR offset_minutes IS NOT NULL THEN NULL WHEN ab IS NOT NULL THEN named_zone ELSE home END AS zone
        FROM (SELECT *, TRY_CAST(substr(zo, 2, 2) AS INT) AS hh, coalesce(TRY_CAST(substr(replace(zo, ':', ''), 4, 2) AS INT), 0) AS mm FROM valid)
    ), shifted AS (
        SELECT *, {_SHIFT.format('local - 86400000000')} AS before, {_SHIFT.format('local + 86400000000')} AS after FROM placed WHERE zone IS NOT NULL
    )
    SELECT src, row_id, CAST(n AS BIGINT) * CASE WHEN length(n) <= 11 THEN 1000000 WHEN length(n) <= 14 THEN 1000 ELSE 1 END AS utc_micros FROM counts
    UNION ALL SELECT src, row_id, local - CAST(minutes AS BIGINT) * 60000000 FROM placed WHERE zone IS NULL AND written AND minutes IS NOT NULL
    UNION ALL
    -- the earlier of two instants; a skipped time is read with the offset before the change
    SELECT src, row_id, CASE WHEN {_SHIFT.format('local - before')} = before THEN local - before WHEN {_SHIFT.format('local - after')} = after THEN local - after ELSE local - before END FROM shifted
"""

SQL = {
    "p1_found": _SQL_P1,
    "p3_found": r"""
        WITH keyed AS (
            SELECT mail_id, epoch, seq, storage_commit,
                   lower(regexp_replace(message_id, '^[\s\x{A0}<]+|[\s\x{A0}>]+$', '', 'g')) AS bare
            FROM cve_mails
        ), named AS (
            SELECT mail_id, epoch, seq,
                   CASE WHEN coalesce(bare, '') <> '' THEN 'id:' || bare
                        WHEN epoch IS NOT NULL AND storage_commit IS NOT NULL
                            THEN 'git:' || CAST(epoch AS VARCHAR) || ':' || storage_commit
                        ELSE 'row:' || CAST(mail_id AS VARCHAR) END AS key
            FROM keyed
        )
        SELECT mail_id FROM (
            SELECT mail_id, row_number() OVER (PARTITION BY key ORDER BY epoch, seq, mail_id) AS place FROM named
        ) WHERE place > 1
    """,
}
