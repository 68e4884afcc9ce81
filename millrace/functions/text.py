"""Text functions of commits, mails and reports as native column expressions.

Missing text is the empty string at every boundary, so all functions treat null like ``''``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's idea of white space and of line ends, and the patterns of identifiers and references.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

CVE_ID = r"(?i)\bCVE-\d{4}-\d{4,}\b"
FIXED_LINE = rf"(?i)\bFixed{SPACE}+in{SPACE}+([^\p{{IsWhite_Space}}\x1c-\x1f,;]+){SPACE}+with{SPACE}+commit{SPACE}+([0-9a-f]{{7,64}})\b"
COMMIT_HOST = "git.kernel.org"  # where commit links point; a parameter of the functions below
ARCHIVE_URL = "https://lore.kernel.org/r/"  # in front of a message id; a parameter of permalink


def given(text: Column) -> Column:
    """``text``, or the empty string for null."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(given(text), F.lit(BLANKS))


def lines(text: Column) -> Column:
    """The lines of ``text``, without their ends; a last empty one is left out."""
    parts = F.split(given(text), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def subject_of(message: Column) -> Column:
    """The first line of a stripped commit message."""
    return strip(given(F.try_element_at(F.split(strip(message), LINE_END, 2), F.lit(1))))


def body_of(message: Column) -> Column:
    """All but the first line of a stripped commit message, with plain line feeds, stripped."""
    rest = given(F.try_element_at(F.split(strip(message), LINE_END, 2), F.lit(2)))
    return strip(F.regexp_replace(rest, LINE_END, "\n"))


def is_hash(text: Column) -> Column:
    """4 to 64 hexadecimal digits and nothing else."""
    return given(text).rlike(r"^[0-9a-fA-F]{4,64}\z")


def truncation_marker(length: Column) -> Column:
    """What stands for the cut part of a difference; it names the original length."""
    return F.concat(
        F.lit("\n\n... [diff cut: "), length.cast("string"), F.lit(" characters originally; both ends kept, limit 0 keeps all] ...\n\n")
    )


def truncated(text: Column, limit: int) -> tuple[Column, Column]:
    """(text within ``limit`` characters, whether it was cut): two thirds of the room for the head, the rest for the tail."""
    if limit < 0:
        raise ValueError("limit must be 0 or more")
    text = given(text)
    if limit == 0:
        return text, F.lit(False)
    size = F.length(text)
    marker = truncation_marker(size)
    room = F.lit(limit) - F.length(marker)
    head = F.floor(room * 2 / 3).cast("int")
    kept = F.concat(F.left(text, head), marker, F.right(text, room - head))
    cut = F.when(room <= 0, F.left(marker, F.lit(limit))).otherwise(kept)
    return F.when(size > limit, cut).otherwise(text), size > limit


def cve_ids(subject: Column, body: Column) -> Column:
    """Distinct identifiers in upper case, in the order in which they first stand."""
    found = F.regexp_extract_all(F.concat(given(subject), F.lit("\n"), given(body)), F.lit(CVE_ID), 0)
    return F.array_distinct(F.transform(found, F.upper))


def fixed_lines(body: Column) -> Column:
    """(version, hash) of every "Fixed in ... with commit ..." of the body, in order."""
    body = given(body)
    return F.arrays_zip(
        F.regexp_extract_all(body, F.lit(FIXED_LINE), 1).alias("version"), F.regexp_extract_all(body, F.lit(FIXED_LINE), 2).alias("hash")
    )


def linked_hashes(body: Column, host: str = COMMIT_HOST) -> tuple[Column, Column]:
    """Hashes in short links (/stable/c/H, /linus/H) and in links with an ``id`` parameter (its last one counts)."""
    quoted = host.replace(".", r"\.")
    short = rf"(?i)https?://{quoted}/(?:stable/c/|linus/)([0-9a-f]{{7,64}})\b"
    by_id = rf"(?i)https?://{quoted}/[^\p{{IsWhite_Space}}\x1c-\x1f]*[?&]id=([0-9a-f]{{7,64}})\b"
    return F.regexp_extract_all(given(body), F.lit(short), 1), F.regexp_extract_all(given(body), F.lit(by_id), 1)


def permalink(message_id: Column, base: str = ARCHIVE_URL) -> Column:
    """Link to a message: its identifier without angle brackets, percent-encoded except for letters, digits and @._+-~."""
    bare = F.regexp_replace(given(message_id), r"^[<>]+|[<>]+\z", "")
    code = F.url_encode(bare)
    for wrong, right in (("+", "%20"), ("%2B", "+"), ("%7E", "~"), ("%40", "@"), ("*", "%2A")):
        code = F.replace(code, F.lit(wrong), F.lit(right))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(base), code))


# --- reports ----------------------------------------------------------------------------------

SUCCESS_MARK, FAILURE_MARK = "<!-- millrace-status: success -->", "<!-- millrace-status: failure -->"
ANALYSIS_HEADING, END_RULE = "## Analysis", "\n\n---"
TITLE_BULLET, FAILED_SUBJECT, REUSED_NOTE = "- **Title**:", "(failed)", "(kept from an earlier report)"
OLD_FAILURES = ("call failed", "processing error")


def report_name(hash_: Column) -> Column:
    return F.concat(given(hash_), F.lit(".md"))


# a report's text; the names in braces are filled in
REPORT = f"{{mark}}\n# {{hash}}\n\n- **Author**: {{author}}\n- **Date**: {{date}}\n{TITLE_BULLET} {{subject}}\n\n{ANALYSIS_HEADING}\n\n{{text}}{END_RULE}\n*Made: {{made_at}}*\n"
FAILED_TEXT = "Processing failed: "


def render_report(hash_: Column, subject: Column, author: Column, date: Column, analysis: Column, error: Column, made_at: Column) -> Column:
    """The Markdown report of one result; an error makes it a failure."""
    failed = given(error) != ""
    values = {
        "mark": F.when(failed, F.lit(FAILURE_MARK)).otherwise(F.lit(SUCCESS_MARK)),
        "text": F.when(failed, F.concat(F.lit(FAILED_TEXT), error)).otherwise(given(analysis)),
        "hash": given(hash_), "author": given(author), "date": given(date), "subject": given(subject), "made_at": given(made_at),
    }
    return F.concat(*[values[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", REPORT) if x])


def report_text(result: dict, made_at: str) -> str:
    """``render_report`` of one row outside of a plan."""
    own = {k: result.get(k) or "" for k in ("hash", "author", "date", "subject")}
    failed = result.get("error")
    return REPORT.format(mark=FAILURE_MARK if failed else SUCCESS_MARK, text=FAILED_TEXT + failed if failed else result.get("analysis") or "", made_at=made_at, **own)


def saved_answer(report: str, made_at: str) -> str | None:
    """The answer in a successful report of the run ``made_at``, or null."""
    end = f"{END_RULE}\n*Made: {made_at}*\n"
    start = report.find(f"\n{ANALYSIS_HEADING}\n\n")
    if not made_at or start < 0 or not report.startswith(SUCCESS_MARK) or not report.endswith(end):
        return None
    return report[start + len(ANALYSIS_HEADING) + 3 : -len(end)]


def render_index_line(hash_: Column, subject: Column, error: Column) -> Column:
    return F.concat(
        F.lit("- ["), given(hash_), F.lit("](./"), report_name(hash_), F.lit(") - "), given(subject),
        F.when(given(error) != "", F.lit(" (failed, to be tried again)")).otherwise(F.lit("")),
    )


def is_finished(report: Column) -> Column:
    """Whether a report says that its analysis succeeded.

    The failure mark wins over everything, then the success mark; reports without marks count if no
    failure phrase and some text under the analysis heading stands in them. No report: false.
    """
    after = F.try_element_at(F.split(report, ANALYSIS_HEADING, 2), F.lit(2))
    written = strip(F.try_element_at(F.split(after, END_RULE, 2), F.lit(1)))
    old = F.coalesce(after.isNotNull() & (written != ""), F.lit(False))
    for phrase in OLD_FAILURES:
        old = old & ~F.contains(report, F.lit(phrase))
    verdict = F.when(F.contains(report, F.lit(FAILURE_MARK)), False).when(F.contains(report, F.lit(SUCCESS_MARK)), True).otherwise(old)
    return F.coalesce(verdict, F.lit(False))


def subject_in_report(report: Column) -> Column:
    """The title that a report's first title bullet holds, or the empty string."""
    return strip(F.regexp_extract(given(report), rf"(?md)^\Q{TITLE_BULLET}\E([^\n\r]*)", 1))


# HTTP statuses (besides all of 500 to 599) and signs in messages after which a call may be tried again.
RETRY_STATUSES = (408, 409, 429)
RETRY_SIGNS = ("429", "rate limit", "timeout", "connection", "http 5")


def is_retryable(status: Column, message: Column) -> Column:
    """Whether a failed call may be tried again: by its status if there is one, else by its message."""
    by_status = status.isin(*RETRY_STATUSES) | status.between(500, 599)
    by_text = F.lower(given(message)).rlike("|".join(RETRY_SIGNS))
    return F.when(status.isNotNull(), by_status).otherwise(by_text)
