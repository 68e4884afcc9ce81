"""Regular-expression rules over commits, with a record of what matched where.

The language of the patterns is that of Python's ``re``: each is compiled with it first. A pattern is
then rewritten into Java's notation where the two can be made to agree, and runs natively; the few
that cannot are searched by ``re`` itself in an Arrow UDF, with the same results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas as S
from millrace.functions.text import given

_WORD, _SPACE = r"\p{L}\p{N}_", r"\p{IsWhite_Space}\x1c-\x1f"
_EDGE = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NO_EDGE = rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
_OUTSIDE = {"w": f"[{_WORD}]", "W": f"[^{_WORD}]", "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "d": r"\p{Nd}", "D": r"\P{Nd}", "b": _EDGE, "B": _NO_EDGE, "Z": r"\z", "A": r"\A"}
_INSIDE = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}", "b": r"\x08"}
_SAME_ESCAPES = "nrtfav"


class RuleError(ValueError):
    """A rule that cannot be used."""


def java_pattern(pattern: str) -> str | None:
    """``pattern`` in Java's notation with the same matches as in Python, or null if that isn't certain.

    Nor if it repeats a group without bound: Java matches each round by a call in a call, which ends on long texts.
    """
    out: list[str] = []
    i, n, in_class = 0, len(pattern), False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                return None
            e = pattern[i + 1]
            table = _INSIDE if in_class else _OUTSIDE
            if e in table:
                out.append(table[e])
            elif e in _SAME_ESCAPES:
                out.append({"v": r"\x0b", "a": r"\x07"}.get(e, "\\" + e))
            elif e == "x" and re.fullmatch(r"[0-9a-fA-F]{2}", pattern[i + 2 : i + 4]):
                out.append(pattern[i : i + 4])
                i += 2
            elif e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", pattern[i + 2 : i + 6]):
                out.append(pattern[i : i + 6])
                i += 4
            elif e.isdigit() and not in_class and e != "0" and not pattern[i + 2 : i + 3].isdigit():
                out.append("\\" + e)
            elif not e.isalnum():
                out.append("\\" + e)
            else:
                return None
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c in "[&":
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            if m := re.match(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", pattern[i:]):
                out.append(f"(?<{m[1]}>")
            elif m := re.match(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)", pattern[i:]):
                out.append(rf"\k<{m[1]}>")
            elif m := re.match(r"\(\?(?:[:=!>]|<[=!]|[ims]+\)|[ims]+:)", pattern[i:]):
                out.append(m[0])
            else:
                return None
            i += len(m[0])
            continue
        elif c == "{" and not re.match(r"\{\d+(?:,\d*)?\}", pattern[i:]):
            return None
        elif out and out[-1] == ")" and re.match(r"[*+]|\{\d+(?:,|,?\d{3,})\}", pattern[i:]):
            return None
        else:
            out.append(c)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Pattern:
    """One rule; ``native`` is null where Python's ``re`` has to search."""

    text: str
    case_sensitive: bool
    native: str | None


@dataclass(frozen=True)
class Rules:
    include: tuple[Pattern, ...]
    exclude: tuple[Pattern, ...]
    fields: tuple[str, ...]
    match_all: bool


def compile_rules(include: Iterable[str], exclude: Iterable[str], fields: Iterable[str], match: str = "any", case_sensitive: bool = False) -> Rules:
    """Checked rules; ``fields`` are taken in the fixed order of ``schemas.FIELDS``, whatever theirs."""
    wanted = list(dict.fromkeys(fields))
    unknown = sorted(set(wanted) - set(S.FIELDS))
    if not wanted or unknown:
        raise RuleError(f"fields must be some of {', '.join(S.FIELDS)}; wrong: {', '.join(unknown) or 'none given'}")
    if match not in ("any", "all"):
        raise RuleError("match must be any or all")

    def compiled(side: str, patterns: Iterable[str]) -> tuple[Pattern, ...]:
        out = []
        for text in patterns:
            try:
                re.compile(text, 0 if case_sensitive else re.IGNORECASE)
            except re.error as e:
                raise RuleError(f"{side} pattern {text!r}: {e}") from e
            java = java_pattern(text)
            flags = "d" if case_sensitive else "iud"
            out.append(Pattern(text, case_sensitive, None if java is None else f"(?{flags}){java}"))
        return tuple(out)

    return Rules(compiled("include", include), compiled("exclude", exclude), tuple(f for f in S.FIELDS if f in wanted), match == "all")


def _searcher(pattern: Pattern, many: bool):
    flags = 0 if pattern.case_sensitive else re.IGNORECASE

    def one(values: pd.Series) -> pd.Series:
        search = re.compile(pattern.text, flags).search
        return values.map(lambda v: search(v) is not None).astype(bool)

    def any_of(values: pd.Series) -> pd.Series:
        search = re.compile(pattern.text, flags).search
        return values.map(lambda vs: any(search(v) is not None for v in vs)).astype(bool)

    return F.pandas_udf(any_of if many else one, T.BooleanType(), F.PandasUDFType.SCALAR)


def hits(pattern: Pattern, field: str) -> Column:
    """Whether ``pattern`` is found in a field; in ``files`` any single path may hold it."""
    if field == "files":
        paths = F.array_compact(F.coalesce(F.col("files"), F.array().cast("array<string>")))
        if pattern.native is None:
            return _searcher(pattern, True)(paths)
        return F.exists(paths, lambda p: F.rlike(p, F.lit(pattern.native)))
    text = given(F.col(field))
    return _searcher(pattern, False)(text) if pattern.native is None else F.rlike(text, F.lit(pattern.native))


def matches(patterns: Iterable[Pattern], fields: Iterable[str]) -> Column:
    """The patterns that were found, in their order, each with the fields it was found in."""
    fields = list(fields)
    each = [
        F.struct(
            F.lit(p.text).alias("pattern"),
            F.array_compact(F.array(*[F.when(hits(p, f), F.lit(f)) for f in fields])).alias("fields"),
        )
        for p in patterns
    ]
    if not each:
        return F.array().cast(S.MATCHES)
    return F.filter(F.array(*each), lambda m: F.size(m["fields"]) > 0).cast(S.MATCHES)


def decide(commits: DataFrame, rules: Rules) -> DataFrame:
    """A decision for every row of ``commits`` (input_index, the columns of a commit, and perhaps error).

    A row whose ``error`` is not empty could not be read: its status is ``error`` and its hash the one
    requested. Otherwise an exclude hit outranks everything; without include rules all the rest is
    selected. Null texts are empty; null or empty paths never match; repeated rows are decided alike.
    """
    if "error" not in commits.columns:
        commits = commits.withColumn("error", F.lit(""))
    failed = given(F.col("error")) != ""
    none = F.array().cast(S.MATCHES)
    found = commits.select(
        "input_index", "requested_hash", "hash", "subject", "diff_truncated", "original_diff_chars", "error",
        F.when(failed, none).otherwise(matches(rules.include, rules.fields)).alias("include_matches"),
        F.when(failed, none).otherwise(matches(rules.exclude, rules.fields)).alias("exclude_matches"),
    )
    if not rules.include:
        satisfied = F.lit(True)
    elif rules.match_all:
        satisfied = F.size("include_matches") == len(rules.include)
    else:
        satisfied = F.size("include_matches") > 0
    out = F.size("exclude_matches") > 0
    status = F.when(failed, S.ERROR).when(out, S.EXCLUDED).when(satisfied, S.SELECTED).otherwise(S.NOT_MATCHED)
    reason = (
        F.when(failed, S.UNREADABLE).when(out, S.EXCLUDE_HIT)
        .when(satisfied, S.INCLUDE_HIT if rules.include else S.NO_INCLUDE).otherwise(S.NOT_ALL_INCLUDES if rules.match_all else S.NO_INCLUDE_HIT)
    )
    return found.select(
        "input_index",
        given(F.col("requested_hash")).alias("requested_hash"),
        F.when(failed, F.col("requested_hash")).otherwise(given(F.col("hash"))).alias("hash"),
        F.when(failed, F.lit("")).otherwise(given(F.col("subject"))).alias("subject"),
        status.alias("status"),
        reason.alias("reason"),
        "include_matches",
        "exclude_matches",
        F.coalesce("diff_truncated", F.lit(False)).alias("diff_truncated"),
        F.coalesce("original_diff_chars", F.lit(0)).alias("original_diff_chars"),
        given(F.col("error")).alias("error"),
    )


def needs_diff(rules: Rules) -> bool:
    """Whether any rule reads the difference; a source need not fetch it otherwise."""
    return "diff" in rules.fields


def summary(decisions: DataFrame) -> DataFrame:
    """(total, selected, errors, exit_code) of all decisions."""
    errors = F.count_if(F.col("status") == S.ERROR)
    return decisions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == S.SELECTED).alias("selected"),
        errors.alias("errors"),
        F.when(errors > 0, 1).otherwise(0).cast("bigint").alias("exit_code"),
    )
