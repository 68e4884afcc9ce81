import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.operators import rules

COMMIT = "input_index long, requested_hash string, hash string, subject string, body string, files array<string>, diff string, diff_truncated boolean, original_diff_chars int, error string"


def commits(spark, *rows):
    full = [(i, f"r{i}", f"h{i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, COMMIT)


def decided(spark, row, *args, **more):
    base = dict(subject="", body="", files=[], diff="", cut=False, chars=0, error="") | row
    df = commits(spark, (base["subject"], base["body"], base["files"], base["diff"], base["cut"], base["chars"], base["error"]))
    return rules.decide(df, rules.compile_rules(*args, **more)).first()


def test_any_records_fields_in_fixed_order(spark):
    r = decided(spark, {"subject": "RISC-V fix", "files": ["arch/riscv/mm.c"]}, ["risc-?v", "powerpc"], [], ["files", "subject"])
    assert (r.status, r.reason) == (S.SELECTED, S.INCLUDE_HIT)
    assert [(m.pattern, m.fields) for m in r.include_matches] == [("risc-?v", ["subject", "files"])]


def test_all_exclude_and_none(spark):
    row = {"subject": "riscv", "body": "This reverts x"}
    assert decided(spark, row, ["riscv", "powerpc"], [], ["subject"], match="all").reason == S.NOT_ALL_INCLUDES
    assert decided(spark, row, ["riscv"], ["revert"], ["subject", "body"]).status == S.EXCLUDED
    assert decided(spark, row, [], [], ["subject"]).reason == S.NO_INCLUDE
    assert decided(spark, row, ["x86"], [], ["subject"]).reason == S.NO_INCLUDE_HIT
    assert decided(spark, row, ["riscv", "riscv"], [], ["subject"], match="all").status == S.SELECTED


def test_anchors_hold_for_each_path(spark):
    row = {"files": ["doc/a", None, "", "arch/b.c"]}
    assert decided(spark, row, ["^arch/"], [], ["files"]).status == S.SELECTED
    assert decided(spark, row, ["^b"], [], ["files"]).status == S.NOT_MATCHED
    assert decided(spark, {"files": None}, [".*"], [], ["files"]).status == S.NOT_MATCHED


def test_unread_rows_and_nulls(spark):
    r = decided(spark, {"subject": None, "error": "gone"}, ["a"], [], ["subject"])
    assert (r.status, r.hash, r.subject, r.error) == (S.ERROR, "r0", "", "gone")
    r = decided(spark, {"subject": None, "body": None, "diff": None, "cut": None, "chars": None}, ["^$"], [], ["diff"])
    assert (r.status, r.diff_truncated, r.original_diff_chars) == (S.SELECTED, False, 0)
    df = commits(spark, ("a", "", [], "", False, 0, ""), ("b", "", [], "", False, 0, "x"))
    assert tuple(rules.summary(rules.decide(df, rules.compile_rules(["a"], [], ["subject"]))).first()) == (2, 1, 1, 1)


def test_repeated_groups_on_long_texts(spark):
    df = spark.createDataFrame([(1, "ab" * 200_000 + "c")], "i int, subject string")
    for text in ("(a|b)*c", "(?:ab){2,}c", "[ab]+c"):
        p = rules.compile_rules([text], [], ["subject"]).include[0]
        assert df.select(rules.hits(p, "subject").alias("h")).first().h is True and (p.native is None) == (")" in text)


def test_wrong_rules():
    for bad in (lambda: rules.compile_rules(["["], [], ["subject"]), lambda: rules.compile_rules([], [], []), lambda: rules.compile_rules([], [], ["title"]), lambda: rules.compile_rules([], [], ["body"], "some")):
        with pytest.raises(rules.RuleError):
            bad()


PATTERNS = [
    r"\bcafé\b", r"\w+²", r"[\w-]+x", r"a&&b", r"[a&&b]+z", r"[[a]", r"a{,2}b", r"(?P<n>ab)(?P=n)", r"(a)?(?(1)b|c)", r"x\Z", r"^é", r".é$", r"\s\d", r"[^\s]b", r"a{2}", r"ÄB", r"\Sb\B", r"[]a]c", r"a.b",
    r"(?:ab)+", r"(?i:q)", r"\x41", r"[\b]", r"a\.b", r"ß", r"\d+", r"(?<=a)b", r"(?!a)b", r"a|b|", r"\(a\)",
]
TEXTS = ["café", "cafés", "x²", "a-x", "a&&b", "&z", "bz", "[", "aab", "abab", "ab", "c", "x\n", "é", "b\né", "a\ré", "\x1c1", "äb", "aa", "ABAB", "]c", "a b", "a\nb", "q", "Q", "A", "\x08", "a.b", "STRASSE", "ß", "٣", "(a)", "", "é b"]


@pytest.mark.parametrize("case", [False, True])
def test_native_patterns_agree_with_python(spark, case):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, subject string")
    compiled = rules.compile_rules(PATTERNS, [], ["subject"], case_sensitive=case).include
    got = df.select("i", *[rules.hits(p, "subject").alias(f"p{n}") for n, p in enumerate(compiled)]).orderBy("i").collect()
    for n, p in enumerate(PATTERNS):
        want = [re.search(p, t, 0 if case else re.I) is not None for t in TEXTS]
        assert [r[f"p{n}"] for r in got] == want, (p, compiled[n].native)
    native = [p.text for p in compiled if p.native is not None]
    assert len(native) >= len(PATTERNS) - 4


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab[]^-&\\wsdbSW.$|()?+*{}2,é ", max_size=8), st.lists(st.text(alphabet="ab[]-& .é2\n_w", max_size=6), min_size=1, max_size=20))
def test_random_patterns_agree_with_python(spark, pattern, texts):
    try:
        search = re.compile(pattern, re.I).search
    except re.error:
        return
    p = rules.compile_rules([pattern], [], ["subject"]).include[0]
    if p.native is None:
        return
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, subject string")
    got = [r.h for r in df.select("i", rules.hits(p, "subject").alias("h")).orderBy("i").collect()]
    assert got == [search(t) is not None for t in texts], (pattern, p.native)


def test_unread_fields_are_not_in_the_plan(spark):
    wanted = rules.compile_rules(["a"], [], ["subject"])
    assert not rules.needs_diff(wanted)
    plan = rules.decide(commits(spark, ("a", "", [], "", False, 0, "")), wanted).select("status")._jdf.queryExecution().optimizedPlan().toString()
    assert "diff#" not in plan.split("LogicalRDD")[0].split("LocalRelation")[0]
    assert F is not None
