import random
from urllib.parse import quote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as X


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


ODD = ["", None, " ", "a", " a\n b ", "s\r\nb1\rb2\n", "\n\n x  y\x1cz", "\x1f\x85 t　", "é\x0bf\x0cg", "one\n\n\ntwo\n", "x" * 100_000]


def test_subject_and_body_like_python(spark):
    def want(m):
        lines = (m or "").strip().splitlines()
        return (lines[0].strip() if lines else "", "\n".join(lines[1:]).strip())

    assert column(spark, ODD, X.subject_of(F.col("v")), X.body_of(F.col("v"))) == [want(m) for m in ODD]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\r\x1c\x85 é", max_size=12), min_size=1, max_size=60))
def test_lines_and_strip_like_python(spark, values):
    got = column(spark, values, X.strip(F.col("v")), F.concat_ws("|", X.lines(F.col("v"))))
    assert got == [(v.strip(), "|".join(v.splitlines())) for v in values]


@pytest.mark.parametrize("limit", [0, 1, 9, 120, 200, 1000])
def test_truncation(spark, limit):
    values = [None, "", "a" * limit, "a" * (limit + 1), "A" * 500 + "B" * 500, "ü😀" * 300]
    text, cut = X.truncated(F.col("v"), limit)
    for v, (t, c) in zip(values, column(spark, values, text, cut), strict=True):
        v = v or ""
        if limit == 0 or len(v) <= limit:
            assert (t, c) == (v, False)
            continue
        mark = f"\n\n... [diff cut: {len(v)} characters originally; both ends kept, limit 0 keeps all] ...\n\n"
        room = limit - len(mark)
        head = room * 2 // 3
        assert c and len(t) == limit
        assert t == (mark[:limit] if room <= 0 else v[:head] + mark + v[len(v) - (room - head) :])


def test_permalink_like_percent_quoting(spark):
    rng = random.Random(3)
    values = ["", "<>", "<a+b@c.d>", "a b*~%/?é😀"] + ["<" + "".join(rng.choice("aZ09 +*~@._-%/&=é<") for _ in range(12)) + "x>" for _ in range(100)]
    want = [f"{X.ARCHIVE_URL}{quote(b, safe='@._+-')}" if (b := v.strip("<>")) else "" for v in values]
    assert [r[0] for r in column(spark, values, X.permalink(F.col("v")))] == want


def test_hashes(spark):
    values = [None, "", "abc", "abcd", "ABCDEF0123", "g" * 8, "a" * 64, "a" * 65, "abcd\n", " abcd"]
    assert [r[0] for r in column(spark, values, X.is_hash(F.col("v")))] == [False, False, False, True, True, False, True, False, False, False]


def test_ids_and_references(spark):
    body = "CVE-2024-1234 cve-2024-1234 XCVE-2024-99999 CVE-2024-123\nFixed in\t6.1 with\ncommit ABCDEF1 introduced in 6.0 with commit 1234567\nFIXED IN 6.2 WITH COMMIT abcdef1,"
    body += f"\nhttps://git.kernel.org/stable/c/abcdef1234 http://git.kernel.org/x?id=1111111&id=2222222 https://git.kernel.org/linus/{'a' * 65}"
    short, by_id = X.linked_hashes(F.col("v"))
    ids, fixed, s, b = column(spark, [body], X.cve_ids(F.lit("CVE-2023-0001:"), F.col("v")), X.fixed_lines(F.col("v")), short, by_id)[0]
    assert ids == ["CVE-2023-0001", "CVE-2024-1234"]
    assert [tuple(x) for x in fixed] == [("6.1", "ABCDEF1"), ("6.2", "abcdef1")]
    assert (s, b) == (["abcdef1234"], ["2222222"])


def test_reports(spark):
    made = X.render_report(F.lit("h"), F.lit("s: t"), F.lit(None), F.lit("d"), F.col("v"), F.lit(""), F.lit("now"))
    failed = X.render_report(F.lit("h"), F.lit("s: t"), F.lit("a"), F.lit("d"), F.col("v"), F.lit("broken"), F.lit("now"))
    text, bad, title = column(spark, ["x"], made, failed, X.subject_in_report(made))[0]
    assert title == "s: t" and "- **Author**: \n" in text and "broken" in bad
    reports = [text, bad, text + X.FAILURE_MARK, "", None, f"{X.ANALYSIS_HEADING}\n\nold\n\n---", f"{X.ANALYSIS_HEADING}\n \n\n---\nend", f"{X.ANALYSIS_HEADING}\ncall failed"]
    assert [r[0] for r in column(spark, reports, X.is_finished(F.col("v")))] == [True, False, False, False, False, True, False, False]
