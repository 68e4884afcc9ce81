import pytest
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.operators import references as R
from millrace.plans import pipeline
from millrace.sources.mail import parse_mail, parse_mails

MAIL = "epoch int, seq long, storage_commit string, raw_message binary"
KNOWN = ["1" * 40, "2" * 40, "3" * 39 + "a", "3" * 39 + "b", "abcdef1" + "0" * 33]


def mail(subject, body, message_id=None, kind="text/plain; charset=utf-8"):
    head = f"Subject: {subject}\nContent-Type: {kind}\n" + (f"Message-ID: {message_id}\n" if message_id else "")
    return (head + "\n" + body).encode()


def fixed(version, commit):
    return f"Issue introduced in 5.0 with commit 0000000 and fixed in {version} with commit {commit}\n"


MAILS = [
    (0, 1, "s1", mail("CVE-2024-0001", fixed("6.1", "1" * 12) + fixed("6.2", "9" * 12), "<A@x>")),
    (0, 2, "s2", mail("no id here", fixed("6.1", "1" * 12), "<b@x>")),
    (0, 3, "s3", mail("CVE-2024-0003", "nothing", "<c@x>")),
    (0, 4, "s4", mail("CVE-2024-0004", fixed("6.3", "9" * 12), "<d@x>")),
    (0, 5, "s5", mail("CVE-2024-0005", fixed("6.4", "1" * 40) + "https://git.kernel.org/stable/c/" + "2" * 40, "<e@x>")),
    (1, 0, "s6", mail("CVE-2024-0006", fixed("6.5", "3" * 20), "<a@X>")),
    (1, 1, "s7", mail("CVE-2024-0007", fixed("6.6", "2" * 12))),
    (1, 2, "s8", mail("CVE-2024-0007", fixed("6.6", "2" * 12))),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(MAILS, MAIL), spark.createDataFrame([(k,) for k in KNOWN], "hash string")


def statuses(found):
    return {r.storage_commit: (r.status, r.reason) for r in found.mails.collect()}


def emitted(found):
    return [r.output_hash for r in found.candidates.orderBy("epoch", "seq", "fix_idx").collect()]


def test_mainline_policy_and_emit_once(tables):
    found = pipeline.extract(*tables)
    assert statuses(found) == {
        "s1": (S.SELECTED, S.IN_REPOSITORY), "s2": (S.IGNORED, S.NO_CVE_ID), "s3": (S.NO_FIXES, S.NO_FIX_REFERENCE), "s4": (S.UNRESOLVED, S.NOT_IN_REPOSITORY),
        "s5": (S.SELECTED, S.IN_REPOSITORY), "s7": (S.SELECTED, S.IN_REPOSITORY), "s8": (S.SELECTED, S.IN_REPOSITORY),
    }
    assert emitted(found) == ["1" * 40, "2" * 40]
    audit = {r.storage_commit: r for r in found.mails.collect()}
    assert [(f.reported_hash, f.selected, f.emitted, f.in_linux_repo) for f in audit["s1"].fixes] == [("1" * 12, True, True, True), ("9" * 12, False, False, False)]
    assert [(f.reported_hash, f.emitted) for f in audit["s5"].fixes] == [("1" * 40, False), ("2" * 40, True)]
    assert audit["s2"].fixes[0].canonical_hash == "1" * 40 and not audit["s2"].fixes[0].selected
    assert audit["s3"].fixes == [] and audit["s1"].permalink.endswith("/A@x") and audit["s7"].permalink == ""
    listed = [tuple(r) for r in pipeline.numbered(found.candidates).orderBy("input_index").collect()]
    assert listed == [(0, "1" * 40), (1, "2" * 40)]


def test_fallback_and_all(tables):
    found = pipeline.extract(*tables, fall_back=True)
    assert statuses(found)["s4"] == (S.SELECTED, S.FELL_BACK) and statuses(found)["s1"] == (S.SELECTED, S.IN_REPOSITORY)
    assert emitted(found) == ["1" * 40, "9" * 12, "2" * 40]
    found = pipeline.extract(tables[0], None, prefer_known=False)
    assert statuses(found)["s1"] == (S.SELECTED, S.ALL_FIXES)
    assert emitted(found) == ["1" * 12, "9" * 12, "1" * 40, "2" * 40, "2" * 12]
    with pytest.raises(ValueError):
        pipeline.extract(tables[0], None)


def test_empty_tables(spark, tables):
    found = pipeline.extract(tables[0].limit(0), tables[1])
    assert found.mails.count() == found.candidates.count() == 0
    assert set(statuses(pipeline.extract(tables[0], tables[1].limit(0))).values()) == {(S.IGNORED, S.NO_CVE_ID), (S.NO_FIXES, S.NO_FIX_REFERENCE), (S.UNRESOLVED, S.NOT_IN_REPOSITORY)}


def test_resolution(spark, tables):
    refs = spark.createDataFrame([(r,) for r in ("1111", "ABCDEF1", "3333", "3" * 39, KNOWN[2], "2" * 41, "nothex", None, "222")], "ref string")
    got = {r.ref: r.canonical_hash for r in R.resolve(refs, "ref", tables[1]).collect()}
    assert got == {"1111": KNOWN[0], "abcdef1": KNOWN[4], KNOWN[2]: KNOWN[2]}


def test_merging_both_ways(spark):
    body = fixed("6.1", "ABCDEF1") + fixed("6.2", "abcdef1") + fixed("6.1", "abcdef1") + fixed("7.0", "1234567") + "https://git.kernel.org/x?id=1234567 https://git.kernel.org/linus/7777777"
    df = spark.createDataFrame([(1, body), (2, ""), (3, None)], "k int, body string")
    rows = R.merged(R.extracted(df, "k"), "k").orderBy("fix_idx").collect()
    in_row = df.where("k = 1").select(R.merged_in_row(F.col("body")).alias("m")).first().m
    want = [("abcdef1", ["6.1", "6.2"], ["fixed-line"]), ("1234567", ["7.0"], ["fixed-line", "commit-url"]), ("7777777", [], ["commit-url"])]
    assert [(r.reported_hash, r.versions, r.sources) for r in rows] == want == [(r.reported_hash, r.versions, r.sources) for r in in_row]


def test_mail_parsing(spark):
    plain = mail("=?utf-8?B?w6k=?=", "b\n", "<i@x>")
    assert parse_mail(plain) == ("<i@x>", "é", "", "b\n") == parse_mail(b"From x y\n" + plain)
    many = b'Content-Type: multipart/mixed; boundary="c"\n\n--c\nContent-Type: text/plain\n\none\n--c\nContent-Type: text/html\n\n<p>\n--c\nContent-Type: text/plain\nContent-Disposition: attachment\n\nno\n--c\nContent-Type: text/plain\n\ntwo\n--c--\n'
    assert parse_mail(many)[3] == "one\ntwo"
    assert parse_mail(mail("s", "<p>x", kind="text/html"))[3].strip() == "<p>x"
    assert parse_mail(b"Content-Type: text/plain; charset=nonsense\n\n\xc3\xa9\xff")[3] == "é�"
    assert parse_mail(None) == parse_mail(b"") == ("", "", "", "") and parse_mail(b"From only")[3] == ""
    df = spark.createDataFrame([(1, "old", plain), (2, None, None), (1, "old", plain)], "k int, subject string, raw_message binary")
    assert sorted(tuple(r) for r in parse_mails(df).select("k", "subject").collect()) == [(1, "é"), (1, "é"), (2, "")]
    assert parse_mails(df.limit(0)).count() == 0
