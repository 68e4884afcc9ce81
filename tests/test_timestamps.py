import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from millrace.operators.timestamps import normalise_timestamps
from millrace.session import table

ORIGINS = [("b", "Europe/Berlin", True), ("n", "America/New_York", False), ("k", "Asia/Kathmandu", True), ("s", "Australia/Sydney", True)]
ABBREVS = [("EST", -300), ("CEST", 120), ("UTC", 0), ("GMT", 0), ("NPT", 345)]


def utc(*parts, micros=0):
    return int((datetime(*parts, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) + micros


CASES = [
    ("2024-01-03T07:03:26Z", "b", utc(2024, 1, 3, 7, 3, 26)),
    ("2024-01-03T07:03:26z", None, utc(2024, 1, 3, 7, 3, 26)),
    ("2024-01-26T17:09:54 +09:30", "b", utc(2024, 1, 26, 7, 39, 54)),
    ("2024-01-26 17:09:54.1234567-0330", "b", utc(2024, 1, 26, 20, 39, 54, micros=123456)),
    ("2024-02-20T21:44:58,5+03", "b", utc(2024, 2, 20, 18, 44, 58, micros=500000)),
    ("2024-01-09 21:40:58.2", "b", utc(2024, 1, 9, 20, 40, 58, micros=200000)),
    ("2024-01-09 21:40:58", "n", utc(2024, 1, 10, 2, 40, 58)),
    ("Thu, 4 Jan 2024 09:08:23 +0100", "n", utc(2024, 1, 4, 8, 8, 23)),
    ("Thu, 04 JAN 24 09:08 -0000", "n", utc(2024, 1, 4, 9, 8)),
    ("Wed, 24 Jan 2024 13:17:21 EST", "b", utc(2024, 1, 24, 18, 17, 21)),
    ("04 Aug 2024 09:55:37 +0530 (EST)", "b", utc(2024, 8, 4, 4, 25, 37)),
    ("Sun Jan 14 16:35:52 2024", "b", utc(2024, 1, 14, 15, 35, 52)),
    ("Wed Jan  3 17:06:29 2024 -0800", "b", utc(2024, 1, 4, 1, 6, 29)),
    ("Wed Jan  3 17:06:29 NPT 2024", "b", utc(2024, 1, 3, 11, 21, 29)),
    ("1704663292", "b", 1704663292 * 10**6),
    ("1704269778 +0800", "b", 1704269778 * 10**6),
    ("1704873979842", "b", 1704873979842000),
    ("1704530056940845", "b", 1704530056940845),
    ("20240206T051917Z", "b", utc(2024, 2, 6, 5, 19, 17)),
    ("20240206", "b", utc(2024, 2, 5, 23)),
    ("2024年1月10日 18:49:21", "b", utc(2024, 1, 10, 17, 49, 21)),
    ("2024年9月19日", "k", utc(2024, 9, 18, 18, 15)),
    ("5/6/2024 02:52", "b", utc(2024, 6, 5, 0, 52)),
    ("5/6/2024 02:52", "n", utc(2024, 5, 6, 6, 52)),
    ("26.1.2024 1:04:30 AM", "b", utc(2024, 1, 26, 0, 4, 30)),
    ("01/26/2024 12:04:30 am", "n", utc(2024, 1, 26, 5, 4, 30)),
    ("01/26/2024 12:04:30 PM", "n", utc(2024, 1, 26, 17, 4, 30)),
    ("2024-05-25 19:51:06 America/Los_Angeles", "b", utc(2024, 5, 26, 2, 51, 6)),
    ("2024-01-06T10:31:03[America/New_York]", "b", utc(2024, 1, 6, 15, 31, 3)),
    ("2024-05-26T02:51:06.411[UTC]", "b", utc(2024, 5, 26, 2, 51, 6, micros=411000)),
    ("2024-01-06T10:31:03+01:00[America/New_York]", "b", utc(2024, 1, 6, 9, 31, 3)),
    ("  23 Jul 2024\t", "b", utc(2024, 7, 22, 22)),
    ("2024-02-29", "b", utc(2024, 2, 28, 23)),
    # twice: the earlier instant; skipped: with the offset before the change
    ("2024-10-27 02:30:00", "b", utc(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", "b", utc(2024, 3, 31, 1, 30)),
    ("2024-11-03 01:30:00", "n", utc(2024, 11, 3, 5, 30)),
    ("2024-03-10 02:30:00", "n", utc(2024, 3, 10, 7, 30)),
    *[(bad, "b", None) for bad in (None, "", "  ", "-", "yesterday", "n/a", "2024-13-05", "0000-00-00", "00/00/0000", "2025-02-30 10:12:00", "2025-04-09 25:10:00",
      "Tue, 31 Jun 2025 08:00:00 +0000", "Wed, 12 Mar", "2023-02-29", "2024-01-01 10:00:60", "13/13/2024 10:00", "2024-01-01 13:00 PM", "2024-01-01 10:00:00 Nowhere/City",
      "2024-01-01 10:00:00 QQQ", "12345", "1" * 50_000, "2024-01-01 " + "x" * 50_000, "\x02\x01\x01 2024")],
    ("2024-01-09 21:40:58", None, None),
    ("2024-01-09 21:40:58", "unknown", None),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ORIGINS, "origin string, zone_name string, day_first boolean"), spark.createDataFrame(ABBREVS, "abbrev string, offset_minutes int")


def test_every_notation(spark, small):
    df = spark.createDataFrame([(i, t, o) for i, (t, o, _) in enumerate(CASES)], "i int, date string, origin string")
    got = {r.i: r.utc_micros for r in normalise_timestamps(df, "date", "origin", *small).collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]]
    assert len(got) == len(CASES) and not wrong


def test_local_times_agree_with_another_zone_database(spark, small):
    start = datetime(2023, 12, 30)
    times = [start + timedelta(minutes=97 * i) for i in range(9000)]
    df = spark.createDataFrame([(i, str(t), o) for i, t in enumerate(times) for o in ("b", "n", "s", "k")], "i int, date string, origin string")
    zones = {o: ZoneInfo(z) for o, z, _ in ORIGINS}
    for r in normalise_timestamps(df, "date", "origin", *small).collect():
        # fold 0 is the earlier of two instants, and the offset before the change for a skipped time
        want = times[r.i].replace(tzinfo=zones[r.origin], fold=0)
        assert r.utc_micros == int(want.timestamp()) * 10**6, (times[r.i], r.origin)


def test_rows_and_clashing_columns_stay(spark, small):
    rows = [("2024-01-03", "b", "x", 1), ("2024-01-03", "b", "x", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "date string, origin string, zone_name string, utc_micros long")
    origins = small[0].union(small[0])
    out = normalise_timestamps(df, "date", "origin", origins, small[1])
    assert sorted(out.columns) == ["date", "origin", "utc_micros", "zone_name"]
    assert [r.utc_micros for r in out.orderBy("date").collect()] == [None, utc(2024, 1, 2, 23), utc(2024, 1, 2, 23)]
    assert normalise_timestamps(df.limit(0), "date", "origin", *small).count() == 0


def test_test_tables_leave_only_meaningless_dates(spark, data):
    from millrace.plans.general import p1_found

    found = {(r.src, r.row_id) for r in p1_found(spark, data).collect()}
    for name, key in (("cve_mails", "mail_id"), ("commits", "commit_id")):
        for r in table(spark, data, name).select(key, "date").collect():
            if (name, r[0]) not in found:
                bad = r.date is None or not re.search(r"\d", r.date) or re.search(r"0000|13-05|02-30|31 Jun|25:10|, 12 Mar$", r.date)
                assert bad, r.date


def test_query_and_sql(spark, data, sql):
    from conftest import same_rows

    from millrace.plans.general import SQL, p1_found

    assert same_rows(p1_found(spark, data), sql, SQL["p1_found"]) > 0
