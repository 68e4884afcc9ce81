import itertools
import os
import random
import threading

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from millrace.operators.deliveries import KEEP_STATES, SEGMENTS, DeliveryLedger, kept_mails, message_key, repeated_mails
from millrace.plans.general import SQL, p3_found
from millrace.session import work_path

SCHEMA = "mail_id long, epoch int, seq long, storage_commit string, message_id string"


def brute(rows):
    first = {}
    for r in rows:
        bare = (r[4] or "").strip().lower().strip("<> \t")
        key = ("id", bare) if bare else ("git", r[1], r[3]) if r[1] is not None and r[3] is not None else ("row", r[0])
        order = (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0, r[0])
        if key not in first or order < first[key][0]:
            first[key] = (order, r[0])
    return {x[1] for x in first.values()}


def test_identity_and_order(spark):
    rows = [
        (1, 0, 9, "a", "<X@y>"), (2, 0, 3, "b", " <x@Y> "), (3, 0, 1, "c", "x@y"), (4, 1, 0, "d", "x@y>"),
        (5, 0, 4, "s", None), (6, 0, 2, "s", " <> "), (7, 1, 2, "s", ""), (8, None, 1, None, None), (9, None, 1, None, None), (10, 0, 5, "a", "z"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.mail_id for r in kept_mails(df, work_path(spark, "t")).collect()} == brute(rows) == {3, 6, 7, 8, 9, 10}
    assert {r.mail_id for r in repeated_mails(df, work_path(spark, "t")).collect()} == {1, 2, 4, 5}


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 1, None]), rng.randrange(50), rng.choice("abc"), rng.choice(["<hot@x>", "HOT@X", f"m{rng.randrange(300)}", None, ""])) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("ord", F.lit(0))
    assert {r.mail_id for r in kept_mails(df, work_path(spark, "t"), shards=3).collect()} == brute(rows)


def test_batches_union_their_bits(spark):
    ledger = DeliveryLedger(spark, work_path(spark, "ledger"), shards=4)
    key = message_key(F.col("message_id"), F.col("epoch"), F.col("storage_commit"))
    rng = random.Random(7)
    seen = set()
    for batch in range(3):
        rows = [(1000 * batch + i, 0, i, f"c{batch}-{i}", f"<m{rng.randrange(60)}>") for i in range(80)]
        df = spark.createDataFrame(rows, SCHEMA)
        kept = {r.mail_id for r in ledger.apply(df, key, [F.col("epoch"), F.col("seq")], "mail_id", str(batch)).collect()}
        want = set()
        for r in rows:
            if r[4] not in seen:
                seen.add(r[4])
                want.add(r[0])
        assert kept == want
        again = {r.mail_id for r in ledger.apply(df, key, [F.col("epoch"), F.col("seq")], "mail_id", str(batch)).collect()}
        assert again == kept  # the same batch number changes nothing
    codes = [(r.shard, r.ordinal) for r in ledger.dictionary().collect()]
    assert len(codes) == len(set(codes)) == len(seen)
    for _, group in itertools.groupby(sorted(codes), lambda c: c[0]):
        ordinals = [o for _, o in group]
        assert ordinals == list(range(len(ordinals)))  # dense in each shard
    assert ledger.bits().agg(F.sum(F.bit_count("seen"))).first()[0] == len(seen)


def test_the_bit_decides(spark):
    ledger = DeliveryLedger(spark, work_path(spark, "ledger"), shards=2)
    df = spark.createDataFrame([(1, 0, 1, "a", "x"), (2, 0, 2, "b", "y"), (3, 0, 3, "b", None)], SCHEMA)
    key = F.col("message_id")
    commit, calls = ledger._commit, []

    def lost(state, **changes):
        calls.append(sorted(changes))
        if "bits" in changes:
            raise OSError("lost")
        return commit(state, **changes)

    ledger._commit = lost
    with pytest.raises(OSError):
        ledger.apply(df, key, [F.col("seq")], "mail_id", "0")
    ledger._commit = commit
    # the dictionary knows both identifiers, no bit is set: both stay when the batch runs again
    assert ledger.dictionary().count() == 2 and ledger.bits().count() == 0
    assert {r.mail_id for r in ledger.apply(df, key, [F.col("seq")], "mail_id", "0").collect()} == {1, 2, 3}
    assert {r.mail_id for r in ledger.apply(df, key, [F.col("seq")], "mail_id", "1").collect()} == {3}
    # a bit that is cleared by hand lets its identifier through again
    state = ledger._state()
    x = ledger.dictionary().where("key = 'x'").first()
    cleared = ledger.bits().withColumn("seen", F.when((F.col("shard") == x.shard) & (F.col("word") == x.ordinal // 64), F.expr(f"seen & ~shiftleft(1L, {x.ordinal % 64})")).otherwise(F.col("seen")))
    ledger._commit(state, bits=ledger._written(cleared, "bits"))
    assert {r.mail_id for r in ledger.apply(df.where("mail_id < 3"), key, [F.col("seq")], "mail_id", "2").collect()} == {1}


def test_two_writers_lose_nothing(spark):
    path = work_path(spark, "ledger")
    rows = {w: [(100 * w + i, 0, i, "c", f"m{(i * (w + 1)) % 25}") for i in range(20)] for w in range(3)}
    kept: dict[int, set] = {}

    def write(w):
        df = spark.createDataFrame(rows[w], SCHEMA)
        kept[w] = {r.mail_id for r in DeliveryLedger(spark, path, 2).apply(df, F.col("message_id"), [F.col("seq")], "mail_id", f"w{w}").collect()}

    threads = [threading.Thread(target=write, args=(w,)) for w in rows]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    of = {r[0]: r[4] for own in rows.values() for r in own}
    stayed = [of[i] for own in kept.values() for i in own]
    assert len(kept) == 3 and sorted(stayed) == sorted(set(of.values()))  # one row of each identifier


def test_the_dictionary_is_merged_and_old_files_go(spark):
    path = work_path(spark, "ledger")
    ledger = DeliveryLedger(spark, path, 2)
    for n in range(11):
        df = spark.createDataFrame([(2 * n, 0, 0, "c", f"a{n}"), (2 * n + 1, 0, 1, "c", "again")], SCHEMA)
        assert ledger.apply(df, F.col("message_id"), [F.col("seq")], "mail_id", str(n)).count() == (2 if n == 0 else 1)
    state = ledger._state()
    assert len(state["dictionary"]) <= SEGMENTS and ledger.dictionary().count() == 12
    folder = path.removeprefix("file://")
    assert len(os.listdir(f"{folder}/states")) <= 2 * KEEP_STATES + 2
    assert {r.mail_id for r in ledger.apply(df, F.col("message_id"), [F.col("seq")], "mail_id", "3").collect()} == {6}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_mails(df, work_path(spark, "t")).count() == 0


def test_query_and_sql(spark, data, sql):
    assert same_rows(p3_found(spark, data), sql, SQL["p3_found"]) > 0
