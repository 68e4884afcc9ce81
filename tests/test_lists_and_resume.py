import http.server
import itertools
import json
import threading

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import analysis, hashlist, resume
from millrace.sources import files


def test_hash_list_file(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("﻿# list\nAbCd\r\n\n  abcd \n1234\nffff\n", encoding="utf-8")
    rows = hashlist.read_hash_list(spark, str(path)).orderBy("input_index").collect()
    assert [tuple(r) for r in rows] == [(0, "AbCd"), (1, "1234"), (2, "ffff")]
    sliced = lambda *a: [r.requested_hash for r in hashlist.index_slice(hashlist.read_hash_list(spark, str(path)), *a).orderBy("input_index").collect()]
    assert (sliced(1), sliced(0, 1), sliced(1, 99), sliced(2, 2)) == (["1234", "ffff"], ["AbCd"], ["1234", "ffff"], [])
    for text, part in (("abcd\nHEAD\n", "line 2"), ("# x\n\n", "no hash")):
        path.write_text(text)
        with pytest.raises(hashlist.HashListError, match=part):
            hashlist.read_hash_list(spark, str(path))
    with pytest.raises(hashlist.HashListError):
        hashlist.index_slice(spark.range(1), 2, 1)


def test_dense_index_and_first(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(997))).repartition(7)
    rows = hashlist.dense_index(df, ["v", "id"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(5000)) and [(r.v, r.id) for r in rows] == sorted((r.v, r.id) for r in rows)
    firsts = {r.v: r.id for r in hashlist.first_of_each(df, F.col("v"), [F.col("id")]).collect()}
    want = {}
    for r in rows:
        want[r.v] = min(want.get(r.v, r.id), r.id)
    assert firsts == want
    assert hashlist.dense_index(df.limit(0), ["v"], "n").count() == 0


WANTED = [(0, "aa11", "aa11"), (1, "AA1", "aa11"), (2, "bb", "bb22"), (3, "zz", ""), (4, "cc", "cc33")]


def test_split_and_order(spark):
    wanted = spark.createDataFrame(WANTED, "input_index long, requested_hash string, canonical_hash string")
    done = f"{X.SUCCESS_MARK}\n{X.TITLE_BULLET} kept: it\n"
    reports = spark.createDataFrame([("bb22", done), ("cc33", X.FAILURE_MARK), ("bb22", done)], "hash string, content string")
    pending, reused, failed = resume.split_work(wanted, reports)
    assert [sorted(r.input_index for r in p.collect()) for p in (pending, reused, failed)] == [[0, 1, 4], [2], [3]]
    assert reused.first().subject == "kept: it"
    assert {r.input_index for r in resume.split_work(wanted, reports, force=True)[0].collect()} == {0, 1, 2, 4}
    once = resume.once_per_commit(pending)
    assert {r.input_index for r in once.collect()} == {0, 4}
    made = once.select("input_index", "requested_hash", F.col("canonical_hash").alias("hash"), *[F.lit("x").alias(c) for c in ("subject", "author", "date", "analysis")], F.lit("").alias("error"))
    ordered = resume.in_input_order(wanted, made, reused, failed).orderBy("input_index").collect()
    assert [(r.input_index, r.requested_hash, r.hash) for r in ordered] == [(0, "aa11", "aa11"), (1, "AA1", "aa11"), (2, "bb", "bb22"), (3, "zz", "zz"), (4, "cc", "cc33")]
    assert tuple(resume.result_counts(resume.in_input_order(wanted, made, reused, failed)).first()) == (5, 1, 1)


def test_evidence(spark):
    commits = spark.createDataFrame([("aa",), ("bb",), ("cc",)], "hash string")
    side = spark.createDataFrame([("aa.txt", "t"), ("aa.md", "m"), ("bb.txt", "b"), ("notes.md", "x")], "name string, content string")
    assert {r.hash: r.evidence for r in resume.with_evidence(commits, side).collect()} == {"aa": "m", "bb": "b", "cc": ""}
    assert resume.with_evidence(commits, None).first().evidence == ""


class Status(Exception):
    def __init__(self, code):
        super().__init__(f"status {code}")
        self.status = code


def scripted(*outcomes):
    left = list(outcomes)

    def ask(_):
        outcome = left.pop(0)
        if isinstance(outcome, Exception):
            raise outcome
        return outcome

    return ask, left


def test_retries():
    waits = []
    assert analysis.patient(scripted(Status(503), Status(429), " ok ")[0], sleep=waits.append)("p") == "ok" and waits == [1, 2]
    for outcomes, tries in (([ValueError("bad request")], 1), ([" "], 1), ([Status(501)] * 9, 5), ([Status(404)] * 2, 1)):
        ask, left = scripted(*outcomes)
        with pytest.raises(analysis.CallFailed):
            analysis.patient(ask, sleep=lambda _: None)("p")
        assert len(outcomes) - len(left) == tries
    assert [analysis.passing(e) for e in (Status(408), Status(400), Exception("Rate limit"), Exception("HTTP 502"), Exception("no"))] == [True, False, True, True, False]


def test_endpoint():
    seen, replies = [], [(503, ""), (200, json.dumps({"choices": [{"message": {"content": " fine "}}]})), (200, "{}"), (400, "")]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = replies.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = analysis.patient(analysis.Endpoint(f"http://127.0.0.1:{server.server_port}/v1/", "k", "m", 77), sleep=lambda _: None)
        assert ask("task") == "fine" and len(seen) == 2
        path, key, body = seen[0]
        assert (path, key, body["model"], body["max_tokens"], body["messages"][1]["content"]) == ("/v1/chat/completions", "Bearer k", "m", 77, "task")
        for _ in range(2):
            with pytest.raises(analysis.CallFailed):
                ask("task")
    finally:
        server.shutdown()
    with pytest.raises(analysis.CallFailed, match="connection"):
        analysis.Endpoint("http://127.0.0.1:9", "k", "m", seconds=2)("task")


def echo():
    def ask(task):
        if "bad0" in task:
            raise RuntimeError("refused")
        return f"{len(task)} characters"

    return ask


def test_one_failure_does_not_stop_the_batch(spark):
    schema = "input_index long, requested_hash string, hash string, subject string, author string, date string, body string, files array<string>, diff string, diff_truncated boolean, original_diff_chars int, evidence string, error string"
    rows = [(0, "g", "good", "s", "a", "d", "", [], "", True, 60000, "", ""), (1, "b", "bad0", "s", "a", "d", "x", ["f", None], "y", False, 1, "e", ""), (2, "m", "", None, None, None, None, None, None, None, None, None, "gone")]
    df = spark.createDataFrame(rows, schema)
    got = {r.input_index: r for r in analysis.analyse(df, echo, "context", 2).collect()}
    assert got[0].error == "" and "characters" in got[0].analysis
    assert (got[1].hash, got[1].error, got[1].subject) == ("bad0", "refused", X.FAILED_SUBJECT)
    assert (got[2].hash, got[2].error) == ("m", "gone")
    text = df.select(analysis.prompt("context").alias("p")).collect()
    assert "60000 characters" in text[0].p and "None. Reports" in text[0].p and all(f"## {h}\n" in text[0].p for h, _ in analysis.OUTLINE)
    assert "\nf\n" in text[1].p and "None. Reports" not in text[1].p and text[2].p is not None


def test_saved_answers(spark):
    row = {"hash": "h", "subject": "s", "author": None, "date": "d", "analysis": "a\n\n---\nb", "error": ""}
    text = X.report_text(row, "now")
    assert X.saved_answer(text, "now") == row["analysis"] and X.saved_answer(text, "then") is None and X.saved_answer(text, "") is None
    assert X.saved_answer(X.report_text(row | {"error": "e"}, "now"), "now") is None
    df = spark.createDataFrame([tuple(row.values())], "hash string, subject string, author string, date string, analysis string, error string")
    assert df.select(X.render_report(*[F.col(c) for c in ("hash", "subject", "author", "date", "analysis", "error")], F.lit("now")).alias("r")).first().r == text


def test_strip_is_pythons(spark):
    texts = ["".join(c) for c in itertools.product(["a", " ", "\x1c\x85", "\u2003\u3000\t", "\u200b"], repeat=3)] + ["", " " * 50_000 + "x" + " " * 50_000 + "y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(X.strip(F.col("t")).alias("s")).collect()] == [(t or "").strip() for t in texts]


def test_files(spark, tmp_path):
    (tmp_path / "x").write_text("old")
    with pytest.raises(ZeroDivisionError):
        files.write_atomically(tmp_path / "x", (str(1 // n) for n in (1, 0)))
    assert (tmp_path / "x").read_text() == "old" and len(list(tmp_path.iterdir())) == 1
    df = spark.createDataFrame([(1, "é", None), (0, "a", [1])], "i int, v string, l array<int>")
    files.write_jsonl(df, ["v", "l"], ["i"], tmp_path / "o.jsonl")
    assert (tmp_path / "o.jsonl").read_text() == '{"v":"a","l":[1]}\n{"v":"é","l":null}\n'
    with pytest.raises(ValueError):
        files.audit_path(tmp_path / "o", tmp_path / "o")
    assert str(files.audit_path(tmp_path / "o", None)).endswith("o.audit.jsonl")
    for bad in (tmp_path / "none", tmp_path / "blank"):
        (tmp_path / "blank").write_text(" \n")
        with pytest.raises(ValueError):
            files.read_context(bad)
    assert files.read_text_files(spark, str(tmp_path / "empty")).count() == 0
