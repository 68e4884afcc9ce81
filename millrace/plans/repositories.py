"""Queries of the sources and sinks that live in files: Git repositories and archives, lists, audits, reports.

The tables are first laid out as what these operators read: every commit as a Git commit of its own, every
mail as a commit of its epoch. Git and the sinks work on mounted paths, so the shared folder must be one.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import settings
from millrace.functions import text as X
from millrace.operators import analysis, hashlist, resume
from millrace.operators import references as R
from millrace.plans import triage
from millrace.session import table, work_path
from millrace.sources import files, git

WHEN = "2024-01-01T00:00:00+00:00"


def _scratch(spark: SparkSession, name: str) -> Path:
    path = work_path(spark, name)
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is no mounted folder, which files and repositories need")
    return Path(path.removeprefix("file://"))


def _import(folder: Path, stream: Iterable[bytes]) -> dict[int, str]:
    """Feeds ``git fast-import`` and gives the hash behind each mark."""
    folder.mkdir(parents=True, exist_ok=True)
    marks = folder / "marks"
    subprocess.run(["git", "init", "-q", *(["--bare"] if folder.suffix == ".git" else []), "."], cwd=folder, check=True)
    with subprocess.Popen(["git", "fast-import", "--quiet", "--force", f"--export-marks={marks}"], cwd=folder, stdin=subprocess.PIPE) as process:
        for part in stream:
            process.stdin.write(part)
        process.stdin.close()
    if process.returncode:
        raise git.GitError("the import failed")
    return {int(m[1:]): h for m, h in (line.split() for line in marks.read_text().splitlines())}


def _data(content: bytes) -> bytes:
    return b"data %d\n%s\n" % (len(content), content)


# --- commits ----------------------------------------------------------------------------------


def _commit_repository(spark: SparkSession, folder: str) -> tuple[Path, DataFrame, DataFrame]:
    """(work tree, (input_index, hash) of its commits, (input_index, hash) of its tag objects)."""
    paths = F.array_sort(F.array_distinct(F.filter(F.coalesce("files", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")))
    message = F.concat(X.given(F.col("subject")), F.lit("\n\n"), X.given(F.col("body")))
    rows = table(spark, folder, "commits").select("commit_id", F.md5(X.given(F.col("author"))).alias("author"), message.alias("message"), paths.alias("paths"), F.transform(paths, F.md5).alias("names"))

    def stream() -> Iterator[bytes]:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            who = f"{r.author} <a@x.example> {r.commit_id % 100_000 * 3600} +0000\n".encode()
            yield b"reset refs/heads/all\n\ncommit refs/heads/all\nmark :%d\nauthor %scommitter %s" % (r.commit_id + 1, who, who)
            yield _data(r.message.encode())
            for path, name in zip(r.paths, r.names, strict=True):
                yield b"M 100644 inline p/%s\n" % name.encode() + _data(path.encode() + b"\n")
            if r.commit_id % 50 == 0:
                yield b"tag t%d\nfrom :%d\ntagger %s" % (r.commit_id, r.commit_id + 1, who) + _data(b"tag\n")

    place = _scratch(spark, "repository") / "tree"
    marks = _import(place, stream())
    tags = [line.split() for line in git.git(place, "for-each-ref", "--format=%(objectname) %(refname:short)", "refs/tags").splitlines()]
    listed = lambda rows: spark.createDataFrame(rows or [(None, None)], "input_index bigint, hash string").where("hash is not null")
    return place, listed([(m - 1, h) for m, h in marks.items()]), listed([(int(name[1:]), h) for h, name in tags])


def git_commits_read(spark, folder):
    """Metadata, changed files and difference of every commit, read from Git by hash."""
    place, commits, _ = _commit_repository(spark, folder)
    git.check_work_tree(place)
    read = git.read_commits(commits.withColumnRenamed("hash", "requested_hash"), str(place))
    diffs = F.size(F.split(F.concat(F.lit("\n"), "diff"), "\ndiff --git ")) - 1
    return read.select(
        F.col("input_index").alias("commit_id"), "subject", F.md5("body").alias("body_md5"), "author", "date", F.array_join("files", "\n").alias("files"),
        diffs.cast("bigint").alias("diffs"), (F.col("hash") == F.col("requested_hash")).alias("same"), "error",
    )


def resolve_bulk(spark, folder):
    """Whole hashes in other case, prefixes and tag objects name their commit, unknown hashes none."""
    place, commits, tags = _commit_repository(spark, folder)
    forms = commits.select("input_index", "hash", F.explode(F.create_map(F.lit("whole"), F.upper("hash"), F.lit("prefix"), F.left("hash", F.lit(20)), F.lit("unknown"), F.reverse("hash"))).alias("form", "asked"))
    forms = forms.unionByName(tags.withColumnRenamed("hash", "asked").join(commits, "input_index").withColumn("form", F.lit("tag")))
    found = git.resolve_in_repository(forms, "asked", str(place)).withColumnRenamed("asked", "__a")
    joined = forms.join(found, F.lower("asked") == F.col("__a"), "left")
    return joined.select(F.col("input_index").alias("commit_id"), "form", F.coalesce(F.col("canonical_hash") == F.col("hash"), F.lit(False)).alias("own"))


# --- mails ------------------------------------------------------------------------------------


def archive_read(spark, folder):
    """Every mail of an archive of one repository an epoch, in the order of its history."""
    root = _scratch(spark, "archive")
    rows = table(spark, folder, "inbox_messages").select("epoch", "seq", "mail_id", "raw_message")
    for (epoch,) in rows.select("epoch").distinct().collect():  # an archive has a handful of epochs

        def stream(epoch=epoch) -> Iterator[bytes]:
            for n, r in enumerate(rows.where(F.col("epoch") == epoch).orderBy("seq").toLocalIterator()):
                yield b"commit refs/heads/master\nmark :%d\ncommitter a <a@x.example> %d +0000\n" % (n + 1, n) + _data(str(r.mail_id).encode())
                yield b"D m\n" if r.raw_message is None else b"M 100644 inline m\n" + _data(bytes(r.raw_message))

        _import(root / "git" / f"{epoch}.git", stream())
    return git.read_archive(spark, str(root)).select(F.col("epoch").cast("bigint").alias("epoch"), "seq", F.md5("raw_message").alias("raw_md5"))


# --- lists, audits, reports -------------------------------------------------------------------


def sink_hash_list(spark, folder):
    """A hash list written, and read again."""
    asked = table(spark, folder, "commits").where(X.is_hash(F.col("requested_hash")))
    path = files.write_lines(asked, "requested_hash", ["commit_id"], _scratch(spark, "list") / "hashes.txt")
    return hashlist.read_hash_list(spark, str(path))


def sink_filter_audit(spark, folder):
    """The audit of the filter as JSON lines, and read again."""
    decided = triage._decided(spark, folder)
    path = files.write_jsonl(decided, decided.columns, ["input_index"], _scratch(spark, "audit") / "audit.jsonl")
    read = spark.read.schema(decided.schema).json(path.as_uri())
    return read.select("input_index", "status", "reason", F.size("include_matches").cast("bigint").alias("includes"), F.array_join("exclude_matches.pattern", ",").alias("excludes"))


def sink_mail_audit(spark, folder):
    """K4: the audit of the mails as JSON lines, and read again."""
    mails, fixes = triage._chosen(spark, folder)
    nested = R.audit(mails, fixes, "mail_id")
    path = files.write_jsonl(nested, ["mail_id", "status", "reason", "fixes"], ["mail_id"], _scratch(spark, "audit") / "mails.jsonl")
    return triage.flat_audit(spark.read.schema(nested.select("mail_id", "status", "reason", "fixes").schema).json(path.as_uri()))


def sink_reports(spark, folder):
    """A report file of every result, and what resuming reads from them."""
    out = _scratch(spark, "reports")
    reports = triage._reports(spark, folder).select(X.report_name(F.col("hash")).alias("name"), "content")
    files.write_reports(reports, out)
    files.write_atomically(out / "index.md", ["# not a report\n"])
    return files.read_reports(spark, str(out)).select("hash", F.md5("content").alias("report_md5"), X.is_finished(F.col("content")).alias("finished"))


def sink_index(spark, folder):
    """K6: the index of all results, in order, and its lines read again."""
    lines = triage.index_lines(spark, folder)
    path = files.write_lines(lines, "line", ["hash"], _scratch(spark, "index") / "index.md")
    read = hashlist.dense_index(hashlist.file_lines(spark, path.as_uri()).where("line <> ''"), ["at"], "no")
    return read.select("no", "line")


def evidence_files(spark, folder):
    """Side files written, found again and joined."""
    out = _scratch(spark, "evidence")
    files.write_reports(triage.side_files(spark, folder), out)
    found = resume.with_evidence(table(spark, folder, "commits").select("commit_id", "hash"), files.read_text_files(spark, str(out)))
    return found.select("commit_id", F.md5("evidence").alias("evidence_md5"))


# --- calls ------------------------------------------------------------------------------------


class _Digest:
    """A model whose answers are digests of the tasks; it refuses some."""

    def __call__(self):
        return self.ask

    @staticmethod
    def ask(task: str) -> str:
        import hashlib

        if "drop" in task.split("\ntitle: ")[1].split("\nby: ")[0]:
            raise analysis.CallFailed("refused")
        return hashlib.md5(task.encode()).hexdigest()


def analysed_commits(spark, folder):
    """Every commit put to a model, refusals kept apart, each answer saved as a report."""
    commits = table(spark, folder, "commits").withColumn("input_index", F.col("commit_id")).withColumn("evidence", F.lit(""))
    commits = commits.withColumn("hash", F.concat("hash", F.lit("-"), F.col("commit_id").cast("string")))  # one report a load
    out = _scratch(spark, "answers")
    results = analysis.analyse(commits, _Digest(), "Context.", 8, str(out), WHEN)
    return results.select("input_index", "hash", "subject", "analysis", "error")


def retry_loop(spark, folder):
    """L2, L3: the waits of the retry loop when a call fails again and again with each error."""
    errors = table(spark, folder, "analysis_results").where("error <> ''").select("hash", "error", F.expr("try_cast(regexp_extract(error, '^HTTP ([0-9]+)$', 1) as int)").alias("status"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                slept: list[int] = []

                def fail(_, r=r):
                    raise analysis.CallFailed(r.error, None if pd.isna(r.status) else int(r.status))

                try:
                    analysis.patient(fail, sleep=slept.append)("task")
                except analysis.CallFailed as e:
                    rows.append((r.hash, len(slept), sum(slept), str(e)))
            yield pd.DataFrame(rows, columns=["hash", "retries", "waited", "error"])

    return errors.mapInPandas(run, "hash string, retries bigint, waited bigint, error string")


def setting_precedence(spark, folder):
    """P20: the command line's value, else the environment's, else the default, through the settings' own function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [settings.setting(a, "WHEN", "default", {} if d is None else {"WHEN": d}) for a, d in zip(batch["author"], batch["date"], strict=True)]
            yield pd.DataFrame({"commit_id": batch["commit_id"], "value": values})

    return table(spark, folder, "commits").select("commit_id", "author", "date").mapInPandas(run, "commit_id bigint, value string")


QUERIES = {
    "git_commits_read": git_commits_read,
    "resolve_bulk": resolve_bulk,
    "archive_read": archive_read,
    "sink_hash_list": sink_hash_list,
    "sink_filter_audit": sink_filter_audit,
    "sink_mail_audit": sink_mail_audit,
    "sink_reports": sink_reports,
    "sink_index": sink_index,
    "evidence_files": evidence_files,
    "analysed_commits": analysed_commits,
    "retry_loop": retry_loop,
    "setting_precedence": setting_precedence,
}
