"""Git as a source: commits by hash, and mail archives that keep one mail a commit, through Python data sources.

``spark.read.format("git_commits")`` needs ``path`` (a work tree) and ``hashes`` (comma-separated); large hash lists go through
``read_commits``, which looks them up in the partitions of the list. ``spark.read.format("mail_archive")`` needs
``path`` and has one partition an epoch; with the option ``prune``, which needs
``spark.sql.python.filterPushdown.enabled``, a filter on ``epoch`` prunes partitions.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from millrace import schemas as S
from millrace.functions import text as X

_EPOCH = re.compile(r"(\d+)\.git\Z")
_HASH = re.compile(r"[0-9a-fA-F]{4,64}\Z")


class GitError(RuntimeError):
    """Git could not do what was asked."""


def git(folder: str | Path, *args: str, stdin: str | None = None) -> str:
    """The output of a git command in a folder, as UTF-8 with replacements."""
    try:
        done = subprocess.run(["git", *args], cwd=folder, input=None if stdin is None else stdin.encode(), capture_output=True, check=False)
    except OSError as e:
        raise GitError(f"git can't be run in {folder}: {e}") from e
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip() or done.returncode}")
    return done.stdout.decode("utf-8", "replace")


def check_work_tree(folder: str | Path) -> None:
    if not Path(folder).is_dir() or git(folder, "rev-parse", "--is-inside-work-tree").strip() != "true":
        raise GitError(f"{folder} is no git work tree")


def resolve_hashes(folder: str | Path, hashes: Iterable[str]) -> dict[str, str]:
    """Whole hash of each given one (in lower case) that names exactly one commit, tags peeled: one process for all.

    Git repeats the asked hash behind each answer, so answers are told apart by name, never by place.
    """
    wanted = dict.fromkeys(h.lower() for h in hashes if _HASH.match(h))
    if not wanted:
        return {}
    out = git(folder, "cat-file", "--batch-check=%(objectname) %(objecttype) %(rest)", stdin="".join(f"{h}^{{commit}} {h}\n" for h in wanted))
    answers = (line.split(" ") for line in out.splitlines())
    return {a[2]: a[0] for a in answers if len(a) == 3 and a[1] == "commit" and a[2] in wanted}


def read_commit(folder: str | Path, full: str, with_diff: bool) -> tuple[str, str, str, list[str], str]:
    """(author, date, message, files, diff) of one commit."""
    # What git is asked, so that dates, paths and differences come in the expected form
    shown = git(folder, "show", "-s", "--date=short", "--format=%an%x00%ad%x00%B", full).split("\0", 2)
    if len(shown) != 3:
        raise GitError(f"the metadata of {full} are malformed")
    author, date, message = shown
    names = git(folder, "show", "--name-only", "--format=", "--no-ext-diff", full)
    files = [x.strip() for x in names.splitlines() if x.strip()]
    diff = git(folder, "show", "--format=", "--find-renames", "--find-copies", "--unified=3", "--no-ext-diff", full).strip() if with_diff else ""
    return author.strip(), date.strip(), message, files, diff


def resolve_in_repository(references: DataFrame, ref: str, folder: str) -> DataFrame:
    """(``ref`` in lower case, canonical_hash) of the distinct references that name one commit of a work tree.

    Git itself decides, in partitions with one process a batch: prefixes that are ambiguous in the repository
    name none, tag objects name the commit that they tag. All executors must see ``folder``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = resolve_hashes(folder, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], names=[ref, "canonical_hash"])

    wanted = references.select(F.lower(F.col(f"`{ref}`")).alias(ref)).where(X.is_hash(F.col(ref))).distinct()
    return wanted.mapInArrow(run, f"`{ref}` string, canonical_hash string")


_RAW = "input_index bigint, requested_hash string, hash string, author string, date string, message string, files array<string>, diff string, error string"
_RAW_NAMES = ["input_index", "requested_hash", "hash", "author", "date", "message", "files", "diff", "error"]


def _lookup(folder: str, rows: list[tuple[int, str]], with_diff: bool) -> pa.RecordBatch:
    full = resolve_hashes(folder, [h for _, h in rows])
    out = []
    for index, asked in rows:
        known = full.get(asked.lower(), "")
        try:
            if not known:
                raise GitError(f"no such commit, or more than one: {asked}")
            out.append((index, asked, known, *read_commit(folder, known, with_diff), ""))
        except Exception as e:  # noqa: BLE001 - one row's failure is kept with the row
            out.append((index, asked, asked, "", "", "", [], "", str(e) or type(e).__name__))
    columns = list(zip(*out, strict=True)) if out else [[]] * len(_RAW_NAMES)
    kinds = [pa.int64(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_RAW_NAMES)


def _shaped(raw: DataFrame, limit: int) -> DataFrame:
    text, cut = X.truncated(F.col("diff"), limit)
    return raw.select(
        "input_index", "requested_hash", "hash", X.subject_of(F.col("message")).alias("subject"), "author", "date", X.body_of(F.col("message")).alias("body"),
        "files", text.alias("diff"), cut.alias("diff_truncated"), F.length("diff").alias("original_diff_chars"), "error",
    )


def read_commits(hashes: DataFrame, folder: str, max_diff_chars: int = 0, with_diff: bool = True, partitions: int | None = None) -> DataFrame:
    """The commits of ``hashes`` (input_index, requested_hash), looked up where the list's partitions are.

    All executors must see ``folder``. A hash that names no commit gives a row with ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _lookup(folder, list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), with_diff)

    wanted = hashes.select("input_index", "requested_hash")
    if partitions:
        wanted = wanted.repartition(partitions)
    return _shaped(wanted.mapInArrow(run, _RAW), max_diff_chars)


class _Hashes(InputPartition):
    def __init__(self, rows: list[tuple[int, str]]):
        super().__init__(rows[0][0])
        self.rows = rows


class _CommitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.diff = options["path"], options.get("includeDiff", "true") == "true"
        self.rows = list(enumerate(h.strip() for h in options["hashes"].split(",") if h.strip()))
        self.size = int(options.get("batch", "200"))

    def partitions(self):
        return [_Hashes(self.rows[i : i + self.size]) for i in range(0, len(self.rows), self.size)]

    def read(self, partition):
        yield _lookup(self.path, partition.rows, self.diff)


class GitCommits(DataSource):
    """Raw commits by hash: the columns of ``_RAW``."""

    @classmethod
    def name(cls):
        return "git_commits"

    def schema(self):
        return _RAW

    def reader(self, schema):
        check_work_tree(self.options["path"])
        return _CommitReader(self.options)


def epochs(folder: str | Path) -> list[tuple[int, str]]:
    """(number, path) of the archive's epochs, in numeric order: of a root, of its ``git`` folder, or one ``N.git``."""
    root = Path(folder).expanduser().resolve()
    bare = lambda p: (p / "HEAD").is_file() and (p / "objects").is_dir()
    if (m := _EPOCH.match(root.name)) and bare(root):
        return [(int(m[1]), str(root))]
    inner = root / "git" if (root / "git").is_dir() else root
    found = sorted((int(m[1]), str(p)) for p in (inner.iterdir() if inner.is_dir() else ()) if (m := _EPOCH.match(p.name)) and bare(p))
    if not found:
        raise GitError(f"{root} holds no epoch such as 0.git")
    return found


def read_blobs(folder: str, commits: list[str], name: str = "m") -> Iterator[tuple[int, str, bytes]]:
    """(place, commit, content) of the file ``name`` of each commit that has it, from one process."""
    with subprocess.Popen(["git", "cat-file", "--batch"], cwd=folder, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as process:
        try:
            for place, commit in enumerate(commits):
                process.stdin.write(f"{commit}:{name}\n".encode())
                process.stdin.flush()
                head = process.stdout.readline().split()
                if head and head[-1] == b"missing":
                    continue
                if len(head) != 3 or head[1] != b"blob" or not head[2].isdigit():
                    raise GitError(f"unexpected answer about {commit}: {head!r}")
                data = process.stdout.read(int(head[2]))
                if len(data) != int(head[2]) or process.stdout.read(1) != b"\n":
                    raise GitError(f"the mail of {commit} is cut short")
                yield place, commit, data
        finally:
            process.stdin.close()
            process.terminate()


class _Epoch(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(number)
        self.number, self.path = number, path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.found = epochs(options["path"])
        self.only: set[int] | None = None

    def partitions(self):
        return [_Epoch(n, p) for n, p in self.found if self.only is None or n in self.only] or [_Epoch(-1, "")]

    def read(self, partition):
        if partition.number >= 0:
            commits = git(partition.path, "rev-list", "--reverse", "--all").split()
            for place, commit, data in read_blobs(partition.path, commits):
                yield partition.number, place, commit, data


class _PruningReader(_ArchiveReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("epoch",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f


class MailArchive(DataSource):
    """Raw mails of an archive: epoch, seq (place in the epoch's history), storage_commit, raw_message."""

    @classmethod
    def name(cls):
        return "mail_archive"

    def schema(self):
        return S.MESSAGE

    def reader(self, schema):
        return (_PruningReader if self.options.get("prune", "false") == "true" else _ArchiveReader)(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to ``spark.read``."""
    spark.dataSource.register(GitCommits)
    spark.dataSource.register(MailArchive)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("mail_archive").option("prune", prune).load(folder)
