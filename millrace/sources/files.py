"""Text files as sources and sinks: side files, reports, contexts, ordered lists and audits."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import uri


def read_text_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, content) of the text files of a folder that match ``pattern``; none if there is no such file."""
    found = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(uri(folder), pattern))
    matching = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    if matching is None or not len(matching):
        return spark.createDataFrame([], "name string, content string")
    read = spark.read.text(os.path.join(uri(folder), pattern), wholetext=True)
    return read.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, content) of the reports of a folder."""
    files = read_text_files(spark, folder, "*.md")
    return files.where("name <> 'index.md'").select(F.regexp_replace("name", r"\.md\z", "").alias("hash"), "content")


def read_context(path: str | Path) -> str:
    """The stripped text of a context file; unreadable and empty ones are errors."""
    try:
        text = Path(path).read_text(encoding="utf-8").strip()
    except (OSError, UnicodeDecodeError) as e:
        raise ValueError(f"the context {path} can't be read: {e}") from e
    if not text:
        raise ValueError(f"the context {path} is empty")
    return text


def write_atomically(path: str | Path, pieces: Iterable[str]) -> Path:
    """Writes the pieces one after the other, with plain line feeds, to a file that appears at once or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}-")
    try:
        with open(handle, "w", encoding="utf-8", newline="\n") as out:
            out.writelines(pieces)
        os.replace(draft, path)
    except BaseException:
        Path(draft).unlink(missing_ok=True)
        raise
    return path


def write_lines(df: DataFrame, column: str, order: list[str], path: str | Path) -> Path:
    """One line per row of ``column`` in the given order; rows are streamed through the driver, not collected."""
    rows = df.orderBy(*order).select(column)
    return write_atomically(path, (f"{r[0]}\n" for r in rows.toLocalIterator()))


def write_jsonl(df: DataFrame, columns: list[str], order: list[str], path: str | Path) -> Path:
    """One JSON object per row, in order, with all of ``columns``; characters stay as they are."""
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line")
    return write_lines(df.select(*order, line).select("line", *order), "line", order, path)


def audit_path(output: str | Path, audit: str | Path | None) -> Path:
    """The audit's path, by default beside the output; the two may not be one file."""
    found = Path(audit) if audit else Path(f"{output}.audit.jsonl")
    if found.resolve() == Path(output).resolve():
        raise ValueError("output and audit are the same file")
    return found


def write_reports(reports: DataFrame, folder: str | Path) -> int:
    """Writes (name, content) rows as files, each from the partition that holds it; the folder must be shared."""
    folder = str(folder)
    Path(folder).mkdir(parents=True, exist_ok=True)

    def save(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                write_atomically(Path(folder) / name, [content])
            yield pd.DataFrame({"n": [len(batch)]})

    return reports.select("name", "content").mapInPandas(save, "n bigint").agg(F.sum("n")).first()[0] or 0
