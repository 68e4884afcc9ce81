"""Command lines: ``python -m millrace.cli extract|filter|analyze``.

Each stage's output is the next one's default input. Exit codes: 0 done, 1 done with failed rows, 2 wrong
settings or unreadable sources.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from functools import partial
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace import settings as C
from millrace.functions import text as X
from millrace.operators import analysis, hashlist, resume, rules
from millrace.plans import pipeline
from millrace.session import clear_work, local_session, written
from millrace.sources import files, git

_ERRORS = (C.SettingsError, hashlist.HashListError, rules.RuleError, git.GitError, analysis.CallFailed, ValueError, OSError)


def _settings(argv: list[str]) -> C.Settings:
    first = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    first.add_argument("--settings", type=Path)
    asked = first.parse_known_args(argv)[0].settings
    return C.load_settings(asked or C.DEFAULT_FILE, required=asked is not None)


def _parser(name: str, *positional: tuple[str, Path | None]) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog=f"millrace {name}", allow_abbrev=False)
    for dest, default in positional:
        parser.add_argument(dest, nargs="?", type=Path, default=default)
    parser.add_argument("--settings", type=Path)
    return parser


def _need(args: argparse.Namespace, *names: str) -> None:
    missing = [n for n in names if getattr(args, n) is None]
    if missing:
        raise C.SettingsError(f"not given: {', '.join(missing)}")


def _at_least(args: argparse.Namespace, **limits: int) -> None:
    for name, least in limits.items():
        if getattr(args, name) < least:
            raise C.SettingsError(f"{name} must be at least {least}")


# The names and defaults of the options below.


def extract_options(argv: list[str], s: C.Settings) -> argparse.Namespace:
    own = s.cve_source
    parser = _parser("extract", ("inbox_dir", own.inbox_dir), ("output_file", C.first_given(own.output_file, s.hash_filter.source_file)))
    parser.add_argument("--linux-dir", type=Path, default=s.linux_dir)
    parser.add_argument("--audit-file", type=Path, default=own.audit_file)
    parser.add_argument("--prefer-mainline", action=argparse.BooleanOptionalAction, default=own.prefer_mainline)
    parser.add_argument("--fallback-to-all", action=argparse.BooleanOptionalAction, default=own.fallback_to_all)
    args = parser.parse_args(argv)
    _need(args, "inbox_dir", "output_file", *(["linux_dir"] if args.prefer_mainline else []))
    args.audit_file = files.audit_path(args.output_file, args.audit_file)
    return args


def filter_options(argv: list[str], s: C.Settings) -> argparse.Namespace:
    own = s.hash_filter
    parser = _parser("filter", ("linux_dir", s.linux_dir), ("source_file", own.source_file), ("output_file", C.first_given(own.output_file, s.hashes_file)))
    parser.add_argument("--audit-file", type=Path, default=own.audit_file)
    parser.add_argument("--include", action="append")
    parser.add_argument("--exclude", action="append")
    parser.add_argument("--fields", nargs="+", default=list(own.fields))
    parser.add_argument("--match", default=own.match)
    parser.add_argument("--case-sensitive", action=argparse.BooleanOptionalAction, default=own.case_sensitive)
    parser.add_argument("--workers", type=int, default=C.first_given(own.workers, s.workers, 8))
    parser.add_argument("--max-diff-chars", type=int, default=C.first_given(own.max_diff_chars, 0))
    args = parser.parse_args(argv)
    # rules on the command line replace those of the file
    args.include = list(own.include) if args.include is None else args.include
    args.exclude = list(own.exclude) if args.exclude is None else args.exclude
    _need(args, "linux_dir", "source_file", "output_file")
    _at_least(args, workers=1, max_diff_chars=0)
    args.audit_file = files.audit_path(args.output_file, args.audit_file)
    return args


def analyze_options(argv: list[str], s: C.Settings) -> argparse.Namespace:
    parser = _parser("analyze", ("linux_dir", s.linux_dir), ("hashes_file", s.hashes_file))
    parser.add_argument("--outdir", type=Path, default=C.first_given(s.outdir, Path("analysis_out")))
    parser.add_argument("--context-md", type=Path, default=s.context_md)
    parser.add_argument("--evidence-dir", type=Path, default=s.evidence_dir)
    parser.add_argument("--force", action=argparse.BooleanOptionalAction, default=bool(s.force))
    for name, default in (("workers", 8), ("max_tokens", 8192), ("max_diff_chars", 50_000), ("start_index", 0), ("end_index", -1)):
        parser.add_argument(f"--{name.replace('_', '-')}", type=int, default=C.first_given(getattr(s, name), default))
    parser.add_argument("--api-key")
    parser.add_argument("--api-key-file", type=Path, default=C.first_given(s.openai.api_key_file, Path("OPENAI_API_KEY")))
    parser.add_argument("--base-url")
    parser.add_argument("--model")
    args = parser.parse_args(argv)
    _need(args, "linux_dir", "hashes_file", "context_md")
    _at_least(args, workers=1, max_tokens=1, max_diff_chars=0, start_index=0, end_index=-1)
    if args.end_index != -1 and args.end_index < args.start_index:
        raise C.SettingsError("end_index must not be below start_index")
    if args.evidence_dir is not None and not args.evidence_dir.is_dir():
        raise C.SettingsError(f"{args.evidence_dir} is no folder")
    return args


def extract(spark: SparkSession, argv: list[str]) -> int:
    args = extract_options(argv, _settings(argv))
    resolver = None
    if args.prefer_mainline:
        git.check_work_tree(args.linux_dir)
        resolver = partial(git.resolve_in_repository, ref="reported_hash", folder=str(args.linux_dir))
    found = pipeline.extract(git.read_archive(spark, str(args.inbox_dir)), None, args.prefer_mainline, args.fallback_to_all, resolver=resolver)
    mails, candidates = written(found.mails, "mails"), written(found.candidates, "candidates")
    files.write_lines(candidates, "output_hash", ["epoch", "seq", "fix_idx"], args.output_file)
    columns = [c for c in mails.columns if c != "seq"]
    files.write_jsonl(mails, columns, ["epoch", "seq"], args.audit_file)
    counts = mails.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "selected").alias("s"), F.count_if(F.col("status") == "unresolved").alias("u")).first()
    print(f"mails {counts['n']}, candidates {candidates.count()}, selected {counts['s']}, unresolved {counts['u']}; {args.output_file}, {args.audit_file}")
    return 0


def filter_(spark: SparkSession, argv: list[str]) -> int:
    args = filter_options(argv, _settings(argv))
    wanted = rules.compile_rules(args.include, args.exclude, args.fields, args.match, args.case_sensitive)
    git.check_work_tree(args.linux_dir)
    hashes = hashlist.read_hash_list(spark, str(args.source_file))
    if not args.include and not args.exclude:
        print("no rules: every readable commit is kept", file=sys.stderr)
    commits = git.read_commits(hashes, str(args.linux_dir), args.max_diff_chars, rules.needs_diff(wanted), args.workers)
    decisions = written(rules.decide(commits, wanted), "decisions")
    files.write_lines(decisions.where("status = 'selected'"), "hash", ["input_index"], args.output_file)
    files.write_jsonl(decisions, decisions.columns, ["input_index"], args.audit_file)
    counts = rules.summary(decisions).first()
    print(f"read {counts['total']}, kept {counts['selected']}, errors {counts['errors']}; {args.output_file}, {args.audit_file}")
    return int(counts["exit_code"])


def _endpoint(url: str, key: str, name: str, max_tokens: int) -> analysis.Model:
    return analysis.patient(analysis.Endpoint(url, key, name, max_tokens))


_RESULT = "input_index bigint, requested_hash string, hash string, subject string, author string, date string, analysis string, error string"


def analyze(spark: SparkSession, argv: list[str], make_model=None) -> int:
    """``make_model`` replaces the endpoint, for other models and for tests.

    Hashes are resolved first, and only commits without a finished report are read and asked about.
    """
    s = _settings(argv)
    args = analyze_options(argv, s)
    git.check_work_tree(args.linux_dir)
    listed = hashlist.read_hash_list(spark, str(args.hashes_file))
    context = files.read_context(args.context_md)
    chosen = written(hashlist.index_slice(listed, args.start_index, args.end_index), "chosen")
    if chosen.isEmpty():
        print("no commits in the slice; no model was called")
        return 0
    resolved = git.resolve_in_repository(chosen, "requested_hash", str(args.linux_dir)).withColumnRenamed("requested_hash", "__asked")
    named = chosen.join(resolved, F.lower("requested_hash") == F.col("__asked"), "left").drop("__asked")
    named = written(named.withColumn("canonical_hash", X.given(F.col("canonical_hash"))), "named")
    pending, reused, failed = resume.split_work(named, files.read_reports(spark, str(args.outdir)), args.force)
    pending, reused = written(pending, "pending"), written(reused, "reused")
    counts = resume.work_counts(pending, reused, failed).first()
    print(f"selected {counts['selected']}, reused {counts['reused']}, unresolved {counts['failed']}, to be asked about {counts['pending']}")
    analysed = spark.createDataFrame([], _RESULT)
    made_at = datetime.now().astimezone().isoformat(timespec="seconds")
    if counts["pending"]:  # the key is asked for only if there is something to do
        if make_model is None:
            key = C.api_key(args.api_key, args.api_key_file)
            url = C.setting(args.base_url, "OPENAI_BASE_URL", s.openai.base_url or "")
            model = C.setting(args.model, "OPENAI_MODEL", s.openai.model or "")
            if not url or not model:
                raise C.SettingsError("base_url and model are needed")
            make_model = partial(_endpoint, url, key, model, args.max_tokens)
        todo = resume.once_per_commit(pending).select("input_index", F.col("canonical_hash").alias("requested_hash"))
        commits = git.read_commits(todo, str(args.linux_dir), args.max_diff_chars, True, args.workers)
        evidence = files.read_text_files(spark, str(args.evidence_dir)) if args.evidence_dir else None
        args.outdir.mkdir(parents=True, exist_ok=True)
        analysed = written(analysis.analyse(resume.with_evidence(commits, evidence), make_model, context, args.workers, str(args.outdir), made_at, True), "analysed")
    results = written(resume.in_input_order(named, analysed, reused, failed), "results")
    # answers are reports already; what could not even be resolved gets its report here
    fields = [F.col(c) for c in ("hash", "subject", "author", "date", "analysis", "error")]
    rendered = results.join(failed.select("input_index"), "input_index", "left_semi").dropDuplicates(["hash"])
    files.write_reports(rendered.select(X.report_name(F.col("hash")).alias("name"), X.render_report(*fields, F.lit(made_at)).alias("content")), args.outdir)
    lines = results.orderBy("input_index").select(X.render_index_line(F.col("hash"), F.col("subject"), F.col("error")).alias("line"))
    files.write_atomically(args.outdir / "index.md", ["# Index of analysed commits\n\n", *(f"{r[0]}\n" for r in lines.toLocalIterator())])
    counts = resume.result_counts(results).first()
    print(f"results {counts['total']}, failures {counts['failures']}; {args.outdir / 'index.md'}")
    return int(counts["exit_code"])


STAGES = {"extract": extract, "filter": filter_, "analyze": analyze}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **more) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in STAGES:
        print(f"usage: millrace {'|'.join(STAGES)} ...", file=sys.stderr)
        return 2
    spark = spark or local_session()
    try:
        return STAGES[argv[0]](spark, argv[1:], **more)
    except _ERRORS as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        clear_work(spark)


def extract_main() -> int:
    return main(["extract", *sys.argv[1:]])


def filter_main() -> int:
    return main(["filter", *sys.argv[1:]])


def analyze_main() -> int:
    return main(["analyze", *sys.argv[1:]])


if __name__ == "__main__":
    sys.exit(main())
