"""Queries of the triage operators over the project's tables, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import analysis, hashlist, resume, rules
from millrace.operators import references as R
from millrace.plans import pipeline
from millrace.session import table, written
from millrace.sources.mail import parse_mails

INCLUDE = ("use-after-free", r"double\s+free", "^drivers/", "ring_probe")
EXCLUDE = ("nightly", "_flush")
HOST = "git.tolvane.example"

# --- the tables as the operators take them ----------------------------------------------------


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "commits").withColumn("input_index", F.col("commit_id"))


def _decided(spark: SparkSession, folder: str, include=INCLUDE, exclude=EXCLUDE, fields=("subject", "body", "files"), **more) -> DataFrame:
    return rules.decide(_commits(spark, folder), rules.compile_rules(include, exclude, fields, **more))


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies as announcements write them, made of the fixes of cve_mails."""
    line = lambda f, v: F.concat(F.lit("\tIssue seen since 6.0 and Fixed in\t"), v, F.lit(" with commit "), f["reported_hash"])
    short = lambda f: F.concat(F.lit(f"\thttps://{HOST}/stable/c/"), F.upper(f["reported_hash"]))
    by_id = lambda f: F.concat(F.lit(f"\thttps://{HOST}/tree/x?h=master&id=12345678&id="), f["reported_hash"])
    each = lambda f: F.concat(F.transform(f["versions"], lambda v: line(f, v)), F.array(short(f), by_id(f)))
    body = F.array_join(F.flatten(F.transform(F.coalesce("fixes", F.array().cast("array<struct<reported_hash:string,versions:array<string>>>")), each)), "\n")
    mails = table(spark, folder, "cve_mails")
    fixes = F.expr("transform(fixes, f -> named_struct('reported_hash', f.reported_hash, 'versions', f.versions))")
    return mails.withColumn("fixes", fixes).select("mail_id", body.alias("body"))


def _mails(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cve_mails").select("mail_id", "epoch", "seq", "message_id", "storage_commit", "cve_ids", "fixes")


def _fixes(mails: DataFrame) -> DataFrame:
    return mails.select("mail_id", F.posexplode("fixes").alias("fix_idx", "f")).select("mail_id", "fix_idx", F.lower("f.reported_hash").alias("reported_hash"), "f.versions", "f.sources")


def _chosen(spark: SparkSession, folder: str, prefer_known: bool = True, fall_back: bool = False) -> tuple[DataFrame, DataFrame]:
    mails = _mails(spark, folder)
    fixes = _fixes(mails)
    resolved = R.resolve(fixes, "reported_hash", table(spark, folder, "commits")) if prefer_known else None
    return R.select_fixes(mails.drop("fixes"), R.attach(fixes, resolved), "mail_id", ["epoch", "seq"], prefer_known, fall_back)


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of every analysis result, with a fixed time; those of hashes that begin with 0 have no marks."""
    results = table(spark, folder, "analysis_results")
    made = X.render_report(*[F.col(c) for c in ("hash", "subject", "author", "date", "analysis", "error")], F.lit("2024-01-01T00:00:00+00:00"))
    plain = F.regexp_replace(made, "^<!--[^\n]*-->\n", "")
    return results.select("hash", "subject", "error", F.when(F.col("hash").startswith("0"), plain).otherwise(made).alias("content"))


# --- queries ----------------------------------------------------------------------------------


def commit_subject_body(spark, folder):
    docs = table(spark, folder, "documents")
    body = X.body_of(F.col("text"))
    return docs.select("doc_id", X.subject_of(F.col("text")).alias("subject"), F.length(body).cast("bigint").alias("body_chars"), F.md5(body).alias("body_md5"))


def commit_file_list(spark, folder):
    listed = table(spark, folder, "commits").select("commit_id", F.posexplode("files").alias("pos", "path"))
    return listed.select("commit_id", F.col("pos").cast("bigint").alias("pos"), "path")


def hash_lines_valid(spark, folder):
    asked = table(spark, folder, "commits")
    return asked.select("commit_id", X.is_hash(F.col("requested_hash")).alias("is_valid"), F.lower("requested_hash").alias("identity"))


def hash_dedup_first(spark, folder):
    asked = table(spark, folder, "commits").select("commit_id", "requested_hash")
    return hashlist.first_of_each(asked, F.lower("requested_hash"), [F.col("commit_id")])


def hash_slice(spark, folder):
    indexed = hashlist.dense_index(hash_dedup_first(spark, folder), ["commit_id"], "input_index")
    return hashlist.index_slice(indexed, 10, 60).select("input_index", "requested_hash")


def hash_tokens(spark, folder):
    tokens = hashlist.token_lines(table(spark, folder, "documents").where("doc_id is not null").select(F.lit("﻿# list\n").alias("head"), "text").select(F.concat("head", X.given(F.col("text"))).alias("text")), "text")
    return tokens.groupBy(X.is_hash(F.col("token")).alias("is_valid")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).alias("chars"))


def _truncate(limit: int):
    def query(spark, folder):
        text, cut = X.truncated(F.col("diff"), limit)
        return table(spark, folder, "commits").select("commit_id", cut.alias("cut"), F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("text_md5"))

    return query


def _filter(*columns: str, **how):
    return lambda spark, folder: _decided(spark, folder, **how).select(*columns)


def filter_case_sensitive(spark, folder):
    both = [_decided(spark, folder, ("NULL", "keep"), (), case_sensitive=c).where("status = 'selected'").select(F.lit(c).alias("exact")) for c in (False, True)]
    return both[0].unionAll(both[1]).groupBy("exact").agg(F.count(F.lit(1)).alias("n"))


def filter_match_audit(spark, folder):
    found = _decided(spark, folder, fields=("diff", "files", "subject", "body"))
    side = lambda name: F.transform(f"{name}_matches", lambda m, i: F.struct(F.lit(name).alias("side"), i.cast("bigint").alias("no"), m["pattern"].alias("pattern"), F.array_join(m["fields"], ",").alias("fields")))
    return found.select("input_index", F.explode(F.concat(side("include"), side("exclude"))).alias("m")).select("input_index", "m.*")


def filter_python_pattern(spark, folder):
    # a conditional group exists in Python only, so this rule takes the Arrow path
    return _decided(spark, folder, (r"(ring)?_(?(1)probe|alloc)",), (), ("subject",)).select("input_index", "status")


def filter_selected_hashes(spark, folder):
    return _decided(spark, folder).where("status = 'selected'").select("input_index", "hash")


def filter_summary(spark, folder):
    return rules.summary(_decided(spark, folder))


def error_rows_isolated(spark, folder):
    failed = table(spark, folder, "filter_decisions").where("status = 'error'").select(F.lower("requested_hash").alias("h")).distinct()
    commits = _commits(spark, folder).join(failed, F.lower("requested_hash") == F.col("h"), "left")
    commits = commits.withColumn("error", F.when(F.col("h").isNotNull(), F.lit("unreadable")).otherwise(""))
    return rules.decide(commits, rules.compile_rules(INCLUDE, EXCLUDE, ("subject",))).select("input_index", "hash", "subject", "status", "reason", "error")


def ids_extract_distinct(spark, folder):
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", F.posexplode(X.cve_ids(F.lit(""), F.col("text"))).alias("pos", "id"))
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "id")


def fixed_line_pairs(spark, folder):
    found = _bodies(spark, folder).select("mail_id", F.posexplode(X.fixed_lines(F.col("body"))).alias("pos", "p"))
    return found.select("mail_id", F.col("pos").cast("bigint").alias("pos"), F.col("p.version").alias("version"), F.col("p.hash").alias("hash"))


def url_refs(spark, folder):
    found = R.extracted(_bodies(spark, folder), "mail_id", host=HOST).where("kind > 0")
    return found.select("mail_id", F.col("kind").cast("bigint").alias("kind"), F.col("pos").cast("bigint").alias("pos"), "hash")


def refs_merged(spark, folder):
    found = R.merged(R.extracted(_bodies(spark, folder), "mail_id", host=HOST), "mail_id")
    return found.select("mail_id", F.col("fix_idx").cast("bigint").alias("fix_idx"), "reported_hash", F.array_join("versions", ",").alias("versions"), F.array_join("sources", ",").alias("sources"))


def refs_merged_in_row(spark, folder):
    found = _bodies(spark, folder).select("mail_id", F.posexplode(R.merged_in_row(F.col("body"), HOST)).alias("fix_idx", "f"))
    return found.select("mail_id", F.col("fix_idx").cast("bigint").alias("fix_idx"), "f.reported_hash", F.array_join("f.versions", ",").alias("versions"), F.array_join("f.sources", ",").alias("sources"))


def mail_dedup(spark, folder):
    return pipeline.first_mails(_mails(spark, folder)).select("mail_id")


def permalink(spark, folder):
    return table(spark, folder, "cve_mails").select("mail_id", X.permalink(F.col("message_id")).alias("link"))


def resolve_exact(spark, folder):
    fixes = _fixes(_mails(spark, folder)).where(F.length("reported_hash") == 40)
    found = R.attach(fixes, R.resolve(fixes, "reported_hash", table(spark, folder, "commits")))
    return found.select("mail_id", F.col("fix_idx").cast("bigint").alias("fix_idx"), "canonical_hash", F.col("in_linux_repo").alias("known"))


def resolve_prefix(spark, folder):
    commits = table(spark, folder, "commits")
    asked = commits.select(F.left("requested_hash", F.lit(5)).alias("ref")).union(commits.select("requested_hash"))
    return R.resolve(asked, "ref", commits)


def _select(prefer_known: bool, fall_back: bool):
    return lambda spark, folder: _chosen(spark, folder, prefer_known, fall_back)[0].select("mail_id", "status", "reason")


def emit_once(spark, folder):
    found = _chosen(spark, folder)[1]
    return found.select("mail_id", F.col("fix_idx").cast("bigint").alias("fix_idx"), "output_hash", "selected", "emitted")


def candidate_list(spark, folder):
    mails, fixes = _chosen(spark, folder)
    placed = fixes.where("emitted").join(mails.select("mail_id", "epoch", "seq"), "mail_id")
    return hashlist.dense_index(placed.select("epoch", "seq", "fix_idx", "output_hash"), ["epoch", "seq", "fix_idx"], "place").select("place", "output_hash")


def select_summary(spark, folder):
    return _chosen(spark, folder)[0].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def flat_audit(nested: DataFrame) -> DataFrame:
    one = F.transform("fixes", lambda f: F.concat_ws(":", f["reported_hash"], f["canonical_hash"], f["selected"].cast("string"), f["emitted"].cast("string")))
    return nested.select("mail_id", "status", "reason", F.array_join(one, ",").alias("fixes"))


def mail_audit_flat(spark, folder):
    mails, fixes = _chosen(spark, folder)
    return flat_audit(R.audit(mails, fixes, "mail_id"))


def side_files(spark, folder) -> DataFrame:
    """(name, content): a text file for each analysis, and a Markdown file, which comes first, for each failure."""
    results = table(spark, folder, "analysis_results")
    side = results.select(F.concat("hash", F.lit(".txt")).alias("name"), X.given(F.col("analysis")).alias("content"))
    return side.unionAll(results.where("error <> ''").select(F.concat("hash", F.lit(".md")), "error"))


def evidence_join(spark, folder):
    found = resume.with_evidence(table(spark, folder, "commits").select("commit_id", "hash"), side_files(spark, folder))
    return found.select("commit_id", F.md5("evidence").alias("evidence_md5"))


def prompt_build(spark, folder):
    commits = table(spark, folder, "commits").withColumn("evidence", F.lit(" ")).select("commit_id", analysis.prompt("Context.").alias("p"))
    return commits.select("commit_id", F.length("p").cast("bigint").alias("chars"), F.md5("p").alias("prompt_md5"))


def retryable_class(spark, folder):
    results = table(spark, folder, "analysis_results")
    status = F.expr("try_cast(regexp_extract(error, '^HTTP ([0-9]+)$', 1) as int)")
    return results.select("hash", X.is_retryable(status, F.col("error")).alias("with_status"), X.is_retryable(F.lit(None).cast("int"), F.col("error")).alias("without"))


def _named(spark, folder):
    commits = table(spark, folder, "commits")
    return commits.select(F.col("commit_id").alias("input_index"), "requested_hash", F.when(F.col("subject").like("%drop%"), F.lit("")).otherwise(F.col("hash")).alias("canonical_hash"))


def resume_pending(spark, folder):
    pending, reused, failed = resume.split_work(_named(spark, folder), _reports(spark, folder))
    parts = [(pending, "pending"), (reused, "reused"), (failed, "failed")]
    out = [p.select("input_index", F.lit(n).alias("part")) for p, n in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


def resume_counts(spark, folder):
    return resume.work_counts(*resume.split_work(_named(spark, folder), _reports(spark, folder)))


def ordered_results(spark, folder):
    named = _named(spark, folder)
    pending, reused, failed = resume.split_work(named, _reports(spark, folder))
    made = resume.once_per_commit(pending).select(
        "input_index", "requested_hash", F.col("canonical_hash").alias("hash"), F.lit("s").alias("subject"), F.lit("").alias("author"), F.lit("").alias("date"), F.lit("a").alias("analysis"), F.lit("").alias("error")
    )
    return resume.in_input_order(named, made, reused, failed).select("input_index", "requested_hash", "hash", "analysis", "error")


def report_status_parse(spark, folder):
    reports = _reports(spark, folder)
    variants = reports.select("hash", F.explode(F.array(F.col("content"), F.concat("content", F.lit(X.FAILURE_MARK)), F.regexp_replace("content", "^<!--[^\n]*-->\n", ""), F.lit(""))).alias("c"))
    return variants.select("hash", F.md5("c").alias("report_md5"), X.is_finished(F.col("c")).alias("finished")).distinct()


def report_render(spark, folder):
    return _reports(spark, folder).select("hash", F.md5("content").alias("report_md5"))


def index_lines(spark, folder):
    results = table(spark, folder, "analysis_results")
    return results.select("hash", X.render_index_line(F.col("hash"), F.col("subject"), F.col("error")).alias("line"))


def report_subject_readback(spark, folder):
    return _reports(spark, folder).select("hash", X.subject_in_report(F.col("content")).alias("subject"))


def mail_parse(spark, folder):
    return parse_mails(table(spark, folder, "inbox_messages"))


def mail_fields(spark, folder):
    """Identifier, subject and what the body names, of every raw mail."""
    parsed = parse_mails(table(spark, folder, "inbox_messages"))
    hashes = F.array_sort(R.merged_in_row(F.col("body"), HOST)["reported_hash"])
    return parsed.select("mail_id", "message_id", "subject", F.array_join(F.array_sort(X.cve_ids(F.col("subject"), F.col("body"))), ",").alias("ids"), F.array_join(hashes, ",").alias("hashes"))


def pipeline_audit(spark, folder):
    """Raw mails to their audit: parse, keep once, extract, merge, resolve, select; places within a mail left out."""
    found = pipeline.extract(table(spark, folder, "inbox_messages"), table(spark, folder, "commits"), host=HOST)
    one = F.transform("fixes", lambda f: F.concat_ws(":", f["reported_hash"], f["canonical_hash"], f["selected"].cast("string")))
    return found.mails.select("epoch", "seq", "status", "reason", F.array_join(F.array_sort(one), ",").alias("fixes"), F.size(F.filter("fixes", lambda f: f["emitted"])).cast("bigint").alias("emitted"))


def pipeline_lines(spark, folder):
    """The lines of the index that raw mails lead to, in no order."""
    return pipeline_end_to_end(spark, folder).select("hash", "line")


def pipeline_end_to_end(spark, folder):
    """Raw mails to selected commits: parse, keep once, extract, merge, resolve, select, emit, filter, index."""
    commits = table(spark, folder, "commits")
    found = pipeline.extract(table(spark, folder, "inbox_messages"), commits, host=HOST)
    read = commits.select("commit_id", "hash", "subject", "body", "files", "diff_truncated", "original_diff_chars")
    loads = hashlist.first_of_each(read, F.col("hash"), [F.col("commit_id")])
    # the index is made of the candidates alone, so it is a number beside them before commits are joined
    joined = pipeline.numbered(found.candidates).join(loads, F.col("requested_hash") == F.col("hash"))
    kept = rules.decide(joined, rules.compile_rules((), EXCLUDE, ("subject", "body", "files"))).where("status = 'selected'")
    return kept.select("input_index", "hash", X.render_index_line(F.col("hash"), F.col("subject"), F.lit("")).alias("line"))


QUERIES = {
    "commit_subject_body": commit_subject_body,
    "commit_file_list": commit_file_list,
    "hash_lines_valid": hash_lines_valid,
    "hash_dedup_first": hash_dedup_first,
    "hash_slice": hash_slice,
    "hash_tokens": hash_tokens,
    "diff_truncate_200": _truncate(200),
    "diff_truncate_9": _truncate(9),
    "diff_truncate_off": _truncate(0),
    "filter_any": _filter("input_index", "status"),
    "filter_all": _filter("input_index", "status", "reason", include=("ring", "lock", "index"), exclude=(), match="all"),
    "filter_exclude_priority": _filter("input_index", "status", include=("lock",), exclude=("lock.*list", "ring")),
    "filter_no_include": _filter("input_index", "status", "reason", include=()),
    "filter_case_sensitive": filter_case_sensitive,
    "filter_files_anchor": _filter("input_index", "status", include=("^drivers/(net|usb)/", r"\.h$"), exclude=(), fields=("files",)),
    "filter_diff_field": _filter("input_index", "status", include=(r"^\+\+\+ b/drivers", "spin_lock"), exclude=(), fields=("diff",)),
    "filter_match_audit": filter_match_audit,
    "filter_reason": _filter("input_index", "reason"),
    "filter_python_pattern": filter_python_pattern,
    "filter_selected_hashes": filter_selected_hashes,
    "filter_summary": filter_summary,
    "error_rows_isolated": error_rows_isolated,
    "ids_extract_distinct": ids_extract_distinct,
    "fixed_line_pairs": fixed_line_pairs,
    "url_refs": url_refs,
    "refs_merged": refs_merged,
    "refs_merged_in_row": refs_merged_in_row,
    "mail_dedup": mail_dedup,
    "permalink": permalink,
    "resolve_exact": resolve_exact,
    "resolve_prefix": resolve_prefix,
    "select_mainline": _select(True, False),
    "select_fallback": _select(True, True),
    "select_all": _select(False, False),
    "emit_once": emit_once,
    "candidate_list": candidate_list,
    "select_summary": select_summary,
    "mail_audit_flat": mail_audit_flat,
    "evidence_join": evidence_join,
    "prompt_build": prompt_build,
    "retryable_class": retryable_class,
    "resume_pending": resume_pending,
    "resume_counts": resume_counts,
    "ordered_results": ordered_results,
    "report_status_parse": report_status_parse,
    "report_render": report_render,
    "index_lines": index_lines,
    "report_subject_readback": report_subject_readback,
    "mail_parse": mail_parse,
    "mail_fields": mail_fields,
    "pipeline_audit": pipeline_audit,
    "pipeline_lines": pipeline_lines,
    "pipeline_end_to_end": pipeline_end_to_end,
}
