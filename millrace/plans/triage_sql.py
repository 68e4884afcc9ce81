"""SQL of the triage queries for an engine with RE2 expressions and list functions."""

from __future__ import annotations

from millrace.functions import text as X
from millrace.operators.analysis import answer_rules
from millrace.plans.triage import EXCLUDE, HOST, INCLUDE

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _hit(pattern: str, field: str, flags: str = "i") -> str:
    if field == "files":
        return f"coalesce(len(list_filter(coalesce(files, []), lambda x: coalesce(regexp_matches(x, {_quoted(pattern)}, '{flags}'), false))) > 0, false)"
    return f"regexp_matches(coalesce({field}, ''), {_quoted(pattern)}, '{flags}')"


def _any(patterns, fields, flags="i") -> str:
    return "(" + " OR ".join(_hit(p, f, flags) for p in patterns for f in fields) + ")" if patterns else "false"


def _decided(include=INCLUDE, exclude=EXCLUDE, fields=("subject", "body", "files"), match="any", flags="i") -> str:
    each = [_any([p], fields, flags) for p in include]
    inc = "true" if not include else (" AND " if match == "all" else " OR ").join(each)
    kept = "include_hit" if include else "no_include_rule"
    lost = "not_all_includes_hit" if match == "all" else "no_include_hit"
    out = _any(exclude, fields, flags)
    return f"""
        SELECT commit_id AS input_index, coalesce(hash, '') AS hash, coalesce(subject, '') AS subject,
               CASE WHEN {out} THEN 'excluded' WHEN {inc} THEN 'selected' ELSE 'not_matched' END AS status,
               CASE WHEN {out} THEN 'exclude_hit' WHEN {inc} THEN '{kept}' ELSE '{lost}' END AS reason
        FROM commits"""


def _truncate(limit: int) -> str:
    if limit == 0:
        return "SELECT commit_id, false AS cut, CAST(length(coalesce(diff, '')) AS BIGINT) AS chars, md5(coalesce(diff, '')) AS text_md5 FROM commits"
    return f"""
        WITH t AS (SELECT commit_id, coalesce(diff, '') AS d FROM commits),
        m AS (SELECT *, chr(10) || chr(10) || '... [diff cut: ' || length(d) || ' characters originally; both ends kept, limit 0 keeps all] ...' || chr(10) || chr(10) AS mark FROM t),
        r AS (SELECT *, {limit} - length(mark) AS room FROM m),
        k AS (SELECT commit_id, length(d) > {limit} AS cut,
                     CASE WHEN length(d) <= {limit} THEN d WHEN room <= 0 THEN substr(mark, 1, {limit})
                          ELSE substr(d, 1, CAST(floor(room * 2 / 3) AS INT)) || mark || right(d, room - CAST(floor(room * 2 / 3) AS INT)) END AS text FROM r)
        SELECT commit_id, cut, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM k"""


_BODIES = f"""
    bodies AS (SELECT mail_id, coalesce(array_to_string(flatten(list_transform(coalesce(fixes, []), lambda f: list_concat(
        list_transform(f.versions, lambda v: chr(9) || 'Issue seen since 6.0 and Fixed in' || chr(9) || v || ' with commit ' || f.reported_hash),
        [chr(9) || 'https://{HOST}/stable/c/' || upper(f.reported_hash),
         chr(9) || 'https://{HOST}/tree/x?h=master&id=12345678&id=' || f.reported_hash]))), chr(10)), '') AS body FROM cve_mails)"""

_FIXED = r"\bFixed\s+in\s+([^\s,;]+)\s+with\s+commit\s+([0-9a-f]{7,64})\b"
_DOTTED = HOST.replace(".", r"\.")
_SHORT = rf"https?://{_DOTTED}/(?:stable/c/|linus/)([0-9a-f]{{7,64}})\b"
_BY_ID = rf"https?://{_DOTTED}/[^\s]*[?&]id=([0-9a-f]{{7,64}})\b"

_REFERENCES = f"""
    {_BODIES}, found AS (
        SELECT mail_id, 0 AS kind, unnest(range(len(regexp_extract_all(body, '{_FIXED}', 1, 'i')))) AS pos,
               unnest(regexp_extract_all(body, '{_FIXED}', 1, 'i')) AS version, lower(unnest(regexp_extract_all(body, '{_FIXED}', 2, 'i'))) AS hash, 'fixed-line' AS source FROM bodies
        UNION ALL
        SELECT mail_id, 1, unnest(range(len(regexp_extract_all(body, '{_SHORT}', 1, 'i')))), NULL, lower(unnest(regexp_extract_all(body, '{_SHORT}', 1, 'i'))), 'commit-url' FROM bodies
        UNION ALL
        SELECT mail_id, 2, unnest(range(len(regexp_extract_all(body, '{_BY_ID}', 1, 'i')))), NULL, lower(unnest(regexp_extract_all(body, '{_BY_ID}', 1, 'i'))), 'commit-url' FROM bodies)"""


_MERGED = f"""
    WITH {_REFERENCES},
    firsts AS (SELECT mail_id, hash, min({{'k': kind, 'p': pos}}) AS first FROM found GROUP BY mail_id, hash),
    g AS (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY first) - 1 AS fix_idx FROM firsts),
    vs AS (SELECT mail_id, hash, string_agg(version, ',' ORDER BY m) AS versions FROM (
              SELECT mail_id, hash, version, min({{'k': kind, 'p': pos}}) AS m FROM found WHERE version IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    ss AS (SELECT mail_id, hash, string_agg(source, ',' ORDER BY m) AS sources FROM (
              SELECT mail_id, hash, source, min({{'k': kind, 'p': pos}}) AS m FROM found GROUP BY ALL) GROUP BY ALL)
    SELECT g.mail_id, CAST(fix_idx AS BIGINT) AS fix_idx, g.hash AS reported_hash, coalesce(versions, '') AS versions, sources
    FROM g LEFT JOIN vs ON vs.mail_id = g.mail_id AND vs.hash = g.hash JOIN ss ON ss.mail_id = g.mail_id AND ss.hash = g.hash"""

_RESOLVED = r"""
    known AS (SELECT DISTINCT lower(hash) AS hash FROM commits WHERE regexp_full_match(hash, '[0-9a-fA-F]{4,64}')),
    fixes AS (SELECT mail_id, unnest(range(len(fixes))) AS fix_idx, unnest(fixes) AS f FROM cve_mails),
    listed AS (SELECT mail_id, fix_idx, lower(f.reported_hash) AS reported_hash FROM fixes),
    wanted AS (SELECT DISTINCT reported_hash FROM listed),
    found AS (
        SELECT reported_hash, min(hash) AS canonical_hash FROM wanted JOIN known ON starts_with(hash, reported_hash)
        GROUP BY reported_hash HAVING count(*) = 1 OR bool_or(hash = reported_hash)),
    attached AS (SELECT l.*, coalesce(canonical_hash, '') AS canonical_hash FROM listed l LEFT JOIN found USING (reported_hash))"""


def _selected(prefer: bool = True, fall_back: bool = False) -> str:
    if prefer:
        status = f"WHEN known OR {str(fall_back).lower()} THEN 'selected' ELSE 'unresolved'"
        reason = f"WHEN known THEN 'in_repository' ELSE '{'fell_back_to_all' if fall_back else 'not_in_repository'}'"
        chosen = f"(canonical_hash <> '' OR ({str(fall_back).lower()} AND NOT known))"
    else:
        status, reason, chosen = "ELSE 'selected'", "ELSE 'all_fixes'", "true"
    canonical = "canonical_hash" if prefer else "''"
    return f"""{_RESOLVED},
    per AS (SELECT mail_id, count(*) AS n, bool_or(canonical_hash <> '') AS known FROM attached GROUP BY mail_id),
    state AS (SELECT m.mail_id, epoch, seq, coalesce(known, false) AS known, coalesce(n, 0) AS n, coalesce(len(cve_ids), 0) AS ids FROM cve_mails m LEFT JOIN per USING (mail_id)),
    decided AS (SELECT *, CASE WHEN ids = 0 THEN 'ignored' WHEN n = 0 THEN 'no-fixes' {status} END AS status,
                       CASE WHEN ids = 0 THEN 'no_cve_id' WHEN n = 0 THEN 'no_fix_reference' {reason} END AS reason FROM state),
    marked AS (SELECT a.mail_id, fix_idx, reported_hash, {canonical} AS canonical_hash, epoch, seq, status = 'selected' AND {chosen} AS selected,
                      CASE WHEN {canonical} <> '' THEN {canonical} ELSE reported_hash END AS output_hash FROM attached a JOIN decided USING (mail_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY output_hash, selected ORDER BY epoch, seq, fix_idx) AS place FROM marked),
    emitted AS (SELECT *, selected AND place = 1 AS emitted FROM placed)"""


_REPORTS = f"""
    made AS (SELECT hash, subject, error, '{X.SUCCESS_MARK}' AS ok, '{X.FAILURE_MARK}' AS bad,
        chr(10) || '# ' || hash || chr(10) || chr(10) || '- **Author**: ' || coalesce(author, '') || chr(10) || '- **Date**: ' || coalesce(date, '') || chr(10)
        || '{X.TITLE_BULLET} ' || coalesce(subject, '') || chr(10) || chr(10) || '{X.ANALYSIS_HEADING}' || chr(10) || chr(10)
        || CASE WHEN coalesce(error, '') <> '' THEN 'Processing failed: ' || error ELSE coalesce(analysis, '') END
        || chr(10) || chr(10) || '---' || chr(10) || '*Made: 2024-01-01T00:00:00+00:00*' || chr(10) AS rest FROM analysis_results),
    reports AS (SELECT hash, subject, error, substr(rest, 2) AS plain,
        CASE WHEN starts_with(hash, '0') THEN substr(rest, 2) WHEN coalesce(error, '') <> '' THEN bad || rest ELSE ok || rest END AS content FROM made)"""


def _finished(c: str) -> str:
    after = f"substr({c}, position('{X.ANALYSIS_HEADING}' IN {c}) + {len(X.ANALYSIS_HEADING)})"
    before_rule = f"split_part({after}, chr(10) || chr(10) || '---', 1)"
    old = (
        f"position('{X.ANALYSIS_HEADING}' IN {c}) > 0 AND position('call failed' IN {c}) = 0 AND position('processing error' IN {c}) = 0"
        f" AND {_strip(before_rule)} <> ''"
    )
    return f"CASE WHEN position('{X.FAILURE_MARK}' IN {c}) > 0 THEN false WHEN position('{X.SUCCESS_MARK}' IN {c}) > 0 THEN true ELSE ({old}) END"


_NAMED = "named AS (SELECT commit_id AS input_index, requested_hash, CASE WHEN subject LIKE '%drop%' THEN '' ELSE hash END AS canonical_hash FROM commits)"
_SPLIT = f"""{_REPORTS}, {_NAMED},
    done AS (SELECT DISTINCT lower(hash) AS h FROM reports WHERE {_finished('content')}),
    parts AS (SELECT n.*, CASE WHEN coalesce(canonical_hash, '') = '' THEN 'failed' WHEN h IS NOT NULL THEN 'reused' ELSE 'pending' END AS part
              FROM named n LEFT JOIN done ON lower(canonical_hash) = h)"""


def _prompt(hash_: str = "coalesce(hash, '')") -> str:
    q = _quoted
    paths = "coalesce(array_to_string(list_filter(files, lambda x: x IS NOT NULL), chr(10)), '')"
    parts = [
        q("<study>\nContext.\n</study>\n\n"),
        *(x for label, f in (("commit", "hash"), ("title", "subject"), ("by", "author"), ("on", "date")) for x in (q(f"{label}: "), hash_ if f == "hash" else f"coalesce({f}, '')", "chr(10)")),
        "CASE WHEN coalesce(diff_truncated, false) THEN 'The patch below was shortened from ' || coalesce(original_diff_chars, 0)"
        " || ' characters: say what may be hidden by that, and be less sure.' || chr(10) ELSE '' END",
        q("\n<message>\n"), "CASE WHEN coalesce(body, '') = '' THEN 'There is no message beyond the title.' ELSE body END",
        q("\n</message>\n\n<paths>\n"), f"CASE WHEN {paths} = '' THEN 'The commit changes no files.' ELSE {paths} END",
        q("\n</paths>\n\n<patch>\n"), "CASE WHEN coalesce(diff, '') = '' THEN 'No textual patch; the change may be binary.' ELSE diff END",
        q("\n</patch>\n\n<notes>\nNone. Reports, discussions and manuals have not been seen and must not be cited.\n</notes>\n\n" + answer_rules()),
    ]
    return f"SELECT commit_id, CAST(length(p) AS BIGINT) AS chars, md5(p) AS prompt_md5 FROM (SELECT commit_id, {' || '.join(parts)} AS p FROM commits)"


_FIELD_ORDER = ("subject", "body", "files", "diff")


def _audit(order=_FIELD_ORDER) -> str:
    rows = []
    for side, patterns in (("include", INCLUDE), ("exclude", EXCLUDE)):
        for n, p in enumerate(patterns):
            fields = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_hit(p, f)} THEN '{f}' END" for f in order) + "], lambda x: x IS NOT NULL), ',')"
            rows.append(f"SELECT commit_id AS input_index, '{side}' AS side, {n} AS rule, {_quoted(p)} AS pattern, {fields} AS fields FROM commits")
    return f"""SELECT input_index, side, CAST(row_number() OVER (PARTITION BY input_index, side ORDER BY rule) - 1 AS BIGINT) AS no, pattern, fields
        FROM ({' UNION ALL '.join(rows)}) WHERE fields <> ''"""


_NEW_DRIVER_FILE, _HEADER_FILE = r"^\+\+\+ b/drivers", r"\.h$"
_FIRST_SET = "coalesce(nullif(author, ''), nullif(date, ''), 'default')"
_STRIPPED_DOC = _strip("text")
_FIRST = "SELECT commit_id, requested_hash FROM (SELECT *, row_number() OVER (PARTITION BY lower(requested_hash) ORDER BY commit_id) AS place FROM commits) WHERE place = 1"

SQL = {
    "commit_subject_body": f"""
        WITH s AS (SELECT doc_id, {_STRIPPED_DOC} AS t FROM documents),
        l AS (SELECT doc_id, regexp_split_to_array(t, '{_LINE_END}') AS parts FROM s),
        b AS (SELECT doc_id, {_strip('parts[1]')} AS subject, {_strip('array_to_string(parts[2:], chr(10))')} AS body FROM l)
        SELECT doc_id, subject, CAST(length(body) AS BIGINT) AS body_chars, md5(body) AS body_md5 FROM b""",
    "commit_file_list": "SELECT commit_id, CAST(unnest(range(len(files))) AS BIGINT) AS pos, unnest(files) AS path FROM commits",
    "hash_lines_valid": "SELECT commit_id, regexp_full_match(coalesce(requested_hash, ''), '[0-9a-fA-F]{4,64}') AS is_valid, lower(requested_hash) AS identity FROM commits",
    "hash_dedup_first": _FIRST,
    "hash_slice": f"SELECT input_index, requested_hash FROM (SELECT CAST(row_number() OVER (ORDER BY commit_id) - 1 AS BIGINT) AS input_index, requested_hash FROM ({_FIRST})) WHERE input_index >= 10 AND input_index < 60",
    "hash_tokens": f"""
        WITH l AS (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '{_LINE_END}')) AS line FROM documents WHERE doc_id IS NOT NULL),
        t AS (SELECT {_strip('line')} AS token FROM l)
        SELECT regexp_full_match(token, '[0-9a-fA-F]{{4,64}}') AS is_valid, count(*) AS n, CAST(sum(length(token)) AS BIGINT) AS chars
        FROM t WHERE token <> '' AND NOT starts_with(token, '#') GROUP BY 1""",
    "diff_truncate_200": _truncate(200),
    "diff_truncate_9": _truncate(9),
    "diff_truncate_off": _truncate(0),
    "filter_any": f"SELECT input_index, status FROM ({_decided()})",
    "filter_all": f"SELECT input_index, status, reason FROM ({_decided(('ring', 'lock', 'index'), (), match='all')})",
    "filter_exclude_priority": f"SELECT input_index, status FROM ({_decided(('lock',), ('lock.*list', 'ring'))})",
    "filter_no_include": f"SELECT input_index, status, reason FROM ({_decided(())})",
    "filter_case_sensitive": f"""SELECT exact, count(*) AS n FROM (
        SELECT false AS exact, status FROM ({_decided(('NULL', 'keep'), ())}) UNION ALL SELECT true, status FROM ({_decided(('NULL', 'keep'), (), flags='c')})) WHERE status = 'selected' GROUP BY 1""",
    "filter_files_anchor": f"SELECT input_index, status FROM ({_decided(('^drivers/(net|usb)/', _HEADER_FILE), (), ('files',))})",
    "filter_diff_field": f"SELECT input_index, status FROM ({_decided((_NEW_DRIVER_FILE, 'spin_lock'), (), ('diff',))})",
    "filter_match_audit": _audit(),
    "filter_reason": f"SELECT input_index, reason FROM ({_decided()})",
    "filter_python_pattern": f"SELECT input_index, status FROM ({_decided(('ring_probe|_alloc',), (), ('subject',))})",
    "filter_selected_hashes": f"SELECT input_index, hash FROM ({_decided()}) WHERE status = 'selected'",
    "filter_summary": f"SELECT count(*) AS total, count(*) FILTER (status = 'selected') AS selected, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS exit_code FROM ({_decided()})",
    "error_rows_isolated": f"""
        WITH failed AS (SELECT DISTINCT lower(requested_hash) AS h FROM filter_decisions WHERE status = 'error')
        SELECT d.input_index, CASE WHEN h IS NULL THEN d.hash ELSE c.requested_hash END AS hash, CASE WHEN h IS NULL THEN d.subject ELSE '' END AS subject,
               CASE WHEN h IS NULL THEN d.status ELSE 'error' END AS status, CASE WHEN h IS NULL THEN d.reason ELSE 'commit_unreadable' END AS reason,
               CASE WHEN h IS NULL THEN '' ELSE 'unreadable' END AS error
        FROM ({_decided(fields=('subject',))}) d JOIN commits c ON c.commit_id = d.input_index LEFT JOIN failed ON lower(c.requested_hash) = h""",
    "ids_extract_distinct": r"""
        WITH f AS (SELECT doc_id, unnest(range(len(ids))) AS place, unnest(ids) AS id FROM (
            SELECT doc_id, list_transform(regexp_extract_all(text, '\bCVE-\d{4}-\d{4,}\b', 0, 'i'), lambda x: upper(x)) AS ids FROM documents)),
        d AS (SELECT doc_id, id, min(place) AS place FROM f GROUP BY ALL)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS BIGINT) AS pos, id FROM d""",
    "fixed_line_pairs": f"WITH {_REFERENCES} SELECT mail_id, CAST(pos AS BIGINT) AS pos, version, hash FROM found WHERE kind = 0",
    "url_refs": f"WITH {_REFERENCES} SELECT mail_id, CAST(kind AS BIGINT) AS kind, CAST(pos AS BIGINT) AS pos, hash FROM found WHERE kind > 0",
    "refs_merged": _MERGED,
    "refs_merged_in_row": _MERGED,
    "mail_dedup": """SELECT mail_id FROM (SELECT mail_id, row_number() OVER (PARTITION BY CASE WHEN coalesce(message_id, '') <> '' THEN lower(message_id)
        ELSE 'git:' || epoch || ':' || storage_commit END ORDER BY epoch, seq) AS place FROM cve_mails) WHERE place = 1""",
    "permalink": f"""
        WITH b AS (SELECT mail_id, regexp_replace(coalesce(message_id, ''), '^[<>]+|[<>]+$', '', 'g') AS bare FROM cve_mails)
        SELECT mail_id, CASE WHEN bare = '' THEN '' ELSE '{X.ARCHIVE_URL}' || replace(replace(url_encode(bare), '%40', '@'), '%2B', '+') END AS link FROM b""",
    "resolve_exact": f"WITH {_RESOLVED} SELECT mail_id, CAST(fix_idx AS BIGINT) AS fix_idx, canonical_hash, canonical_hash <> '' AS known FROM attached WHERE length(reported_hash) = 40",
    "resolve_prefix": r"""
        WITH known AS (SELECT DISTINCT lower(hash) AS hash FROM commits WHERE regexp_full_match(hash, '[0-9a-fA-F]{4,64}')),
        asked AS (SELECT lower(left(requested_hash, 5)) AS ref FROM commits UNION SELECT lower(requested_hash) FROM commits)
        SELECT ref, min(hash) AS canonical_hash FROM asked JOIN known ON starts_with(hash, ref) WHERE regexp_full_match(ref, '[0-9a-f]{4,64}')
        GROUP BY ref HAVING count(*) = 1 OR bool_or(hash = ref)""",
    "select_mainline": f"WITH {_selected()} SELECT mail_id, status, reason FROM decided",
    "select_fallback": f"WITH {_selected(True, True)} SELECT mail_id, status, reason FROM decided",
    "select_all": f"WITH {_selected(False)} SELECT mail_id, status, reason FROM decided",
    "emit_once": f"WITH {_selected()} SELECT mail_id, CAST(fix_idx AS BIGINT) AS fix_idx, output_hash, selected, emitted FROM emitted",
    "candidate_list": f"WITH {_selected()} SELECT CAST(row_number() OVER (ORDER BY epoch, seq, fix_idx) - 1 AS BIGINT) AS place, output_hash FROM emitted WHERE emitted",
    "select_summary": f"WITH {_selected()} SELECT status, count(*) AS n FROM decided GROUP BY 1",
    "mail_audit_flat": f"""WITH {_selected()}, lists AS (SELECT mail_id, string_agg(reported_hash || ':' || canonical_hash || ':' || selected || ':' || emitted, ',' ORDER BY fix_idx) AS fixes FROM emitted GROUP BY 1)
        SELECT mail_id, status, reason, coalesce(fixes, '') AS fixes FROM decided LEFT JOIN lists USING (mail_id)""",
    "evidence_join": "SELECT commit_id, md5(coalesce(CASE WHEN error <> '' THEN error ELSE analysis END, '')) AS evidence_md5 FROM commits LEFT JOIN analysis_results USING (hash)",
    "prompt_build": _prompt(),
    "retryable_class": r"""
        WITH s AS (SELECT hash, TRY_CAST(nullif(regexp_extract(error, '^HTTP ([0-9]+)$', 1), '') AS INT) AS status,
                          regexp_matches(lower(coalesce(error, '')), '429|rate limit|timeout|connection|http 5') AS by_text FROM analysis_results)
        SELECT hash, CASE WHEN status IS NULL THEN by_text ELSE status IN (408, 409, 429) OR status BETWEEN 500 AND 599 END AS with_status, by_text AS without FROM s""",
    "resume_pending": f"WITH {_SPLIT} SELECT input_index, part FROM parts",
    "resume_counts": f"""WITH {_SPLIT}
        SELECT count(*) AS selected, count(*) FILTER (part = 'pending') AS pending, count(*) FILTER (part = 'reused') AS reused, count(*) FILTER (part = 'failed') AS failed FROM parts""",
    "ordered_results": f"""WITH {_SPLIT}
        SELECT input_index, requested_hash, CASE WHEN part = 'failed' THEN requested_hash ELSE canonical_hash END AS hash,
               CASE part WHEN 'failed' THEN '' WHEN 'reused' THEN '{X.REUSED_NOTE}' ELSE 'a' END AS analysis, CASE WHEN part = 'failed' THEN 'no such commit' ELSE '' END AS error FROM parts""",
    "report_status_parse": f"""WITH {_REPORTS}, v AS (SELECT DISTINCT hash, unnest([content, content || '{X.FAILURE_MARK}', plain, '']) AS c FROM reports)
        SELECT hash, md5(c) AS report_md5, {_finished('c')} AS finished FROM v""",
    "report_render": f"WITH {_REPORTS} SELECT hash, md5(content) AS report_md5 FROM reports",
    "index_lines": "SELECT hash, '- [' || hash || '](./' || hash || '.md) - ' || coalesce(subject, '') || CASE WHEN coalesce(error, '') <> '' THEN ' (failed, to be tried again)' ELSE '' END AS line FROM analysis_results",
    "report_subject_readback": f"SELECT hash, {_strip('subject')} AS subject FROM analysis_results",
}

# mails whose parsed fields stand in cve_mails: identifiers stripped, each mail once
_KEPT = f"""
    stripped AS (SELECT * REPLACE ({_strip('message_id')} AS message_id) FROM cve_mails),
    kept_mails AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY CASE WHEN message_id <> '' THEN lower(message_id) ELSE 'git:' || epoch || ':' || storage_commit END ORDER BY epoch, seq) AS copy
        FROM stripped) WHERE copy = 1)"""
_PIPELINE = f"{_KEPT}, {_selected().replace('cve_mails', 'kept_mails')}"
_HASHES = "array_to_string(list_sort(list_distinct(list_transform(coalesce(fixes, []), lambda f: lower(f.reported_hash)))), ',')"
SQL |= {
    "mail_fields": f"""
        SELECT mail_id, {_strip('message_id')} AS message_id, coalesce(subject, '') AS subject,
               array_to_string(list_sort(list_distinct(list_transform(coalesce(cve_ids, []), lambda x: upper(x)))), ',') AS ids, {_HASHES} AS hashes FROM cve_mails""",
    "pipeline_audit": f"""WITH {_PIPELINE},
        lists AS (SELECT mail_id, string_agg(fix, ',' ORDER BY fix) AS fixes, sum(emitted::INT) AS emitted FROM (
            SELECT mail_id, emitted, reported_hash || ':' || canonical_hash || ':' || selected AS fix FROM emitted) GROUP BY 1)
        SELECT d.epoch, d.seq, status, reason, coalesce(fixes, '') AS fixes, CAST(coalesce(emitted, 0) AS BIGINT) AS emitted FROM decided d LEFT JOIN lists USING (mail_id)""",
    "pipeline_lines": f"""WITH {_PIPELINE},
        loads AS (SELECT min(commit_id) AS commit_id, hash FROM commits WHERE hash IS NOT NULL GROUP BY hash),
        rated AS ({_decided((), EXCLUDE)})
        SELECT c.hash, '- [' || c.hash || '](./' || c.hash || '.md) - ' || coalesce(c.subject, '') AS line
        FROM emitted e JOIN loads l ON l.hash = e.output_hash JOIN rated r ON r.input_index = l.commit_id JOIN commits c ON c.commit_id = l.commit_id
        WHERE e.emitted AND r.status = 'selected'""",
}

_GIT_PATHS = "list_sort(list_distinct(list_transform(list_filter(coalesce(files, []), lambda x: coalesce(x, '') <> ''), lambda x: 'p/' || md5(x))))"
_RETRIED = "CASE WHEN status IS NULL THEN by_text ELSE status IN (408, 409, 429) OR status BETWEEN 500 AND 599 END"

# of the queries in plans.repositories
FILE_SQL = {
    "git_commits_read": f"""
        WITH s AS (SELECT *, {_strip("coalesce(subject, '') || chr(10) || chr(10) || coalesce(body, '')")} AS t FROM commits),
        l AS (SELECT *, regexp_split_to_array(t, '{_LINE_END}') AS parts FROM s)
        SELECT commit_id, {_strip('parts[1]')} AS subject, md5({_strip('array_to_string(parts[2:], chr(10))')}) AS body_md5, md5(coalesce(author, '')) AS author,
               strftime(make_timestamp((commit_id % 100000) * 3600000000), '%Y-%m-%d') AS date, array_to_string({_GIT_PATHS}, chr(10)) AS files,
               CAST(len({_GIT_PATHS}) AS BIGINT) AS diffs, true AS same, '' AS error FROM l""",
    "resolve_bulk": """
        SELECT commit_id, unnest(['whole', 'prefix', 'unknown']) AS form, unnest([true, true, false]) AS own FROM commits
        UNION ALL SELECT commit_id, 'tag', true FROM commits WHERE commit_id % 50 = 0""",
    "archive_read": """
        SELECT epoch, seq, raw_md5 FROM (
            SELECT CAST(epoch AS BIGINT) AS epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY seq) - 1 AS BIGINT) AS seq, md5(raw_message) AS raw_md5 FROM inbox_messages
        ) WHERE raw_md5 IS NOT NULL""",
    "sink_hash_list": """
        SELECT CAST(row_number() OVER (ORDER BY commit_id) - 1 AS BIGINT) AS input_index, requested_hash FROM (
            SELECT *, row_number() OVER (PARTITION BY lower(requested_hash) ORDER BY commit_id) AS place
            FROM commits WHERE regexp_full_match(coalesce(requested_hash, ''), '[0-9a-fA-F]{4,64}')
        ) WHERE place = 1""",
    "sink_filter_audit": f"""
        WITH m AS ({_audit(("subject", "body", "files"))}), d AS ({_decided()})
        SELECT d.input_index, status, reason, count(*) FILTER (side = 'include') AS includes, coalesce(string_agg(pattern, ',' ORDER BY no) FILTER (side = 'exclude'), '') AS excludes
        FROM d LEFT JOIN m ON m.input_index = d.input_index GROUP BY ALL""",
    "sink_mail_audit": SQL["mail_audit_flat"],
    "sink_reports": f"WITH {_REPORTS} SELECT hash, md5(content) AS report_md5, {_finished('content')} AS finished FROM reports",
    "sink_index": f"SELECT CAST(row_number() OVER (ORDER BY hash) - 1 AS BIGINT) AS no, line FROM ({SQL['index_lines']})",
    "evidence_files": SQL["evidence_join"],
    "analysed_commits": f"""
        SELECT c.commit_id AS input_index, hash || '-' || c.commit_id AS hash, CASE WHEN refused THEN '{X.FAILED_SUBJECT}' ELSE subject END AS subject,
               CASE WHEN refused THEN '' ELSE prompt_md5 END AS analysis, CASE WHEN refused THEN 'refused' ELSE '' END AS error
        FROM (SELECT *, coalesce(subject, '') LIKE '%drop%' AS refused FROM commits) c
        JOIN ({_prompt("hash || '-' || commit_id")}) p ON p.commit_id = c.commit_id""",
    "retry_loop": f"""
        WITH s AS (SELECT hash, error, TRY_CAST(nullif(regexp_extract(error, '^HTTP ([0-9]+)$', 1), '') AS INT) AS status,
                          regexp_matches(lower(error), '429|rate limit|timeout|connection|http 5') AS by_text FROM analysis_results WHERE error <> '')
        SELECT hash, CAST(CASE WHEN {_RETRIED} THEN 4 ELSE 0 END AS BIGINT) AS retries, CAST(CASE WHEN {_RETRIED} THEN 15 ELSE 0 END AS BIGINT) AS waited, 'no answer: ' || error AS error FROM s""",
    "setting_precedence": f"SELECT commit_id, {_strip(_FIRST_SET)} AS value FROM commits",
}
