"""Schemas of the entities and the codes that stand for statuses and reasons."""

from __future__ import annotations

COMMIT = (
    "requested_hash string, hash string, subject string, author string, date string, body string, "
    "files array<string>, diff string, diff_truncated boolean, original_diff_chars int"
)
MESSAGE = "epoch int, seq bigint, storage_commit string, raw_message binary"
MAIL = "message_id string, subject string, date string, body string"
MATCHES = "array<struct<pattern: string, fields: array<string>>>"
FIX = (
    "struct<reported_hash: string, versions: array<string>, sources: array<string>, in_linux_repo: boolean, "
    "canonical_hash: string, selected: boolean, emitted: boolean>"
)
RESULT = "requested_hash string, hash string, subject string, author string, date string, analysis string, error string"

# Statuses of decisions and of mails, and the fields that rules may search, in order.
SELECTED, EXCLUDED, NOT_MATCHED, ERROR = "selected", "excluded", "not_matched", "error"
IGNORED, NO_FIXES, UNRESOLVED = "ignored", "no-fixes", "unresolved"
FIELDS = ("subject", "body", "files", "diff")

# Reasons, as codes.
EXCLUDE_HIT, INCLUDE_HIT, NO_INCLUDE = "exclude_hit", "include_hit", "no_include_rule"
NO_INCLUDE_HIT, NOT_ALL_INCLUDES, UNREADABLE = "no_include_hit", "not_all_includes_hit", "commit_unreadable"
NO_CVE_ID, NO_FIX_REFERENCE, IN_REPOSITORY = "no_cve_id", "no_fix_reference", "in_repository"
NOT_IN_REPOSITORY, FELL_BACK, ALL_FIXES = "not_in_repository", "fell_back_to_all", "all_fixes"
