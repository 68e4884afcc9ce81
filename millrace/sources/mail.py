"""Parsing raw mails in partitions: headers, and the text of the body."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header
from email.message import Message
from email.utils import format_datetime, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLD = re.compile(r"[\r\n]+")


def _decoded(data: bytes, charset: str | None, other: str = "ascii") -> str:
    """``data`` in its charset, or as UTF-8 if that is unknown; what cannot be decoded is replaced."""
    try:
        return data.decode(charset or other, "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def _content(part: Message) -> str:
    return _decoded(part.get_payload(decode=True) or b"", part.get_content_charset())


def _header(text: str) -> str:
    """A header's text: unfolded, its encoded words decoded, its raw bytes as UTF-8."""
    text = _FOLD.sub("", text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")).strip()
    if "=?" not in text:
        return text
    try:
        pieces = decode_header(text)
    except Exception:  # noqa: BLE001 - a broken encoded word stays as it stands
        return text
    return "".join(x if isinstance(x, str) else _decoded(x, c, "utf-8") for x, c in pieces)


def _date(text: str) -> str:
    """A Date header in the standard notation if it is a date of that kind, else as it stands."""
    try:
        return format_datetime(parsedate_to_datetime(text))
    except (ValueError, TypeError, IndexError, OverflowError):
        return text


def parse_mail(raw: bytes | None) -> tuple[str, str, str, str]:
    """(message id, subject, date, body) of a raw mail; what is missing is ''.

    A leading mbox line is dropped. The body of a multipart mail is its text/plain parts without
    attachments, joined by line feeds; that of any other mail is its content, whatever its type.
    """
    raw = raw or b""
    if raw.startswith(b"From "):
        raw = raw.partition(b"\n")[2]
    message = message_from_bytes(raw)
    headers: dict[str, str] = {}
    for name, value in message.raw_items():
        headers.setdefault(name.lower(), value)
    if message.is_multipart():
        parts = [p for p in message.walk() if p.get_content_type() == "text/plain" and p.get_content_disposition() != "attachment"]
        body = "\n".join(map(_content, parts))
    else:
        body = _content(message)
    clean = body.encode("utf-8", "replace").decode("utf-8")  # no lone surrogates
    message_id, subject, date = (_header(str(headers.get(h, ""))) for h in ("message-id", "subject", "date"))
    return message_id, subject, _date(date), clean


def parse_mails(messages: DataFrame, raw: str = "raw_message") -> DataFrame:
    """``messages`` without ``raw``, with message_id, subject, date and body; one row per row, columns of those names are replaced."""
    kept = [c for c in messages.columns if c not in (raw, "message_id", "subject", "date", "body")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_mail(x) for x in batch.column(len(kept)).to_pylist()]
            parsed = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *parsed], names=[*kept, "message_id", "subject", "date", "body"])

    ddl = f"{fields}, " if kept else ""
    return messages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{raw}`")).mapInArrow(run, f"{ddl}message_id string, subject string, date string, body string")
