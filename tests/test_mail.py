import codecs
import email.policy
from email import message_from_bytes

from millrace.sources.mail import parse_mail, parse_mails


def by_the_standard_library(raw):
    """(message id, subject, body) as the standard library's default policy reads a mail."""
    if raw.startswith(b"From "):
        raw = raw.partition(b"\n")[2]
    message = message_from_bytes(raw, policy=email.policy.default)
    text = lambda part: (part.get_payload(decode=True) or b"").decode(known(part.get_content_charset()), "replace")
    if message.is_multipart():
        parts = [p for p in message.walk() if p.get_content_type() == "text/plain" and p.get_content_disposition() != "attachment"]
    else:
        parts = [message]
    return str(message["message-id"] or ""), str(message["subject"] or ""), "\n".join(map(text, parts))


def known(charset):
    try:
        codecs.lookup(charset or "ascii")
        return charset or "ascii"
    except LookupError:
        return "utf-8"


def test_the_corpus_reads_as_by_the_standard_library(spark, data):
    rows = spark.read.parquet(f"{data}/inbox_messages.parquet").select("mail_id", "raw_message").collect()
    got = {r.mail_id: (r.message_id, r.subject, r.body) for r in parse_mails(spark.read.parquet(f"{data}/inbox_messages.parquet")).collect()}
    assert len(rows) == len(got) > 50
    for r in rows:
        want = by_the_standard_library(bytes(r.raw_message or b""))
        assert got[r.mail_id][0] == want[0].strip() and got[r.mail_id][2] == want[2].encode("utf-8", "replace").decode(), r.mail_id
        assert got[r.mail_id][1].split() == want[1].split(), r.mail_id


def test_odd_mails():
    mails = [
        b"", None, b"no header", b"Subject: =?utf-8?q?caf=C3=A9?= =?utf-8?q?_x?=\n\n", b"SUBJECT: a\nSubject: b\n\nbody", b"Subject: long\n line\n\nx",
        b"Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\none\n--b\nContent-Type: text/html\n\n<p>\n--b\nContent-Type: text/plain\nContent-Disposition: attachment\n\nno\n--b\nContent-Type: text/plain; charset=latin-1\n\n\xe9\n--b--\n",
        b"Content-Type: text/html\n\n<b>\xc3\xa9</b>", b"Content-Type: text/plain; charset=klingon\n\n\xc3\xa9", b"Content-Transfer-Encoding: base64\n\nw6k=\n", b"From a@b Mon\nMessage-ID:  <x@y> \n\n",
    ]
    got = [parse_mail(m) for m in mails]
    assert [g[3] for g in got] == ["", "", "no header", "", "body", "x", "one\né", "<b>\ufffd\ufffd</b>", "é", "\ufffd\ufffd", ""]
    assert [g[1] for g in got][3:6] == ["café x", "a", "long line"] and got[10][0] == "<x@y>"
