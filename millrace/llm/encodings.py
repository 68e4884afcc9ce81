"""Text that was read with the wrong character encoding: finding it and giving it back.

A smoothed character n-gram model is trained on the clean texts of the corpus itself: every task counts the
one- and two-character grams around non-ASCII characters, and the cluster adds the counts up. The model
holds the exact count of every character and of every pair of characters; only if there are more than
``GRAMS`` different pairs are the rarest left to the smoothing, so that the model's size has a bound and
its counts are exact whatever the corpus. Then every run of non-ASCII characters is scored against all
chains "encode as A, decode as B" (up to three in a row), and the likeliest chain is accepted if it beats
the run as it stands by ``MARGIN``.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from email import message_from_bytes
from email.header import decode_header
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import written

GRAMS = 1 << 22  # pairs of characters that a model holds at most (64 MB)
MARGIN = 4.0  # nats of the whole run; validated on held-out clean and damaged texts in the tests
_RUN = re.compile(r"[^\x00-\x7f]+")
_LOSS = "�"
LOST = "lost"  # in place of a chain: characters that were replaced, which no model has to judge


def _characters(name: str) -> str:
    """The 256 characters of a single-byte encoding; bytes it leaves undefined stand for control characters."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


@lru_cache(maxsize=16)
def _map(name: str):
    return codecs.charmap_build("".join(map(chr, range(128))) + _characters(name)[128:])


# control characters that software writes for the bytes of cp1252, as if they were latin-1
_CONTROLS = {b: c for b, c in enumerate(_characters("cp1252")) if 128 <= b < 160}


# Chains: read as the first, written as one of the second.
CHAINS = {
    "cp1252": ("utf-8", "cp1251", "koi8_r", "gb18030"),
    "iso8859_15": ("utf-8", "cp1251", "koi8_r", "gb18030"),
    "cp437": ("utf-8",),
    "cp850": ("utf-8",),
    "mac_roman": ("utf-8",),
    "cp1251": ("utf-8", "koi8_r"),
    "koi8_r": ("utf-8", "cp1251"),
    "cp866": ("utf-8",),
    "cp1250": ("utf-8",),
    "iso8859_2": ("utf-8",),
    "gb18030": ("utf-8",),
}
_ODD = re.compile(r"[\x80-\x9f─-▟-�]")
_LATIN_RUN = re.compile(r"[À-ÖØ-öø-ÿ]{3,}")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]+")
_CASED = re.compile(r"[Ѐ-Я]?[а-џ]+\Z|[Ѐ-Я]\Z")
_CJK = re.compile(r"[　-鿿＀-￯]")


def encode_as(text: str, name: str) -> bytes | None:
    """The bytes that, read as ``name``, give ``text``; null if there are none."""
    if name == "gb18030":
        try:
            return b"\xff".join(part.encode("gb18030") for part in text.split(_LOSS))
        except UnicodeEncodeError:
            return None
    try:
        return codecs.charmap_encode(text.translate(_CONTROLS) if name == "cp1252" else text, "strict", _map(name))[0]
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except UnicodeDecodeError as e:
        if name != "utf-8":
            return None
        # the end of a run may have lost bytes; most of it must still be whole characters
        good = data.decode("utf-8", "ignore")
        if len(good.encode()) * 4 >= len(data) * 3 and len(data) >= 8 and e.start >= 3:
            return data.decode("utf-8", "replace")
        return None


def candidates(run: str, depth: int = 3) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Every text that ``run`` may have been, with the chain that gives it."""
    for name, targets in CHAINS.items():
        data = encode_as(run, name)
        if data is None:
            continue
        for target in targets:
            text = _decode(data, target)
            if text is None or text == run or text.isascii():
                continue
            yield text, (f"{name}>{target}",)
            if depth > 1 and target == "utf-8":
                for more, chain in candidates(text, depth - 1):
                    if chain[0].endswith(">utf-8"):
                        yield more, (f"{name}>{target}", *chain)


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    side = lambda c: "a" if c.isalpha() else " "
    return (side(text[start - 1]) if start else " "), (side(text[end]) if end < len(text) else " ")


@lru_cache(maxsize=200_000)
def looks_clean(run: str) -> bool:
    """Whether a run may train the model: nothing about its form speaks of damage."""
    if _ODD.search(run) or _LATIN_RUN.search(run):
        return False
    if any(not _CASED.match(w) for w in _CYRILLIC.findall(run)):
        return False
    for name in CHAINS:
        data = encode_as(run, name)
        if data is not None:
            try:
                data.decode("utf-8")
                return False
            except UnicodeDecodeError:
                if name == "gb18030" and _CJK.search(run) and _decode(data, "utf-8") is not None:
                    return False
    return True


_PAIR = 21  # bits of a character; a pair is (first + 1) << _PAIR | second, a single character just itself


def count_grams(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the one- and two-character grams in and around the clean runs of ``texts``."""
    seen = Counter((m[0], *_around(text, m.start(), m.end())) for text in texts for m in _RUN.finditer(text))
    clean = [(left + run + right, n) for (run, left, right), n in seen.items() if looks_clean(run)]
    points, first, _ = _points([p for p, _ in clean])
    times = np.repeat(np.array([n for _, n in clean], np.int64), np.diff(np.append(first, len(points))))
    inner = np.ones(len(points), bool)
    inner[np.append(first[1:], len(points))[: len(first)] - 1] = False  # the last character of a text starts no pair
    at = np.flatnonzero(inner)
    codes = np.concatenate([points[at], (points[at] + 1) << _PAIR | points[at + 1]]) if len(at) else np.zeros(0, np.int64)
    codes, back = np.unique(codes, return_inverse=True)
    return codes, np.bincount(back, np.concatenate([times[at], times[at]]), len(codes)).astype(np.int64)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts one after the other, where each text starts, how long each is)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, np.cumsum(sizes) - sizes, sizes


@dataclass
class Model:
    """Exact counts: of characters by code point, of pairs by sorted code."""

    singles: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Model:
        single = codes < 1 << _PAIR
        singles = np.zeros(0x110000, np.float32)
        singles[codes[single]] = counts[single]
        order = np.argsort(codes[~single])
        return cls(singles, codes[~single][order], counts[~single][order].astype(np.float32))

    def log_p(self, texts: list[str]) -> np.ndarray:
        """Log probability of all characters of each text but the first, each after the one before it."""
        if not texts:
            return np.zeros(0)
        points, first, _ = _points(texts)
        total = float(self.singles.sum()) + 1.0
        before, single = np.append(0, points[:-1]), (self.singles[points] + 0.05) / (total + 5000.0)
        codes = (before + 1) << _PAIR | points
        at = np.searchsorted(self.pairs, codes)
        hit = at < len(self.pairs)
        hit[hit] = self.pairs[at[hit]] == codes[hit]
        pair = np.zeros(len(points))
        pair[hit] = self.counts[at[hit]]
        logs = np.log((pair + 2.0 * single) / (self.singles[before] + 2.0))
        logs[first] = 0.0
        return np.add.reduceat(logs, first)


def train(spark: SparkSession, texts: DataFrame, text: str = "text", most: int = GRAMS) -> Model:
    """The model over all rows of ``texts``: each task counts its own grams, the cluster adds the counts up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = count_grams(x for x in batch.column(0).to_pylist() if x)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])

    parts = texts.select(F.col(text)).mapInArrow(run, "code bigint, n bigint")
    grams = written(parts.groupBy("code").agg(F.sum("n").alias("n")), "grams")
    # how many pairs occur 1, 2 to 3, 4 to 7, ... times: the rarest classes go until no more than ``most`` remain
    classes = grams.where(F.col("code") >= 1 << _PAIR).groupBy(F.floor(F.log2("n")).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    least, held = 1, sum(r["pairs"] for r in classes)
    for r in sorted(classes, key=lambda r: r["c"]):
        if held <= most:
            break
        least, held = 2 << r["c"], held - r["pairs"]
    rows = grams.where((F.col("code") < 1 << _PAIR) | (F.col("n") >= least)).toPandas()  # at most ``most`` and the characters of Unicode
    return Model.of(rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f\ue000-\uf8ff]")
Reading = tuple[float, str, tuple[str, ...]]  # score, text, chain


class Repairer:
    """Scores runs under a model; remembers the runs it has seen."""

    LIMIT = 300_000

    def __init__(self, model: Model, margin: float = MARGIN):
        self.model, self.margin = model, margin
        self.known: dict[tuple[str, str, str], tuple[float, list[Reading]]] = {}

    def learn(self, texts: Iterable[str]) -> None:
        """Scores all runs of ``texts`` that are new, with all their readings, at once."""
        if len(self.known) > self.LIMIT:
            self.known.clear()
        new = dict.fromkeys(key for text in texts if not text.isascii() for m in _RUN.finditer(text) if (key := (m[0], *_around(text, m.start(), m.end()))) not in self.known)
        rows, scored = [], []
        for run, left, right in new:
            readings = [(t, c) for t, c in candidates(run) if not _CONTROL.search(t)]
            rows.append(readings)
            scored += [left + run + right, *(left + t + right for t, _ in readings)]
        scores = iter(self.model.log_p(scored).tolist())
        for key, readings in zip(new, rows, strict=True):
            self.known[key] = next(scores), [(next(scores) - 0.7 * len(c), t, c) for t, c in readings]

    def run(self, key: tuple[str, str, str], only: frozenset | None = None) -> tuple[str, tuple[str, ...]] | None:
        """(text as it was written, chain) of a run that was read wrongly; null for a clean one.

        ``only`` holds the chains by which other runs of the same text were damaged: with them the
        likelier reading wins without a margin, which settles runs too short to prove anything alone.
        """
        own, readings = self.known[key]
        allowed = [r for r in readings if only is None or r[2] in only]
        best = max(allowed, key=lambda r: r[0], default=None)
        if best is None or best[0] - own <= (self.margin if only is None else 0.0):
            return None
        return best[1:]

    def text(self, text: str) -> tuple[bool, str, list[str]]:
        """(whether anything was read wrongly, the text as far as it can be restored, the chains)."""
        if text.isascii():
            return False, text, []
        runs = [(m, (m[0], *_around(text, m.start(), m.end()))) for m in _RUN.finditer(text)]
        if any(key not in self.known for _, key in runs):
            self.learn([text])
        found = [self.run(key) for _, key in runs]
        by = frozenset(f[1] for f in found if f)
        if by:
            found = [f or self.run(key, by) for f, (_, key) in zip(found, runs, strict=True)]
        out, chains, at = [], [], 0
        for f, (m, _) in zip(found, runs, strict=True):
            if f:
                out += [text[at : m.start()], f[0]]
                chains.append("+".join(f[1]))
                at = m.end()
        if _LOSS in text:
            chains.append(LOST)
        return bool(chains), "".join([*out, text[at:]]), chains


def _declared(data: bytes, charset: str | None) -> str:
    """``data`` as its charset says; what that leaves undefined is replaced, control bytes of cp1252 stay."""
    name = (charset or "us-ascii").strip().lower()
    if name in ("windows-1252", "cp1252"):
        return codecs.charmap_decode(data, "strict", _characters("cp1252"))[0]
    if name in ("gb2312", "gbk"):
        name = "gb18030"
    if name in ("us-ascii", "ascii"):
        name = "utf-8"
    try:
        return data.decode(name, "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def mail_texts(raw: bytes) -> list[str]:
    """The subject and the text/plain parts (no attachments) of a mail, decoded as its headers say."""
    if raw.startswith(b"From "):
        raw = raw.partition(b"\n")[2]
    message = message_from_bytes(raw)
    out = []
    subject = message.get("subject")
    if subject is not None:
        try:
            pieces = decode_header(str(subject) if not isinstance(subject, str) else subject)
        except Exception:  # noqa: BLE001 - a broken encoded word is text like any other
            pieces = [(str(subject), None)]
        out.append("".join(_declared(p, c) if isinstance(p, bytes) else p.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for p, c in pieces))
    for part in message.walk():
        if part.is_multipart() or part.get_content_type() != "text/plain" or part.get_content_disposition() == "attachment":
            continue
        data = part.get_payload(decode=True)
        if data:
            out.append(_declared(data, part.get_content_charset()))
    return out


_CHARSET = re.compile(rb"charset\*?\d*\*?\s*=\s*[\"']?\s*([\w.:+-]+)", re.I)
_ENCODED = re.compile(rb"=\?|base64|quoted-printable|uue", re.I)


@lru_cache(maxsize=1000)
def _plain(charset: str) -> bool:
    """Whether ASCII bytes are ASCII characters in a charset; in unknown ones they are, as they are read as UTF-8."""
    try:
        return bytes(range(128)).decode(charset) == "".join(map(chr, range(128))) and not charset.lower().startswith(("utf-7", "utf7", "iso-2022", "iso2022", "hz"))
    except (LookupError, UnicodeError):
        return not charset.lower().startswith(("utf", "iso", "hz"))


def only_ascii(raw: bytes) -> bool:
    """Whether a mail surely decodes to ASCII: its bytes are, and no encoding or charset that it declares says more."""
    return raw.isascii() and not _ENCODED.search(raw) and all(_plain(c.decode()) for c in set(_CHARSET.findall(raw)))


def mail_text_rows(mails: DataFrame, key: str = "mail_id", raw: str = "raw_message") -> DataFrame:
    """(``key``, text) of each mail with non-ASCII text: its subject and plain parts, one per line group.

    Null and empty messages and messages of ASCII only give no row.
    """
    schema = f"`{key}` {mails.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                if not data:
                    continue
                if only_ascii(data):
                    continue
                text = "\n".join(mail_texts(data))
                if not text.isascii():
                    keys.append(i)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(texts, pa.string())], names=[key, "text"])

    return mails.select(F.col(f"`{key}`"), F.col(f"`{raw}`")).mapInArrow(run, schema)


def find_misread(texts: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of ``texts`` (src, row_id, field, text) that hold text read with a wrong encoding.

    Adds ``restored`` (the text as far as it can be given back; lost characters stay lost) and
    ``chains`` (the encodings, in order of the damaged runs). Null, empty and ASCII texts are clean.
    A replacement character is damage that cannot be undone, without a score; its chain is ``LOST``. Repeated rows are judged alike, whole
    texts are searched, and an empty table gives an empty result.
    """
    texts = written(texts.where(F.col("text").rlike(r"[^\x00-\x7F]")), "texts")
    model = train(texts.sparkSession, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model, margin)
        for batch in batches:
            own = batch.column(3).to_pylist()
            repairer.learn(own)
            found = [(i, *r[1:]) for i, t in enumerate(own) if (r := repairer.text(t))[0]]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(3)), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.string()))],
                names=["src", "row_id", "field", "restored", "chains"],
            )

    return texts.select("src", "row_id", "field", "text").mapInArrow(
        run, "src string, row_id bigint, field string, restored string, chains array<string>"
    )
