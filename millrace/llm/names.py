"""Variant spellings of names that people typed: linking those of one person or organisation.

Every distinct spelling is repaired (wrong decoding), stripped of titles, quotes and remarks, folded and
parsed into a family part and a given part. Blocks come from token suffixes: whole family tokens (their
longest suffix) with the given name's initial for spellings of one family, and suffixes of half a token or
more, of the token and of its reversal, for misspelt tokens. Suffixes are common, so they never stand alone:
they are refined with the other field (the given name) first. Blocks that are still overly common are given
up for finer ones of the same pairs, by the rest of the token without one letter. Pairs of a block are
compared by the ratio of their longest common subsequence. All steps are joins on block keys; no group of
spellings is collected anywhere.

A spelling that fits several persons equally well (an initial that two given names share) is linked
to none of them: people of one family name are not one person. A family name one slip away from another
is taken for a misspelling, whatever its length and however often it was typed, if persons of the same given
name bear both and at most one of its persons is unknown to the other. A lost character stands for any.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.encodings import Model, Repairer, train
from millrace.session import written

MIN_SUFFIX = 2  # letters that a blocking suffix has at least
_KNOWN_PARTNERS = 6  # families with which a word must stand before it counts as a given name
_TYPO_SHARE = 8  # ... unless a word one slip away stands with as many times more: then it is a slip
BLOCK = 200  # members of a block; larger ones are refined

_LOST = "\ufffd"

# What stands beside names without being part of them.
_TITLES = frozenset("dr prof mr mrs ms miss herr frau mme sir ing dipl".split())
_LEGAL = frozenset("inc gmbh ltd llc corp co ag sa plc bv oy ab".split())
_ORG_WORDS = frozenset("laboratories institute university foundation group systems software technologies desk department team".split())
_ORG_SHORT = {"lab": "laboratories", "labs": "laboratories", "laboratory": "laboratories", "inst": "institute", "univ": "university"}


def fold(word: str) -> str:
    """Lower case without marks. A letter written as two (``oe`` for ``ö``) is one slip away from it."""
    word = word.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("đ", "d").replace("æ", "a").replace("Æ", "A")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = where.get(c, 0) & row
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    """The longest common subsequence as a share of the longer word. Where one word has lost characters, each run of them fits any one or two."""
    if (_LOST in a) != (_LOST in b):
        damaged, whole = (a, b) if _LOST in a else (b, a)
        pattern = "".join("." + "{1,2}" * (len(part) > 1) if part[0] == _LOST else re.escape(part) for part in re.findall(f"{_LOST}+|[^{_LOST}]+", damaged))
        if re.fullmatch(pattern, whole):
            return 1.0
    return lcs(a, b) / max(len(a), len(b), 1)


def near(a: str, b: str) -> bool:
    """One slip apart: the common subsequence has all letters of the longer word but one, or all but the lost ones."""
    longer = max(len(a), len(b))
    return a != b and min(len(a), len(b)) >= 2 and longer >= 3 and ratio(a, b) * longer >= longer - 1 - 1e-9


def lead(token: str) -> str:
    """The first letter of a token as it was typed, in lower case but with its marks."""
    return unicodedata.normalize("NFC", token.lstrip(".'’")).lower()[:1]


def parse(name: str) -> tuple[str, list[str], str, list[str]]:
    """(kind, tokens, form, leads) of a spelling; ``name`` is repaired already.

    kind ``org``: tokens are (head, rest). kind ``person``: form says how the tokens stand: ``last``
    (family last), ``first`` (family first), ``open`` (either). Tokens are folded; a token of one letter
    is an initial; one that ended in a full stop keeps it. ``leads`` are the tokens' first letters with marks.
    """
    text = re.sub(r"\([^)]*\)?|\[[^\]]*\]?|<[^>]*>?", " ", name)
    text = re.sub(r"[\"“”„«»​­]", "", text).replace("\xa0", " ").strip()
    raw = [t for t in re.split(r"[\s_]+|-(?=[^\W\d_]{3})|(?<=,)", text) if t.strip(",")]
    if len(raw) == 1 and "." in raw[0].strip("."):
        raw = [t for t in raw[0].split(".") if t]
    comma = bool(raw) and raw[0].endswith(",")
    words = []
    for t in raw:
        bare = t.strip(",;:")
        word = fold(bare.strip(".'’"))
        if word and word not in _TITLES:
            words.append((word, bare.endswith(".") and len(word) > 1, bare, t.endswith(",")))
    plain = [_ORG_SHORT.get(w[0], w[0]) for w in words]
    plain = [next((o for o in _ORG_WORDS if len(w) > 6 and near(w, o)), w) for w in plain]
    if any(w in _ORG_WORDS for w in plain) or len([w for w in plain if len(w) > 1]) > 2:
        kept = [w for w in plain if w not in _LEGAL and w not in ("the", "kernel", "team")] or plain
        if any(w == "laboratories" for w in kept):
            head = "".join(w for w in kept if w != "laboratories")
            return "org", [head or "laboratories", "laboratories"], "last", ["", ""]
        return "org", ["".join(sorted(kept)), "org"], "last", ["", ""]
    words = [w for w in words if w[0] not in _LEGAL]
    full = [w for w in words if len(w[0]) > 1]
    if len(full) == 1:
        initials = [w for w in words if len(w[0]) == 1]
        return "person", [full[0][0], initials[0][0] if initials else ""], "first", [lead(full[0][2]), lead(initials[0][2]) if initials else ""]
    if len(full) < 2:
        return "person", ["".join(w[0] for w in words), ""], "first", ["", ""]
    a, b = full[0], full[1]
    tokens, leads = [a[0] + "." * a[1], b[0] + "." * b[1]], [lead(a[2]), lead(b[2])]
    if comma or (a[2].isupper() and not b[2].isupper()):
        return "person", tokens, "first", leads
    if b[2].isupper() and not a[2].isupper() or a[1]:
        return "person", tokens, "last", leads
    return "person", tokens, "open", leads


def _parsed(authors: DataFrame, model: Model) -> DataFrame:
    """(author, org, t1, t2, form, l1, l2) of each distinct author."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model)
        for batch in batches:
            names = batch.column(0).to_pylist()
            repairer.learn(names)
            rows = [parse(repairer.text(n)[1]) for n in names]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] == "org" for r in rows]),
                    pa.array([r[1][0] for r in rows], pa.string()),
                    pa.array([r[1][1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[3][0] for r in rows], pa.string()),
                    pa.array([r[3][1] for r in rows], pa.string()),
                ],
                names=["author", "org", "t1", "t2", "form", "l1", "l2"],
            )

    return authors.mapInArrow(run, "author string, org boolean, t1 string, t2 string, form string, l1 string, l2 string")


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _block_keys(word: Column, least: int) -> Column:
    """Suffixes of about half a token, and of its reversal; of short tokens also both ends.

    One slip leaves a suffix of the token or of its reversal whole that is one letter short of half the
    token. Two lengths are used so that tokens whose lengths differ by one share one. No suffix is
    shorter than ``least``, but for tokens of three letters, of which two exchanged ones leave only one.
    """
    halves = [F.greatest(F.lit(least), F.floor((F.length(word) - short) / 2).cast("int") - 1) for short in (0, 1)]
    keys = [F.concat(F.lit(side), cut(word, n)) for n in halves for side, cut in (("s", F.right), ("p", F.left))]
    ends = F.when(F.length(word) <= 6, F.concat(F.lit("e"), F.left(word, F.lit(1)), F.right(word, F.lit(1))))
    single = [F.when(F.length(word) == 3, F.concat(F.lit(side), cut(word, F.lit(1)))) for side, cut in (("s", F.right), ("p", F.left))]
    return F.array_distinct(F.array_compact(F.array(*keys, ends, *single)))


@F.pandas_udf(T.StringType())
def _folded(words: pd.Series) -> pd.Series:
    return words.map(fold, na_action="ignore")


def _refined(blocks: DataFrame, word: str, other: str) -> DataFrame:
    """``blocks`` (``word``, ``other``, key, ...) in which no block of (``other``, key) is overly common.

    Words one slip apart become equal when each loses one letter, so a large block is split by the words
    without one letter: the pairs that count stay together. The two sides of a self-join are split alike.
    """
    large = blocks.groupBy(other, "key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK).select(other, "key", F.lit(True).alias("__large"))
    large = written(large, "large-blocks")
    if large.isEmpty():
        return blocks
    w = F.col(word)
    without = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substr(w, i + 1)))
    finer = F.array_distinct(F.concat(F.array(w), without))
    marked = blocks.join(large, [other, "key"], "left").withColumn("__v", F.explode(F.when(F.col("__large"), finer).otherwise(F.array(F.lit("")))))
    return marked.withColumn("key", F.concat_ws("|", "key", "__v")).drop("__large", "__v").select(*blocks.columns)


def _only(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The one ``value`` of each key; keys with several values are left out."""
    return df.groupBy(*keys).agg(F.min(value).alias(out), F.max(value).alias("__max")).where(F.col(out) == F.col("__max")).drop("__max")


def link_names(df: DataFrame, author: str, nicknames: DataFrame) -> DataFrame:
    """(author, entity): every distinct non-empty value of ``author`` as stored, with its entity's key.

    ``nicknames`` (given_name, nickname) may be empty. Null and empty values are left out; blank ones
    form one entity; repeated rows count once; values of any length are read whole.
    """
    authors = df.select(F.col(f"`{author}`").alias("author")).where("author <> ''").distinct()
    authors = written(authors, "authors")
    model = train(df.sparkSession, authors.where(F.col("author").rlike(r"[^\x00-\x7F]")), "author")
    parsed = written(_parsed(authors, model), "parsed")
    person = parsed.where("not org and t2 <> '' and length(t2) > 1")

    # given names: those of the table, and words that stand beside many different others
    table = nicknames.select(_folded(F.col("given_name")).alias("given"), _folded(F.col("nickname")).alias("nick")).distinct()
    table = written(table, "nicknames")
    listed = table.select(F.col("given").alias("word")).union(table.select("nick")).where("word <> ''").distinct()
    beside = (
        person.where("form = 'open' and not t1 like '%.' and not t2 like '%.'").select(F.col("t1").alias("word"), F.col("t2").alias("other")).distinct()
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= _KNOWN_PARTNERS).where(~F.contains(F.col("word"), F.lit(_LOST)))
    )
    beside = written(beside, "beside")
    keyed = beside.select("word", "n", F.explode(_block_keys(F.col("word"), MIN_SUFFIX)).alias("key"))
    larger = keyed.select(F.col("word").alias("other"), F.col("n").alias("m"), "key")
    typos = keyed.join(larger, "key").where(F.col("m") >= _TYPO_SHARE * F.col("n")).select("word", "other").distinct().where(_near("word", "other")).select("word").distinct()
    known = written(listed.union(beside.join(typos, "word", "left_anti").select("word")).distinct(), "given-names")

    # which of two tokens is the given one
    k1, k2 = known.select(F.col("word").alias("t1"), F.lit(True).alias("k1")), known.select(F.col("word").alias("t2"), F.lit(True).alias("k2"))
    roles = parsed.join(k1, "t1", "left").join(k2, "t2", "left")
    swap = (F.col("form") == "first") | ((F.col("form") == "open") & F.col("k2").isNotNull() & F.col("k1").isNull())
    swap = swap | (F.col("org"))
    roles = roles.select(
        "author", "org",
        F.when(swap, F.col("t1")).otherwise(F.col("t2")).alias("fam"),
        F.when(swap, F.col("t2")).otherwise(F.col("t1")).alias("giv"),
        F.when(swap, F.col("l1")).otherwise(F.col("l2")).alias("lf"),
        F.when(swap, F.col("l2")).otherwise(F.col("l1")).alias("lg"),
    )
    # logins such as given.family may stand the other way round, with an initial
    one = F.length("fam") == 1
    either = lambda a, b: F.when(one, F.col(a)).otherwise(F.col(b))
    roles = roles.select("author", "org", F.rtrim(either("giv", "fam"), F.lit(".")).alias("fam"), either("fam", "giv").alias("giv"), either("lf", "lg").alias("lead"))
    roles = written(roles, "roles")

    # candidate given names of each given token: itself, those it is a nickname of, or those one slip away
    words = roles.where("not org and length(giv) > 1 and not giv like '%.'").select(F.col("giv").alias("word")).distinct()
    mark = lambda c, name: table.select(F.col(c).alias("word"), F.lit(True).alias(name)).distinct()
    words = words.join(known.withColumn("known", F.lit(True)), "word", "left").join(mark("nick", "is_nick"), "word", "left").join(mark("given", "is_given"), "word", "left")
    words = written(words, "words")
    itself = words.where("known and (is_nick is null or is_given)").select("word", F.col("word").alias("given"))
    nick = words.where("known and is_nick").join(table, F.col("word") == F.col("nick")).select("word", "given")
    keys = lambda df, name: df.select(F.col("word").alias(name), F.explode(_block_keys(F.col("word"), MIN_SUFFIX)).alias("key"))
    slips = keys(words.where("known is null"), "word").join(keys(known, "given"), "key").select("word", "given").distinct().where(_near("word", "given"))
    slips = slips.join(table.withColumnRenamed("given", "of"), F.col("given") == F.col("nick"), "left").select("word", F.coalesce("of", "given").alias("given"))
    candidates = written(itself.union(nick).union(slips).distinct(), "candidates")

    # families one slip away, of the same given name: the spelling of fewer persons joins that of more
    # (with as many, the rarer one the more common one); short heads of organisations are often acronyms
    full = roles.join(candidates, F.col("giv") == F.col("word"), "left").select("author", "org", "fam", "giv", "lead", F.coalesce("given", F.when(F.length("giv") > 1, F.col("giv"))).alias("given"))
    full = written(full, "full-names")
    spelt = full.where("given is not null and not given like '%.' and (not org or length(fam) >= 6)")
    people = spelt.groupBy("fam", "giv").agg(F.min("given").alias("person"))
    support = people.groupBy("fam").agg(F.count_distinct("person").alias("people")).join(full.groupBy("fam").agg(F.count_distinct("author").alias("n")), "fam")
    blocks = (
        spelt.select("fam", "given").distinct().join(support, "fam")
        .select("fam", "given", F.struct("people", "n").alias("size"), F.explode(_block_keys(F.col("fam"), MIN_SUFFIX)).alias("key"))
    )
    blocks = written(_refined(blocks, "fam", "given"), "family-blocks")
    other = blocks.select(F.col("fam").alias("to"), "given", F.col("size").alias("size_to"), "key")
    rarer = (F.col("size") < F.col("size_to")) | ((F.col("size") == F.col("size_to")) & (F.col("fam") > F.col("to")))
    pairs = (
        blocks.join(other, ["given", "key"]).where(rarer & (F.abs(F.length("fam") - F.length("to")) <= 1))
        .select("fam", "to", "given", "size", "size_to").distinct().where(_near("fam", "to"))
    )
    # two persons whom the other family lacks make a family of its own, which is no slip
    shared = (
        pairs.join(spelt.select("fam", "giv", "given").distinct(), ["fam", "given"]).join(people, ["fam", "giv"])
        .groupBy("fam", "to", "size", "size_to").agg(F.count_distinct("person").alias("shared"))
    )
    merges = shared.where(F.col("size.people") - F.col("shared") <= 1).groupBy("fam").agg(F.max_by("to", F.struct("shared", "size_to", "to")).alias("canon"))
    merges = written(merges, "family-slips")
    # a target that is a slip itself leads on to its own target; each round doubles the steps taken
    while True:
        onward = merges.select(F.col("fam").alias("canon"), F.col("canon").alias("canon2"))
        if merges.join(onward, "canon", "left_semi").isEmpty():
            break
        merges = written(merges.join(onward, "canon", "left").select("fam", F.coalesce("canon2", "canon").alias("canon")), "family-slips")
    full = full.join(merges, "fam", "left").withColumn("fam", F.coalesce("canon", "fam")).drop("canon")

    # persons: a family with a given name that some spelling states beyond doubt
    counted = full.withColumn("choices", F.count(F.lit(1)).over(Window.partitionBy("author")))
    sure = counted.where("given is not null and choices = 1 and not giv like '%.'")
    persons = written(sure.select("fam", "given").distinct(), "persons")
    settled = sure.select("author", "fam", "given")
    # spellings with several candidates: the one that the family has; the first of them if it has none; no one if it has several
    open_ = counted.where("choices > 1 and not giv like '%.'")
    present = open_.join(persons, ["fam", "given"], "left_semi").select("author", "fam", "given")
    fits = _only(present, ["author", "fam"], "given", "given")
    torn = present.select("author", "fam").distinct().join(fits.select("author"), "author", "left_anti")
    torn = torn.select("author", "fam", F.concat(F.lit("!"), F.col("author")).alias("given"))
    rest = open_.join(present.select("author"), "author", "left_anti")
    first = rest.groupBy("author", "fam").agg(F.min("given").alias("given"))
    settled = settled.union(fits.select("author", "fam", "given")).union(first.select("author", "fam", "given"))
    settled = written(settled, "settled")

    # initials and abbreviations: the one person of the family whose given name (or nickname) begins so; a
    # letter typed with a mark means the persons whose names are typed with it, if there are any
    short = full.where("(length(giv) <= 1 or giv like '%.')").select("author", "fam", F.rtrim(F.col("giv"), F.lit(".")).alias("begin"), "lead").distinct()
    named = settled.select("author", "fam", "given").join(full.where("length(giv) > 1").select("author", F.col("lead").alias("__lead")), "author").select("fam", "given", "__lead").distinct()
    begins = (
        short.withColumn("initial", F.left("begin", F.lit(1)))
        .join(named.withColumn("initial", F.left("given", F.lit(1))), ["fam", "initial"])
        .where(F.col("given").startswith(F.col("begin")) & (F.length("begin") > 0))
        .groupBy("author", "fam", "begin", "given").agg(F.bool_or((F.col("lead") == F.col("__lead")) & (F.col("lead") != F.col("initial"))).alias("marked"))
    )
    begins = written(begins, "begins")
    exact = begins.where("marked").select("author", "fam").distinct()
    begins = begins.where("marked").unionByName(begins.join(exact, ["author", "fam"], "left_anti"))
    expanded = _only(begins, ["author", "fam"], "given", "given")
    bare = short.join(expanded.select("author"), "author", "left_anti").join(begins.select("author").distinct(), "author", "left_anti")
    alone = bare.select("author", "fam", F.concat(F.lit("?"), F.left("begin", F.lit(1))).alias("given"))
    # an initial that several persons share belongs to none of them
    shared = short.join(begins.select("author").distinct(), "author", "left_semi").join(expanded.select("author"), "author", "left_anti")
    nobody = shared.select("author", "fam", F.concat(F.lit("!"), F.col("author")).alias("given"))
    linked = settled.union(expanded.select("author", "fam", "given")).union(alone).union(nobody).union(torn)
    return linked.select("author", F.concat_ws("|", "fam", "given").alias("entity"))


def same_names(df: DataFrame, author: str, nicknames: DataFrame) -> DataFrame:
    """(author_a, author_b): all pairs of different values of one entity, author_a < author_b in code point order."""
    linked = written(link_names(df, author, nicknames), "linked")
    a = linked.select(F.col("author").alias("author_a"), "entity")
    b = linked.select(F.col("author").alias("author_b"), "entity")
    return a.join(b, "entity").where("author_a < author_b").select("author_a", "author_b")
