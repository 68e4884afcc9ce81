import itertools
import random
from collections import Counter

import pytest
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import catalogue, packing, pieces, together, tokens

needs_vocabulary = pytest.mark.skipif(not __import__("os").path.exists(tokens.TOKENIZER), reason="no vocabulary files")


# --- items together ---------------------------------------------------------------------------


def brute_pairs(rows, least=5, lift=10):
    out = {}
    for field in {r[0] for r in rows}:
        baskets = {}
        for f, rec, item in rows:
            if f == field:
                baskets.setdefault(rec, set()).add(item)
        n, single, pair = len(baskets), Counter(), Counter()
        for items in baskets.values():
            single.update(items)
            pair.update(itertools.combinations(sorted(items), 2))
        for (a, b), t in pair.items():
            if t >= least and t * n >= lift * single[a] * single[b]:
                cells = (t, single[a] - t, single[b] - t, n - single[a] - single[b] + t)
                odds = (cells[0] + 0.5) * (cells[3] + 0.5) / ((cells[1] + 0.5) * (cells[2] + 0.5))
                out[field, a, b] = (t, single[a], single[b], n, round(odds, 6))
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for rec in range(900):
        group = rng.randrange(60)
        items = {f"g{group}-{i}" for i in range(3)} | {f"x{rng.randrange(400)}" for _ in range(4)} | ({"hot"} if rec % 3 == 0 else set())
        rows += [("f", f"r{rec}", i) for i in items] + [("g", f"r{rec}", i) for i in items if rec % 2]
    df = spark.createDataFrame(rows, "field string, record string, item string")
    got = {(r.field, r.item_a, r.item_b): (r.together, r.count_a, r.count_b, r.records, round(r.odds, 6)) for r in together.together(df).collect()}
    assert got == brute_pairs(rows) and len(got) > 100


def test_records_of_any_size(spark):
    rows = [("f", f"r{r}", f"i{i:03}") for r in range(6) for i in range(30)] + [("f", f"s{r}", f"only{r}") for r in range(80)]
    df = spark.createDataFrame(rows, "field string, record string, item string")
    assert {(r.field, r.item_a, r.item_b): r.together for r in together.together(df, block=7, run=50).collect()} == {k: v[0] for k, v in brute_pairs(rows).items()}


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("a", ["x", None, "", "x"], 1), (None, ["x"], 2), ("", ["x"], 3), ("b", None, 4), ("a", ["y"], 1)], "rec string, items array<string>, field int")
    rows = together.item_rows(df, "rec", "items", "f")
    assert sorted(tuple(r) for r in rows.collect()) == [("f", "a", "x"), ("f", "a", "y")]
    assert together.together(rows).count() == 0 and together.together(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_and_sql(spark, data, sql, name):
    same_rows(catalogue.QUERIES[name](spark, data), sql, catalogue.SQL[name])


# --- pieces -----------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["diff --git a b", "@@ -1 +1 @@", "x" * 5, "y" * 40, "", "é😀\r", "z" * 95]), max_size=60), st.booleans(), st.sampled_from([(50, 10), (30, 0), (90, 89)]))
def test_pieces_put_together_give_the_text(parts, ended, sizes):
    text, (limit, overlap) = "\n".join(parts) + "\n" * ended, sizes
    found, lines = pieces.plan_pieces(text, limit, overlap)
    if len(text) <= limit:
        assert found == [(0, len(text), "end")] and not lines
        return
    assert all(0 < b - a <= limit for a, b, _ in found) and found[0][0] == 0 and found[-1][1] == len(text)
    assert all(nxt[0] == cur[1] - overlap and nxt[1] > cur[1] for cur, nxt in itertools.pairwise(found))
    assert text[: found[0][1]] + "".join(text[a + overlap : b] for a, b, _ in found[1:]) == text
    for a, b, cut in found[:-1]:
        if cut == "hard":  # only where no line begins in the part that would be new
            assert "\n" not in text[max(a + overlap, 0) : b - 1]
        else:
            assert text[b - 1] == "\n" and text[b:].startswith({"file": "diff --git ", "block": "@@ "}.get(cut, ""))
    assert lines == [n for n, line in enumerate(text.split("\n"), 1) if len(line) > limit]


def test_split_rows(spark):
    long = "diff --git a b\n" + "x" * 7000 + "\n" + "line\n" * 2000 + "y" * 6500
    rows = [(1, long, "c"), (2, None, "c"), (3, "", "c"), (4, "a" * 6000, "c"), (5, "é" * 6001, "c"), (1, long, "c"), (None, "b" * 6001, "c")]
    df = spark.createDataFrame(rows, "id long, text string, piece string")
    out = pieces.split_oversized(df, "id", "text").collect()
    for key, times in ((1, 2), (5, 1), (None, 1)):
        assert sum(r.piece_no == 0 for r in out if r.id == key) == times
    assert {r.id for r in out} == {1, 5, None} and all(len(r.piece) <= 6000 for r in out if r.piece_no is not None)
    assert sorted((r.id or 0, r.line_no) for r in pieces.oversized(df, "id", "text").collect()) == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 2), (1, 2), (1, 2003), (1, 2003), (5, 0), (5, 1)]
    assert pieces.split_oversized(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        pieces.plan_pieces("x", 10, 10)


# --- tokens -----------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "Hello world  two\n\n  three's 12½ x²", "it's we'll I'D <|endoftext|> don't", "日本語テキスト、😀👩‍🔧 é é​", "\x1c\x85\xa0　a\t\tb ", "Ωmega ٣٤ Ⅷ", "a" * 20_000,
    "\U0001e030\U0001df00࢏\U00016a70 new letters", "‮abc‬", "x\r\ny \r\n", "�﻿",
]


@needs_vocabulary
def test_ids_offsets_and_decoding(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, "a b", "k"), (3, TEXTS[3], "k")], "doc_id long, text string, ids string")
    library = tokens._library(tokens.TOKENIZER)
    ids = tokens.encode_texts(df, "doc_id", "text")
    rows = ids.collect()
    assert len(rows) == len(TEXTS) + 2 and ids.schema["ids"].dataType.simpleString() == "array<int>"
    for r in rows:
        text = "a b" if r.doc_id is None else TEXTS[r.doc_id]
        assert r.ids == library.encode(text or "", add_special_tokens=False).ids
        assert tokens.decode(r.ids) == (text or "")
    back = {r.doc_id: r.text for r in tokens.decode_ids(ids, "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert counts == {r.doc_id: len(r.ids) for r in rows}
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    for r in tokens.token_offsets(df, "doc_id", "text").collect():
        text, at = "a b" if r.doc_id is None else TEXTS[r.doc_id] or "", r.spans
        assert len(at) == counts[r.doc_id] and sum(x.length for x in at) == len(text)
        assert [x.start for x in at] == [sum(y.length for y in at[:i]) for i in range(len(at))]


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab1'. \n\t\r-é中٣½²\x1c\x85\xa0\u2028\u180e\u3000\u200b😀Ⅷ_\U0001e030", "'s", "'re", "  "]), max_size=12).map("".join))
def test_chunks_give_the_librarys_ids(text):
    ids, ends = tokens.encoder(tokens.TOKENIZER).ragged([text, None, text])
    whole = tokens._library(tokens.TOKENIZER).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == whole * 2 and ends.tolist() == [0, len(whole), len(whole), 2 * len(whole)]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {c: i for i, c in enumerate("abĠĊ")} | {"ab": 4, "Ġa": 5}
    for name, cut in (("prefixed", pre_tokenizers.ByteLevel(add_prefix_space=True)), ("uncut", pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)), ("usual", pre_tokenizers.ByteLevel(add_prefix_space=False))):
        made = Tokenizer(models.BPE(vocabulary, [("a", "b"), ("Ġ", "a")]))
        made.pre_tokenizer = cut
        path = str(tmp_path / f"{name}.json")
        made.save(path)
        assert tokens.cuts_at_blanks(path) is (name == "usual")
        for text in ("ab ab", " a  b", "a\n ab", ""):
            assert tokens.Encoder(path).ragged([text])[0].tolist() == made.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_corpus_ids(spark, data):
    library = tokens._library(tokens.TOKENIZER)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = catalogue.p7_ids(spark, data).collect()
    assert len(rows) == len(texts) and all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)


@needs_vocabulary
def test_memo_survives_being_emptied(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "LIMIT", 2)
    own = tokens.Encoder(tokens.TOKENIZER)
    for text in ("a b c", "a d", "zzzz b", "a b c"):
        assert own.ragged([text])[0].tolist() == tokens._library(tokens.TOKENIZER).encode(text, add_special_tokens=False).ids


# --- containers -------------------------------------------------------------------------------


@needs_vocabulary
def test_containers(spark, data):
    rows = catalogue.p8_containers(spark, data).collect()
    counts = {r.doc_id: len(r.ids) for r in catalogue.p7_ids(spark, data).collect()}
    held = Counter()
    pieces_of = {}
    for r in rows:
        held[r.container] += r.n_tokens
        pieces_of.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
    assert max(held.values()) <= packing.CAPACITY
    assert set(pieces_of) == {d for d, n in counts.items() if n}
    for doc, own in pieces_of.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and all(n == packing.CAPACITY for *_, n in own[:-1])
        assert [f for _, f, _ in own] == [packing.CAPACITY * i for i in range(len(own))] and sum(n for *_, n in own) == counts[doc]
    least = -(-sum(counts.values()) // packing.CAPACITY)
    assert len(held) <= least + 2  # nearly as few as any packing can have


@needs_vocabulary
def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 30, "x"), (3, "word " * 30, "x"), (4, "tail", "x")], "doc_id long, text string, container string")
    rows = packing.pack(df, "doc_id", "text", capacity=20).collect()
    assert Counter(r.doc_id for r in rows) == {3: 4, 4: 1} and all(r.n_tokens <= 20 for r in rows)
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_neighbours_fill_the_window():
    import numpy as np

    bags = [packing._bag(np.array(t, np.int32)) for t in ([1, 2, 3, 4], [9, 8, 7], [1, 2, 3], [70_000, 8, 7])]
    idf = np.ones(70_001, np.float32)
    choices = []
    found = packing.fill(np.array([4, 3, 3, 3]), bags, idf, 3.0, capacity=7, choices=choices)
    assert sorted(map(sorted, found)) == [[0, 2], [1, 3]] and choices[0] > 1


def test_space_left_behind_each_item():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.integers(1, 12, rng.integers(1, 9))
        room, have = 12, np.bincount(sizes, minlength=13)
        least = [min([room - a, *(room - a - b for j, b in enumerate(sizes) if j != i and b <= room - a)]) for i, a in enumerate(sizes)]
        assert packing._unused(sizes, have, room).tolist() == least
