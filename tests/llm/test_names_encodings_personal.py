import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from millrace.llm import catalogue, encodings, names, personal

# --- wrong encodings --------------------------------------------------------------------------

CLEAN = [
    "Größe und Übertragung geprüft, für ältere Zweige genügt es", "Le problème apparaît dès que la mémoire est fragmentée", "También se corrigió la liberación doble en pequeña máquina",
    "Перед освобождением нужно взять блокировку и проверить счётчик ссылок", "Функция освобождает буфер дважды при ошибке", "测试环境见附录二。驱动的旧代码假定表不会变大", "NÃO REINICIE, SÃO DEZ MINUTOS",
    "¼–½ of the Ångström table × 10³", "“ring layout” — field’s meaning…", "Åsa Kérdolelen, Céline Fülsitatund, René Sålsalevos, Petronella Dørpakibund", "£40 or ¥600 ©lab ±5 °C, µs ≈ λ → Δ ✓ 😀", "Le bâtiment Â abrite le banc d’essai nº 3",
]
DAMAGE = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("latin-1", "gb2312")]


def damaged(text, read, written):
    try:
        bad = text.encode(written).decode(read)
    except UnicodeError:
        if read != "cp1252":
            return None
        try:  # bytes that cp1252 leaves undefined stay control characters, as most software has it
            bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode(written))
        except UnicodeError:
            return None
    return bad if bad != text else None


@pytest.fixture(scope="module")
def repairer():
    words = [w for t in CLEAN for w in t.split()]
    rng = random.Random(2)
    corpus = CLEAN * 20 + [" ".join(rng.sample(words, 12)) for _ in range(1500)]
    corpus += [d for t in CLEAN for read, written in DAMAGE if (d := damaged(t, read, written))]  # a corpus that is not clean
    return encodings.Repairer(encodings.Model.of(*encodings.count_grams(corpus)))


def test_held_out_accuracy(repairer):
    rng = random.Random(9)
    words = [w for t in CLEAN for w in t.split()]
    held = [" ".join(rng.sample(words, 6)) for _ in range(400)]
    assert not any(repairer.text(t)[0] for t in held + CLEAN)
    found = restored = total = 0
    for t in held + CLEAN:
        for read, written in DAMAGE:
            bad = damaged(t, read, written)
            if bad is None:
                continue
            hit, back, chains = repairer.text(bad)
            total, found, restored = total + 1, found + hit, restored + (back == t)
            assert not hit or chains
    assert total > 800 and found >= 0.99 * total and restored >= 0.95 * total, (total, found, restored)


def test_twice_damaged_and_lost(repairer):
    once = damaged("Größe und Übertragung geprüft", "cp1252", "utf-8")
    assert repairer.text(damaged(once, "cp1252", "utf-8"))[:2] == (True, "Größe und Übertragung geprüft")
    assert repairer.text("Gr�ße")[0] and not repairer.text("plain")[0] and not repairer.text("")[0]


def test_mails_as_their_headers_say():
    assert encodings.mail_texts(b"Subject: =?utf-8?B?w6k=?= x\n\nbody\n") == ["é x", "body\n"]
    assert encodings.mail_texts(b"From a\nContent-Type: text/plain; charset=windows-1252\nContent-Transfer-Encoding: quoted-printable\n\n=C3=A9=81") == ["Ã©\x81"]
    many = b'Content-Type: multipart/mixed; boundary="c"\n\n--c\nContent-Type: text/plain; charset=nonsense\n\n\xc3\xa9\n--c\nContent-Type: text/html\n\n\xc3\xa9\n--c\nContent-Type: text/plain\nContent-Disposition: attachment\n\n\xc3\xa9\n--c--\n'
    assert encodings.mail_texts(many) == ["é"] and encodings.mail_texts(b"") == []
    assert encodings.mail_texts(b"Content-Type: text/plain; charset=utf-8\n\n\xe4") == ["�"]


def test_mails_of_ascii_bytes_that_hide_other_characters(spark):
    head = "Subject: x\nContent-Type: text/plain; charset="
    mails = [f"{head}{c}\n\n".encode() + "日本 é".replace("é", "" if "2022" in c or c == "hz" else "é").encode(c) for c in ("iso-2022-jp", "hz", "utf-7")]
    assert all(m.isascii() and not encodings.only_ascii(m) for m in mails)
    assert all(encodings.only_ascii(f"{head}{c}\n\nplain".encode()) for c in ("utf-8", '"windows-1252"', "gb18030", "nonsense"))
    df = spark.createDataFrame([(i, m) for i, m in enumerate([*mails, b"Subject: plain\n\nx", b"", None])], "mail_id long, raw_message binary")
    got = {r.mail_id: r.text for r in encodings.mail_text_rows(df).collect()}
    assert set(got) == {0, 1, 2} and all("日本" in t for t in got.values())


def test_counts_are_exact_and_bounded(spark):
    df = spark.createDataFrame([("é" * i + " 字典",) for i in range(1, 30)], "text string")
    model = encodings.train(spark, df)
    assert model.singles[ord("字")] == 29 and model.counts.sum() == sum(m.counts.sum() for m in [encodings.Model.of(*encodings.count_grams(r.text for r in df.collect()))])
    small = encodings.train(spark, df, most=3)
    assert 0 < len(small.pairs) <= 3 and set(small.pairs) < set(model.pairs) and (small.singles == model.singles).all()
    assert small.counts.min() >= model.counts[~np.isin(model.pairs, small.pairs)].max() / 2


def test_accuracy_does_not_depend_on_the_vocabulary():
    words = [w for t in CLEAN for w in t.split()]
    rng = random.Random(2)
    corpus = CLEAN * 20 + [" ".join(rng.sample(words, 12)) for _ in range(1500)]
    corpus += [d for t in CLEAN for read, written in DAMAGE if (d := damaged(t, read, written))]
    # ten times as many different characters and pairs beside them
    more = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(12)) for _ in range(15_000)]
    shares = []
    for extra in ([], more[:1500], more):
        own = encodings.Repairer(encodings.Model.of(*encodings.count_grams([*corpus, *extra])))
        held = [" ".join(rng.sample(words, 6)) for _ in range(150)]
        bad = [d for t in held for read, written in DAMAGE if (d := damaged(t, read, written))]
        shares.append((sum(own.text(t)[0] for t in bad) / len(bad), sum(own.text(t)[0] for t in held)))
    assert all(found >= 0.99 and false == 0 for found, false in shares), shares


def test_find_misread_rows(spark):
    bad = damaged("für ältere Zweige genügt es", "cp1252", "utf-8")
    rows = [("s", 1, "f", t) for t in CLEAN * 3] + [("s", 2, "f", bad), ("s", 2, "f", bad), ("s", 3, "f", None), ("s", None, "f", "x " * 200_000 + bad), ("s", 4, "f", "")]
    df = spark.createDataFrame(rows, "src string, row_id long, field string, text string")
    got = sorted(encodings.find_misread(df).collect(), key=lambda r: r.row_id or 0)
    assert [r.row_id for r in got] == [None, 2, 2] and got[1].restored == "für ältere Zweige genügt es" and got[0].restored.endswith("genügt es")
    assert encodings.find_misread(df.limit(0)).count() == 0


def test_corpus_texts_are_restored_to_clean_ones(spark, data):
    rows = catalogue.p6_restored(spark, data).collect()
    found = {(r.src, r.row_id, r.field) for r in catalogue.p6_found(spark, data).collect()}
    assert rows and found == {(r.src, r.row_id, r.field) for r in rows}
    odd = re.compile(r"Ã[©¼¤¶³¨±ƒ]|â€|├|√[©ºß∂§∏]")
    assert not [r for r in rows if odd.search(r.restored)]


# --- names ------------------------------------------------------------------------------------

PEOPLE = {
    "rod": ["Roderick Véntukevik", "Roderick Véntukevik ", "Dr. Roderick Véntukevik", "Roddy Véntukevik", "Rodeiick Véntukevik", "Roderick VÃ©ntukevik", "Roderick Véntukevik (work)", "Rode. Véntukevik", "VÉNTUKEVIK Roderick",
            "Véntukevik, Roderick", "roderick.véntukevik", "Roderick\xa0Véntukevik", '"Roderick Véntukevik"', "Roderick B. Véntukevik", "Roderick Ventukevik", "Roderick Vénntukevik", "R. Véntukevik", "véntukevik.r"],
    "vik": ["Viktoria Véntukevik", "Vicky Véntukevik", "Véntukevik, V."],
    "jo": ["Björn Gorsimedund", "Bjoern Gorsimedund", "Bjorn Gorsimedund", "BJÖRN GORSIMEDUND", "Bj�rn Gorsimedund"],
    "lab": ["Palbeduten Laboratories", "Palbeduten Labs", "palbeduten lab.", "Palbeduten-Laboratories", "The Palbeduten Laboratories Kernel Team", "Palbeduten Laboratories GmbH", "Palbeduten Laboratores"],
    "desk": ["Mainline Intake Desk", "Intake Desk, Mainline", "mainline intake desk", "Mainline Intake Dsk"],
    "lab2": ["Horlapemen Laboratories", "Horlapemen Laboratory"],
    "p": ["Viktoria Palbeduten"],
    "val": ["Valentina Sënfimidos"],
    "vic2": ["Viktoria Sënfimidos"],
    "amb": ["V. Sënfimidos"],
}
NICK = [("Roderick", "Rod"), ("Roderick", "Roddy"), ("Viktoria", "Vicky"), ("Valentina", "Val"), ("Leopold", "Leo"), ("Leonora", "Leo")]


def test_spellings_of_people_and_organisations(spark):
    rows = [(a, "e") for own in PEOPLE.values() for a in own for _ in range(2)] + [(None, "e"), ("", "e"), (" ", "e"), ("x" * 20_000, "e"), ("Leo Mortasimos", "e"), ("Mortasimos, L.", "e")]
    rows += [(f"{g} Clean{f}os", "e") for g in ("Roderick", "Viktoria", "Björn") for f in ("alub", "erov", "ikar", "ozun", "ugal", "amod", "enib")]
    df = spark.createDataFrame(rows, "author string, entity string")
    nick = spark.createDataFrame(NICK, "given_name string, nickname string")
    got = {(r.author_a, r.author_b) for r in names.same_names(df, "author", nick).collect()}
    want = {(a, b) for own in PEOPLE.values() for a, b in itertools.combinations(sorted(own), 2)} | {("Leo Mortasimos", "Mortasimos, L.")}
    assert got == want, (got - want, want - got)
    linked = names.link_names(df, "author", nick).collect()
    assert len(linked) == len({r.author for r in linked}) == len({a for a, _ in rows if a})
    assert names.same_names(df.limit(0), "author", nick.limit(0)).count() == 0


def test_misspelt_families_of_any_length_and_number(spark):
    own = [
        ["Roderick Ventukevik", "Viktoria Ventukevik", "Roderick Ventukevk", "Ventukevk, Roderick", "Roderick VENTUKEVK", "Dr. Roderick Ventukevk", "Roderick Ventukevk (work)"],
        ["Roderick Weber", "Weber, Roderick", "Roderick Webber"], ["Viktoria Meyer", "Viktoria Mayer", "Mayer, Viktoria", "Viktoria MAYER"], ["Leopold Kim", "Leopold Kmi"],
        ["Leonora Tam", "Leonora Tamm", "Leonora Tammo", "Leonora Tammol"],  # slips of slips
        ["Valentina Wang", "Leopold Wang", "Roderick Wang"], ["Valentina Yang", "Viktoria Yang", "Leonora Yang"],  # two families
        ["AMD Labs", "AMD Laboratories"], ["ARM Labs", "ARM Laboratories"],
    ]
    df = spark.createDataFrame([(a,) for o in own for a in o], "author string")
    got = {(r.author_a, r.author_b) for r in names.same_names(df, "author", spark.createDataFrame(NICK, "given_name string, nickname string")).collect()}
    persons = [[a for a in own[0] if "Vik" not in a], *own[1:5], *own[7:]]
    want = {(a, b) for o in persons for a, b in itertools.combinations(sorted(o), 2)}
    assert got == want, (got - want, want - got)


def test_nickname_of_two_persons_of_the_family(spark):
    rows = ["Leo Gorsimedund", "Leopold Gorsimedund", "Leonora Gorsimedund", "Leo Palbeduten", "Leopold Palbeduten", "Leo Mortasimos", "Mortasimos, Leo"]
    df = spark.createDataFrame([(a,) for a in rows], "author string")
    nick = spark.createDataFrame(NICK, "given_name string, nickname string")
    got = {(r.author_a, r.author_b) for r in names.same_names(df, "author", nick).collect()}
    assert got == {("Leo Palbeduten", "Leopold Palbeduten"), ("Leo Mortasimos", "Mortasimos, Leo")}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert names.lcs(a, b) == table[-1][-1]


def test_lost_characters_marked_initials_and_slips_of_given_names(spark):
    lost = names._LOST
    spellings = [
        ["Céline Halfemerund", f"C{lost}line Halfemerund", f"C{lost}line H{lost}lfemerund", f"C{lost}{lost}line Halfemerund"],
        ["Åsa Venlifeben", "Å. Venlifeben", "Venlifeben, Å."],
        ["Adriana Venlifeben"],
        ["A. Venlifeben"],  # either of the two
    ]
    # a slip that is typed with many families is none the less a slip
    rng = random.Random(3)
    others = [[f"Céline {''.join(rng.choices('bdfgklmnprst', k=9)).title()}"] for _ in range(60)]
    for own in others[:6]:
        own.append(own[0].replace("Céline", "Celin"))
    rows = [(n,) for group in [*spellings, *others] for n in group]
    df = spark.createDataFrame(rows, "author string")
    nicks = spark.createDataFrame([("Adriana", "Addy"), ("Åsa", "Å")], "given_name string, nickname string")
    got = {tuple(r) for r in names.same_names(df, "author", nicks).collect()}
    want = {tuple(sorted(p)) for group in [*spellings, *others] for p in itertools.combinations(group, 2)}
    assert got == want, (got - want, want - got)


def test_large_blocks_are_refined_without_loss(spark, monkeypatch):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(5, 7))) for _ in range(300)})
    df = spark.createDataFrame([(w, "g") for w in words], "fam string, given string")
    blocks = df.select("fam", "given", F.explode(names._block_keys(F.col("fam"), names.MIN_SUFFIX)).alias("key"))
    found = {}
    for size in (10_000, 10):
        monkeypatch.setattr(names, "BLOCK", size)
        fine = names._refined(blocks, "fam", "given")
        pairs = fine.join(fine.withColumnRenamed("fam", "to"), ["given", "key"]).where("fam < to").select("fam", "to").distinct().collect()
        found[size] = {tuple(r) for r in pairs if names.near(*r)}, fine.groupBy("given", "key").count().agg(F.max("count")).first()[0]
    assert found[10_000][0] == found[10][0] and found[10][1] < found[10_000][1]
    # of words apart by one edit none is missed
    swaps = {(a, b) for a, b in itertools.combinations(words, 2) if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    assert swaps and swaps <= found[10][0]


def test_corpus_names(spark, data):
    rows = catalogue.p4_found(spark, data).collect()
    assert rows and all(r.author_a < r.author_b for r in rows) and len(rows) == len({tuple(r) for r in rows})


# --- personal information ---------------------------------------------------------------------


GIVEN = {"Roderick", "Viktoria", "Jörg", "Dominik", "Karoline"}


def mentions(text, dates=False):
    return personal.mentions(text, GIVEN.__contains__, dates)


TEXT = """Signed-off-by: Roderick Véntukevik <rod.v+kernel@dev.ostmark.example>
Cc: Véntukevik, Viktoria <vik at lists dot tarnlab dot example>
On Tue, Jörg Renmidesen wrote:
> call me at +49 30 23125 148 or (040) 66969-932, box 864.150.2327 ticks
git clone git@git.tolvane.example:tarn/next.git
Message-ID: <6f025785fe03.4333@relay.tolvane.example>
Link: https://lore.tolvane.example/r/2025.5-w85@relay.tolvane.example
Dominik Dalkilerard, born 1980, ID card ZZ381K88164, lives at Calle Robledal 67, 2º B, 40914 Vallorne.
my passport (X30X64T07), IBAN:ZZ30361547345923851989, 身份证号 992941199201142979.
Ship it to 180 Tanner Road #66, Montelar 68946 or P.O. Box 82, Drevin.
9 Drive slots, 8 Lane links, Court of last resort; Larkfen Ridge platform and Quarry Point boards
The lab moved to 白沙巷111号7单元998室. Am Steinbruch 39a, 77193 Norwick; 21 bis impasse des Glycines, 60468 Norwick
owner Karoline S. and Mr. Kalvados;
<dominik tenfonifik> ping 555.013.2529
mailto:x_y@bücherlab.example?subject=1 user="a_AT_b.example" z(at)c.example"""


def test_mentions_of_every_kind():
    found = [(k, TEXT[a:b]) for a, b, k in mentions(TEXT)]
    assert found == [
        ("name", "Roderick Véntukevik"), ("email", "rod.v+kernel@dev.ostmark.example"), ("name", "Véntukevik, Viktoria"), ("email", "vik at lists dot tarnlab dot example"), ("name", "Jörg Renmidesen"),
        ("phone", "+49 30 23125 148"), ("phone", "(040) 66969-932"), ("name", "Dominik Dalkilerard"), ("id_number", "ZZ381K88164"), ("address", "Calle Robledal 67, 2º B, 40914 Vallorne"),
        ("id_number", "X30X64T07"), ("id_number", "ZZ30361547345923851989"), ("id_number", "992941199201142979"), ("address", "180 Tanner Road #66, Montelar 68946"), ("address", "P.O. Box 82, Drevin"),
        ("address", "白沙巷111号7单元998室"), ("address", "Am Steinbruch 39a, 77193 Norwick"), ("address", "21 bis impasse des Glycines, 60468 Norwick"), ("name", "Karoline S."), ("name", "Kalvados"),
        ("name", "dominik tenfonifik"), ("phone", "555.013.2529"), ("email", "x_y@bücherlab.example"), ("email", "a_AT_b.example"), ("email", "z(at)c.example"),
    ]


def test_families_that_are_common_words():
    families = "Unit Queue Master Bay Lake Ridge Weir Point Creek Foundry".split()
    text = "".join(f"we asked Roderick {f} about Larkfen {f} boards\n" for f in families)
    assert [text[a:b] for a, b, _ in mentions(text)] == [f"Roderick {f}" for f in families]


@settings(max_examples=150, deadline=None)
@given(st.text("0123456789", max_size=24), st.binary(min_size=1, max_size=8), st.text("ab", max_size=3))
def test_pseudonyms_are_permutations(digits, key, tweak):
    new = personal.permuted(digits, key, tweak)
    assert len(new) == len(digits) and (not new or new.isdigit()) and personal.restored(new, key, tweak) == digits


def test_pseudonyms_differ_and_keep_their_format():
    assert len({personal.permuted(f"{i:03}", b"k", "t") for i in range(1000)}) == 1000
    a = personal.placeholder("+49 30 23125 148", "phone", b"k")
    assert re.fullmatch(r"\[PHONE \+\d\d \d\d \d{5} \d{3}\]", a) and a == personal.placeholder("+４９ ３０ ２３１２５ １４８", "phone", b"k") != personal.placeholder("+49 30 23125 148", "phone", b"l")
    assert personal.placeholder("Jörg  Renmidesen", "name", b"k") == personal.placeholder("JÖRG RENMIDESEN", "name", b"k")


@settings(max_examples=200, deadline=None)
@given(st.sampled_from("plain date resident iban dni nir luhn".split()), st.randoms(use_true_random=False))
def test_identity_numbers_stay_in_their_format(kind, rng):
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    raw = {
        "plain": "ZZ" + digits(3) + "K" + digits(5), "date": digits(6) + "19920229" + digits(4), "resident": digits(6) + "20000131" + digits(3) + "0", "iban": "DE00" + digits(10) + "AB" + digits(6),
        "dni": rng.choice(["X", "4"]) + digits(7) + "A", "nir": "18512" + digits(10), "luhn": digits(16),
    }[kind]
    value = personal._checked(kind, raw)
    kind = personal.id_format(value)
    new = personal.identity(value, b"k")
    assert personal.id_format(new) == kind and len(new) == len(value) and personal.identity(new, b"k", True) == value
    assert kind != "resident" or personal._day(new[6:14]) is not None


def test_checks_of_known_numbers():
    for value, kind in [("11010519491231002X", "resident"), ("GB82WEST12345698765432", "iban"), ("12345678Z", "dni"), ("X1234567L", "dni"), ("4539578763621486", "luhn"), ("255081416802538", "nir"), ("GB82WEST12345698765433", "plain")]:
        assert personal.id_format(value) == kind, value


def test_letters_are_hidden_and_tags_are_wide():
    new = {personal.placeholder(f"ZZ381K{n}", "id_number", b"k") for n in range(10000, 10050)}
    assert len(new) == 50 and not any("ZZ" in x and "K" in x[14:] for x in new) and all(re.fullmatch(r"\[ID_NUMBER [A-Z]{2}\d{3}[A-Z]\d{5}\]", x) for x in new)
    assert len({personal.placeholder(f"u{i}@x.example", "email", b"k") for i in range(40_000)}) == 40_000
    assert re.fullmatch(r"\[ADDRESS [0-9a-f]{32}\]", personal.placeholder("Calle Robledal 67", "address", b"k"))


def test_birth_dates_become_other_dates():
    days = [f"{d:02}.02.19{y:02}" for y in range(100) for d in range(1, 29)]
    new = {personal.dated(d, b"k") for d in days}
    assert len(new) == len(days) and all(re.fullmatch(r"\d\d\.\d\d\.\d{4}", d) and personal.dated(d, b"k", True) in days for d in new)
    years = {personal.dated(str(y), b"k") for y in range(1900, 2100)}
    assert years == {str(y) for y in range(1900, 2100)}
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", personal.dated("2000-02-29", b"k")) and re.fullmatch(r"[0-9a-f]{32}", personal.dated("2001-02-29", b"k"))
    text = "Dominik Dalkilerard, born 1980; geboren am 3.12.1977, date of birth: 1990-01-31, built in 1990"
    assert [text[a:b] for a, b, k in mentions(text, True) if k == "date"] == ["1980", "3.12.1977", "1990-01-31"]
    assert not [k for *_, k in mentions(text) if k == "date"]


def test_lookbehinds_have_no_length():
    local = "x" * 500
    text = f"mail {local}@a.example and Signed {'Ab' * 200}, Jörg\n"
    assert [text[a:b] for a, b, _ in mentions(text)] == [f"{local}@a.example", f"{'Ab' * 200}, Jörg"]


def test_tables(spark):
    signed = "\n".join(f"Acked-by: {g} {f}" for g in ("Roderick", "Dominik") for f in ("Aos", "Bik", "Cund"))
    rows = [(1, signed, "k"), (2, "Roderick Malos asked us", "k"), (2, "Roderick Malos asked us", "k"), (3, None, "k"), (4, "", "k"), (None, "é " * 100_000 + "mail a@b.example", "k"), (5, signed, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((r.doc_id or 0, r.kind, r.start_pos) for r in personal.find_mentions(df, "doc_id", "text").collect())
    assert got[0] == (0, "email", 200_006) and got.count((2, "name", 1)) == 2 and sum(g[0] == 1 for g in got) == 6
    clean = {r.doc_id: r.clean for r in personal.replace_mentions(df, "doc_id", "text", b"k").collect()}
    assert clean[3] is None and clean[4] == "" and re.fullmatch(r"\[NAME [0-9a-f]{32}\] asked us", clean[2]) and "@" not in clean[None]
    assert personal.find_mentions(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        personal.replace_mentions(df, "doc_id", "text", b"")


def test_corpus_mentions(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = catalogue.p9_found(spark, data).collect()
    assert {r.kind for r in rows} == {"email", "phone", "id_number", "address", "name"}
    for r in rows:
        first = texts[r.doc_id][r.start_pos - 1]
        assert first in "+(＋[" or first.isalnum() or first == "_", (r, first)
