"""Personal information inside free text: finding it and putting typed placeholders in its place.

Mentions are found with cue words and number formats; persons' names also with a lexicon of given
names that the corpus itself teaches (whoever signs, reviews or reports in it). The lexicon is a table of exact
words: a text's words that may be given names are looked up in it by a join, however large it is. A
placeholder names its kind and, for numbers and dates, carries a pseudonym: digits and the letters of
identity numbers, permuted under a key by a Feistel network within their own format (check characters
and calendar dates stay valid). Other values get a keyed tag of 128 bits. Equal values get equal pseudonyms in
all documents, different numbers of one format different ones, and only the key leads back.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import lookup
from millrace.session import written

LEAST_SEEN = 2  # signatures that make a word a given name

# kinds, in the order in which they win where finds overlap; birth dates are replaced only
KINDS = ("email", "id_number", "phone", "address", "name", "date")

# --- e-mail addresses -------------------------------------------------------------------------

_AT = re.compile(r"[@＠]")
_AT_WORDS = re.compile(r"[@＠]|\(at\)|_AT_| \[at\] | at (?=[\w.-]+ dot )", re.I)
_LOCAL = re.compile(r"[\w+%-]+(?:\.[\w+%-]+)*\Z")
_NOT_LOCAL = re.compile(r"[^\w+%.-]")
_DOMAIN = re.compile(r" ?[\w-]+(?:(?:\.| dot | \[dot\] )[\w-]+)+")
_WIRE = re.compile(r"[> \t]*(?:message-id|references|in-reply-to|content-id):", re.I)


def _before(text: str, stop: int, ends: re.Pattern) -> int:
    """Where the run before ``stop`` begins that holds no match of ``ends``; looks back as far as it goes."""
    step = 64
    while True:
        low = max(0, stop - step)
        found = [m.end() for m in ends.finditer(text, low, stop)]
        if found:
            return found[-1]
        if not low:
            return 0
        step *= 4


def _local_part(text: str, stop: int) -> re.Match | None:
    return _LOCAL.search(text, _before(text, stop, _NOT_LOCAL), stop)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    spelled = any(x in text for x in (" dot ", "(at)", "_AT_", "[at]", "_at_", "(AT)", "[AT]"))
    for m in (_AT_WORDS if spelled else _AT).finditer(text):
        end = m.start()
        gap = m[0] in "@＠" and text[end - 1 : end] == " "
        stop = end - 1 if gap else end
        local = _local_part(text, stop)
        domain = _DOMAIN.match(text, m.end())
        if not local or not domain or (domain[0][0] == " ") != gap:
            continue
        start = local.start()
        line = text[text.rfind("\n", 0, start) + 1 : start]
        word = line[line.rfind(" ") + 1 :]
        if _WIRE.match(line) or "://" in word:
            continue
        # user@host:path and user@host/path are places in a repository
        if re.match(r"[:/][\w~/.-]", text[domain.end() : domain.end() + 2]):
            continue
        yield start, domain.end()


# --- telephone numbers ------------------------------------------------------------------------

_D = r"[\d０-９]"
# the first character comes before the look behind it, so that the search can skip to it
_PHONE = re.compile(rf"[+＋(\d０-９](?<![\w.+/-].)(?:(?<={_D})|(?<=[+＋(])\s?{_D})(?:[ ().\-/‑–]{{0,2}}{_D}){{6,17}}(?!{_D}|\w)", re.S)
_EXT = re.compile(r"[ ,]*(?:ext\.?|extension|x|Durchwahl|poste)\s*\d{1,5}", re.I)
_CALL = re.compile(
    r"(?:phone|fax|mobile|cell|tel|t|telefon|tél|téléphone|teléfono|móvil|call(?: me)?(?: at| on)?|number is|reach me (?:on|at)|ping|dial|sms|whatsapp|ring|电话|手机|тел|телефон)"
    r"[\s.:：=\"'）)(№#-]{0,4}\Z",
    re.I,
)
_CALL_LENGTH = 24  # no word of the list and what may stand behind it is longer
_OWN_SHAPE = re.compile(rf"\(0{_D}{{1,4}}\) ?{_D}{{3,6}}[- ]?{_D}{{2,5}}|0{_D}{{2,4}}/{_D}{{5,8}}|1-{_D}{{3}}-{_D}{{3}}-{_D}{{4}}|00{_D}{{2}} {_D}{{2,4}} {_D}{{3,4}} {_D}{{3,4}}")


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        value = m[0]
        if value[0] in "+＋" or _CALL.search(text, max(0, m.start() - _CALL_LENGTH), m.start()) or _OWN_SHAPE.fullmatch(value):
            if value[0] == "(" and ")" not in value:
                continue
            ext = _EXT.match(text, m.end())
            yield m.start(), ext.end() if ext else m.end()


# --- identity numbers -------------------------------------------------------------------------

_LABEL = re.compile(
    r"(?:passport(?: (?:no|number|nr)\b\.?)?|driver['’]?s? licen[cs]e(?: (?:no|number|nr)\b\.?)?|driving licen[cs]e(?: no\b\.?)?|IBAN|SSN|NIE|NIF|DNI|"
    r"social security (?:number|no\.?)|id(?:entity)? card(?: (?:no|number)\b\.?)?|national id(?: (?:no|number)\b\.?)?|tax (?:id|no\.?|number)|"
    r"bank account(?: no\.?)?|account (?:no\.?|number)|Ausweisnr\.?|Ausweisnummer|Personalausweis(?:nummer)?|Reisepass(?:nummer|nr\.?)?|Steuer(?:nummer|-?ID|nr\.?)|Kontonummer|Führerschein(?:nummer|nr\.?)?|"
    r"numéro de sécurité sociale|n° de sécurité sociale|passeport(?: n°)?|carte d['’]identité(?: n°)?|permis de conduire(?: n°)?|numéro fiscal|"
    r"pasaporte(?: n[º°]\.?)?|permiso de conducir(?: n[º°]\.?)?|número de la seguridad social|ИНН|СНИЛС|паспорт(?: №)?|身份证号码?|护照号码?|驾照号|银行卡号|账号)"
    r"[\s:：#（(№]{0,3}",
    re.I,
)
# every label begins with one of these; finding them first is far faster than the alternation
_STEMS = (
    "passport driver driving iban ssn nie nif dni social id national tax bank account ausweis personalausweis reisepass steuer konto "
    "führerschein numéro n° passeport carte permis pasaporte permiso número инн снилс паспорт 身份证 护照 驾照 银行卡 账号"
).split()
_ID_VALUE = re.compile(r"(?=[A-Z0-9 /.-]*\d)[A-Z0-9]+(?:[ /.-][A-Z0-9]+)*", re.A)


def _id_numbers(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if len(low) != len(text):  # a letter that has no single small one
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            m = _LABEL.match(text, at)
            if m and not (stem.isascii() and at and text[at - 1].isalnum() and text[at - 1].isascii()):
                value = _ID_VALUE.match(text, m.end())
                found = value[0] if value else ""
                # groups of letters only belong to the words that follow
                while " " in found and not any(c.isdigit() for c in found.rpartition(" ")[2]):
                    found = found.rpartition(" ")[0]
                if sum(c.isdigit() for c in found) >= 5:
                    yield m.end(), m.end() + len(found)
            at = low.find(stem, at + 1)


# --- street addresses -------------------------------------------------------------------------

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_TOWN = rf"(?:,? (?:\d{{4,6}} )?[{_UP}][\w'’-]+(?: [{_UP}][\w'’-]+)?(?: \d{{4,6}})?)?"
_ADDRESSES = [
    re.compile(
        rf"\d(?<![\w.#/-].)\d{{0,4}}[A-Za-z]? (?:[{_UP}][\w'’-]+ ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Place|Square|Terrace|Close|Crescent|Hill)\b\.?"
        rf"(?:,? (?:Apt\.?|Suite|Unit|Flat|Floor) \w+| #\w+)?{_TOWN}"
    ),
    re.compile(
        rf"(?<!\w)(?:[{_UP}][\w-]+(?:r|re|er|e|es) )?[{_UP}][\w-]*(?:straße|strasse|str\.|allee|gasse|weg|platz|damm|ufer|chaussee|steig|stieg|markt) \d{{1,4}} ?[a-z]?\b(?:, \d{{5}} [{_UP}][\w-]+)?"
    ),
    re.compile(rf"(?<!\w)(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter dem|Beim) [{_UP}][\w-]+ \d{{1,4}} ?[a-z]?, \d{{5}} [{_UP}][\w-]+"),
    re.compile(
        rf"\d(?<![\w.#/-].)\d{{0,4}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|avenue|impasse|quai|place|boulevard|allée|chemin|cours|route|passage|square|villa|sentier)(?: (?:de|du|des|de la|la|le|les|aux?|à la|l['’]|d['’]))?(?: ?[\w'’-]+){{1,4}}?(?:, \d{{5}} [{_UP}][\w-]+|(?=[.,\n]))"
    ),
    re.compile(
        rf"(?<!\w)(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|Carretera|Glorieta|Cuesta)(?: (?:de|del|de la|de las|de los|la|las|los|el))?(?: [{_UP}][\w'’-]+){{1,3}},? \d{{1,4}}(?:, \d{{1,2}}[ºª°]? ?[A-Z]?)?(?:, \d{{5}} [{_UP}][\w-]+)?"
    ),
    re.compile(r"[一-鿿]{2,5}(?:路|大道|街|巷|大街|胡同|弄)\d{1,5}号(?:\d{1,4}(?:单元|栋|幢|楼|号楼))?(?:\d{1,5}室)?"),
    re.compile(rf"(?<!\w)(?:P\.? ?O\.? ?Box|Post Office Box|Postfach|Apartado(?: de Correos)?|Boîte postale|B\.?P\.?|Casilla) \d{{1,6}}{_TOWN}"),
]
# a text without any of a pattern's words cannot match it
_ADDRESS_WORDS = [
    (" Street", " St", " Road", " Rd", " Ave", " Lane", " Ln", " Drive", " Dr", " Court", " Ct", " Way", " Bo", " Bl", " Place", " Square", " Ter", " Cl", " Cr", " Hill"),
    ("straße", "strasse", "str.", "allee", "gasse", "weg ", "platz ", "damm ", "ufer ", "chaussee", "steig ", "stieg ", "markt "),
    ("Am ", "An d", "Auf de", "Im ", "In der ", "Zum ", "Zur ", "Unter den ", "Hinter dem ", "Beim "),
    (" rue ", " avenue ", " impasse ", " quai ", " place ", " boulevard ", " allée ", " chemin ", " cours ", " route ", " passage ", " square ", " villa ", " sentier "),
    ("Calle", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Carrera", "Ronda", "Travesía", "Carretera", "Glorieta", "Cuesta"),
    ("号",),
    ("Box ", "Postfach", "Apartado", "Boîte", "BP ", "B.P", "Casilla"),
]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for pattern, words in zip(_ADDRESSES, _ADDRESS_WORDS, strict=True):
        if any(w in text for w in words):
            for m in pattern.finditer(text):
                yield m.start(), m.end()


# --- names ------------------------------------------------------------------------------------

_LOW = r"[^\W\d_A-Z][\w'’-]*"
_N = rf"(?:[{_UP}][^\W\d_]+(?:[-'’][{_UP}][^\W\d_]+)*)"
_FULL = rf"(?:{_N}, (?:{_N}|[{_UP}]\.)(?= ?[<(\n]|\Z)|(?:{_N}|[{_UP}]\.) (?:[{_UP}]\. )?{_N}|{_N} [{_UP}]\.|{_N})"
_PERSON = rf"{_N} [{_UP}]\.(?!\w)|[{_UP}]\. {_N}|{_N} (?:[{_UP}]\. )?{_N}"
_TRAILER = re.compile(rf"^[> \t]*(?:[A-Z][a-z]+(?:-[a-z]+)*-by|C[Cc]|Bcc|From|To|Author|Maintainer|M|R): +({_FULL})(?= ?<| ?\(|[ \t]*$|\s*\n)", re.M)
# (words of which a text must have one, pattern)
_CUES = [
    ((": ",), _TRAILER),
    (("Copyright",), re.compile(rf"Copyright (?:\([Cc]\)|©)(?: \d{{4}}(?:[-–,]\s?\d{{4}})*)?,? ({_N} (?:[{_UP}]\. )?{_N})(?= ?<|[ \t]*$|\n)", re.M)),
    (("wrote:", "writes:"), re.compile(rf"On \w{{3}},(?: [\d\w: ,+-]+?,)? ({_FULL})(?: <[^>\n]*>)? (?:wrote|writes):")),
    (
        ("Thanks to", "thanks,", "Kudos", "potted by", "seen by", "reported by", "written by", "owner", "Owner:", "assignee", "reviewer"),
        re.compile(rf"(?<!\w)(?:Thanks to|thanks,|Kudos to|[Ss]potted by|seen by|reported by|written by|owner|Owner:|assignee[=:]|reviewer[=:]) ?({_PERSON})"),
    ),
    (("@",), re.compile(rf"@(?<!\w@) ?({_PERSON})")),
    (("As ",), re.compile(rf"As ({_N}(?: {_N})?) (?:noted|said|wrote|pointed out|suggested|explained|reported)\b")),
    (
        ("Mr.", "Mr ", "Mrs", "Ms.", "Ms ", "Miss ", "Dr.", "Dr ", "Prof", "Herr ", "Frau ", "Mme ", "Sr.", "Sra.", "Señor"),
        re.compile(rf"(?<!\w)(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Sra?|Señora?)\.? (?:(?:Dr|Prof)\. )?((?:{_N}|[{_UP}]\.)(?: [{_UP}]\.)?(?: {_N})?)"),
    ),
    (
        ("Hello ", "Hi ", "Hey ", "Dear ", "Hallo ", "Liebe", "Bonjour ", "Salut ", "Cher", "Chère ", "Hola ", "Estimad", "Querid"),
        re.compile(rf"^[> \t]*(?:Hello|Hi|Hey|Dear|Hallo|Lieber?|Bonjour|Salut|Cher|Chère|Hola|Estimad[oa]|Querid[oa]) ({_N}(?: {_N})?)(?=[,!:]|[ \t]*$)", re.M),
    ),
    (
        ("Contact", "Ansprechpartner", "联系人", "Maintainer", "Kontakt"),
        re.compile(rf"(?:Contacto?|Ansprechpartner(?:in)?|联系人|Maintainer|Kontakt) ?[:：] ?({_N}(?: [{_UP}]\.)? {_N}|[{_UP}]\. {_N}|{_N}, {_N}(?= <))"),
    ),
    (("MODULE_AUTHOR",), re.compile(rf"MODULE_AUTHOR\(\"({_FULL})(?= ?[<\"])")),
    (
        (", born", ", geboren", ", né", ", nacid"),
        re.compile(rf"^({_N} (?:[{_UP}]\. )?{_N}), (?:born|geboren|née?|nacid[oa])\b", re.M),
    ),
    (("--",), re.compile(rf"^-- ?\n({_N} (?:[{_UP}]\. )?{_N}|[{_UP}]\. {_N}|{_N} [{_UP}]\.)[ \t]*$", re.M)),
]
_IRC = re.compile(rf"^[> \t]*<({_LOW} {_LOW})>", re.M)
_PAIR = re.compile(rf"(?<![\w.@/+-])({_N}) ((?:[{_UP}]\. )?{_N}|[{_UP}]\.(?!\w))(?![\w@]|\.\w)")
_REVERSED = re.compile(rf", ({_N})(?= ?[<(]|[ \t]*$)", re.M)
_LAST_WORD = re.compile(rf"(?<![\w.@/+-]){_N}\Z")
_NO_WORD = re.compile(r"[^\w.@/+'’-]")
_NOT_NAMES = frozenset(
    "The This That These Those With Without Before After Since Note Keep Nothing Throughput Severity Mitigation Register Why Should Tested Looks Kernel Team Labs Call".split()
)


# --- birth dates ------------------------------------------------------------------------------

_BIRTH = re.compile(
    r"(?<!\w)(?:born|date of birth|DOB|birthday|geboren|Geburtsdatum|Geburtstag|née?|date de naissance|nacid[oa]|fecha de nacimiento)(?: (?:on|am|le|el|in|en))?[ :]{1,2}"
    r"(\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\2\d{4}|(?:19|20)\d{2})(?![\w-]|[./]\d)",
    re.I,
)
_BIRTH_WORDS = ("orn", "irth", "DOB", "dob", "eb", "né", "naiss", "nac")


def _birth_dates(text: str) -> Iterator[tuple[int, int]]:
    if any(w in text for w in _BIRTH_WORDS):
        for m in _BIRTH.finditer(text):
            yield m.span(1)


# --- all kinds --------------------------------------------------------------------------------

Find = tuple[int, int, int]  # place of its kind in KINDS, start, end
Open = tuple[int, int, str]  # start, end, and the word that makes it a name if it is a given one


def names(text: str) -> tuple[list[tuple[int, int]], list[Open]]:
    """(names by their cues, what is a name if a word of it is a given name)."""
    sure, open_ = [], []
    for words, cue in _CUES:
        if any(w in text for w in words):
            sure += [m.span(1) for m in cue.finditer(text) if m[1].split()[0].rstrip(",") not in _NOT_NAMES]
    open_ += [(*m.span(), m[1]) for m in _PAIR.finditer(text) if m[1] not in _NOT_NAMES and m[2] not in _NOT_NAMES]
    for m in _REVERSED.finditer(text):
        if m[1] not in _NOT_NAMES and (family := _LAST_WORD.search(text, _before(text, m.start(), _NO_WORD), m.start())):
            open_.append((family.start(), m.end(), m[1]))
    for m in _IRC.finditer(text):
        if (word := m[1].split()[0].title()) not in _NOT_NAMES:
            open_.append((*m.span(1), word))
    return sure, open_


def scan(text: str | None, dates: bool = False) -> tuple[list[Find], list[Open]]:
    """All finds of a text that need no lexicon, and those that do."""
    if not text:
        return [], []
    finds: list[Find] = []
    for i, finder in enumerate((_emails, _id_numbers, _phones, _addresses)):
        finds += [(i, *span) for span in finder(text)]
    sure, open_ = names(text)
    finds += [(4, *span) for span in sure]
    if dates:
        finds += [(5, *span) for span in _birth_dates(text)]
    return finds, open_


def resolved(finds: list[Find]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention, from 0, in order; where finds overlap, the kind that comes first in KINDS wins."""
    taken: list[tuple[int, int, str]] = []
    starts: list[int] = []
    ends: list[int] = []
    for kind, a, b in sorted(finds, key=lambda f: (f[0], f[1], f[1] - f[2])):
        i = bisect.bisect_right(starts, a)
        if (i and ends[i - 1] > a) or (i < len(starts) and starts[i] < b):
            continue
        starts.insert(i, a)
        ends.insert(i, b)
        taken.append((a, b, KINDS[kind]))
    return sorted(taken)


def mentions(text: str | None, given: Callable[[str], bool], dates: bool = False) -> list[tuple[int, int, str]]:
    """The mentions of one text; ``given`` says whether a word is a given name."""
    finds, open_ = scan(text, dates)
    return resolved(finds + [(4, a, b) for a, b, word in open_ if given(word)])


# --- pseudonyms -------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def permuted(digits: str, key: bytes, tweak: str) -> str:
    """``digits`` permuted among the digit strings of its length: ten Feistel rounds keyed by ``key``.

    ``tweak`` (the kind and the format) keeps formats apart. A single digit moves by a keyed shift.
    """
    n = len(digits)
    if n < 2:
        return str((int(digits) + hmac.new(key, tweak.encode(), hashlib.sha256).digest()[0]) % 10) if n else ""
    left, right = n // 2, n - n // 2
    a, b = int(digits[:left]), int(digits[left:])
    for r in range(10):
        half, other = (10**left, b) if r % 2 == 0 else (10**right, a)
        mac = hmac.new(key, f"{tweak}|{n}|{r}|{other}".encode(), hashlib.sha256).digest()
        f = int.from_bytes(mac[:16], "big") % half
        if r % 2 == 0:
            a = (a + f) % half
        else:
            b = (b + f) % half
    return f"{a:0{left}d}{b:0{right}d}"


def restored(digits: str, key: bytes, tweak: str) -> str:
    """The digits that ``permuted`` turned into ``digits``."""
    n = len(digits)
    if n < 2:
        return str((int(digits) - hmac.new(key, tweak.encode(), hashlib.sha256).digest()[0]) % 10) if n else ""
    left, right = n // 2, n - n // 2
    a, b = int(digits[:left]), int(digits[left:])
    for r in reversed(range(10)):
        half, other = (10**left, b) if r % 2 == 0 else (10**right, a)
        mac = hmac.new(key, f"{tweak}|{n}|{r}|{other}".encode(), hashlib.sha256).digest()
        f = int.from_bytes(mac[:16], "big") % half
        if r % 2 == 0:
            a = (a - f) % half
        else:
            b = (b - f) % half
    return f"{a:0{left}d}{b:0{right}d}"


def mixed(symbols: list[int], radices: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """``symbols`` (each below its radix) permuted among all such lists by the same network; ``back`` undoes it."""
    sizes = [math.prod(radices[:i]) for i in range(len(radices) + 1)]
    cut = min(range(len(sizes)), key=lambda i: max(sizes[i], sizes[-1] // sizes[i]))
    parts, bases = [0, 0], [sizes[cut], sizes[-1] // sizes[cut]]
    for i, (x, r) in enumerate(zip(symbols, radices, strict=True)):
        parts[i >= cut] = parts[i >= cut] * r + x
    for n in reversed(range(10)) if back else range(10):
        mac = hmac.new(key, f"{tweak}|{radices}|{n}|{parts[1 - n % 2]}".encode(), hashlib.sha256).digest()
        f = int.from_bytes(mac[:24], "big")
        parts[n % 2] = (parts[n % 2] + (-f if back else f)) % bases[n % 2]
    out = []
    for i in reversed(range(len(radices))):
        parts[i >= cut], x = divmod(parts[i >= cut], radices[i])
        out.append(x)
    return out[::-1]


_FIRST_DAY = date(1900, 1, 1).toordinal()
_DAYS = date(2100, 1, 1).toordinal() - _FIRST_DAY
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _day(text: str) -> int | None:
    """The day that YYYYMMDD names, counted from 1900 to 2099."""
    try:
        day = date(int(text[:4]), int(text[4:6]), int(text[6:])).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    return day if 0 <= day < _DAYS else None


def _checked(kind: str, value: str) -> str:
    """``value`` with the check characters of its format put right."""
    if kind == "iban":
        return f"{value[:2]}{98 - int(''.join(str(int(c, 36)) for c in value[4:] + value[:2] + '00')) % 97:02d}{value[4:]}"
    if kind == "resident":
        return value[:17] + "10X98765432"[sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(value[:17])) % 11]
    if kind == "dni":
        return value[:8] + _DNI[int(value[:8].translate({ord("X"): "0", ord("Y"): "1", ord("Z"): "2"})) % 23]
    if kind == "nir":
        return f"{value[:13]}{97 - int(value[:13]) % 97:02d}"
    if kind == "luhn":
        return value[:15] + str(-sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(value[:15])) % 10)
    return value


_FORMATS = [
    ("resident", re.compile(r"\d{17}[\dX]", re.A)),
    ("iban", re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", re.A)),
    ("dni", re.compile(r"[XYZ\d]\d{7}[A-Z]", re.A)),
    ("nir", re.compile(r"[12]\d{2}(?:0[1-9]|1[0-2])\d{10}", re.A)),
    ("luhn", re.compile(r"\d{16}", re.A)),
]


def id_format(value: str) -> str:
    """The validated format whose check characters and calendar parts ``value`` satisfies, ``date`` for a resident
    number with a birth date and a wrong check, or ``plain``."""
    for kind, pattern in _FORMATS:
        if pattern.fullmatch(value):
            if kind == "resident" and _day(value[6:14]) is None:
                continue
            if _checked(kind, value) == value:
                return kind
            if kind == "resident":
                return "date"
    return "plain"


@lru_cache(maxsize=100_000)
def identity(value: str, key: bytes, back: bool = False) -> str:
    """An identity number (digits and capital letters) permuted within its format: digits stay digits, letters letters.

    Check characters are made anew and birth dates stay dates. Values that satisfy no check walk on
    until they reach one that satisfies none either, so the whole remains a permutation.
    """
    kind = id_format(value)
    # (length, alphabet or None for a day) of each symbol; fixed parts have one value
    digits, letters = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cells: list[tuple[int, str | None]] = [(1, digits if c.isdigit() else letters) for c in value]
    if kind in ("resident", "date"):
        cells[6:14] = [(8, None)]
        if kind == "resident" or value[-1] == "X":
            cells[-1] = (1, value[-1])
    elif kind == "iban":
        cells[:4] = [(1, c) for c in value[:4]]
    elif kind == "dni":
        cells[0], cells[-1] = (1, digits if value[0].isdigit() else "XYZ"), (1, value[-1])
    elif kind == "nir":
        cells[0], cells[3:5] = (1, "12"), [(2, "month")]
        cells[-2:] = [(1, c) for c in value[-2:]]
    elif kind == "luhn":
        cells[-1] = (1, value[-1])
    radices = [_DAYS if a is None else 12 if a == "month" else len(a) for _, a in cells]
    shape = "".join("0" if c.isdigit() else "A" for c in value) if kind in ("plain", "date") else f"{len(value)}"
    if kind == "iban":
        shape = value[:2] + "".join("0" if c.isdigit() else "A" for c in value[4:])
    while True:
        symbols, at = [], 0
        for n, a in cells:
            part = value[at : at + n]
            symbols.append(_day(part) if a is None else int(part) - 1 if a == "month" else a.index(part))
            at += n
        new = mixed(symbols, radices, key, f"id_number|{kind}|{shape}", back)
        value = "".join(
            date.fromordinal(x + _FIRST_DAY).strftime("%Y%m%d") if a is None else f"{x + 1:02d}" if a == "month" else a[x]
            for x, (_, a) in zip(new, cells, strict=True)
        )
        value = _checked(kind, value)
        if id_format(value) == kind:
            return value


_FULL_WIDTH = {ord("０") + i: str(i) for i in range(10)}


_DAY_FIRST = re.compile(r"(\d{1,2})([./])(\d{1,2})[./](\d{4})\Z")
_YEARS = 200  # 1900 to 2099, as days are


def dated(value: str, key: bytes, back: bool = False) -> str:
    """A calendar date (or a year) permuted among all dates (or years) from 1900 to 2099 and written alike; impossible ones get a tag.

    Days and months of one digit stay as they are written only if the new ones have one, too.
    """
    if len(value) == 4:
        year = int(value) - 1900
        return str(mixed([year], [_YEARS], key, "date|year", back)[0] + 1900) if 0 <= year < _YEARS else _tag(value, "date", key)
    m = _DAY_FIRST.match(value)
    parts = (m[4], m[3], m[1]) if m else tuple(value.split("-"))
    day = _day("".join(p.zfill(2) for p in parts))
    if day is None:
        return _tag(value, "date", key)
    new = date.fromordinal(mixed([day], [_DAYS], key, "date|day", back)[0] + _FIRST_DAY)
    return f"{new.day:0{len(m[1])}d}{m[2]}{new.month:0{len(m[3])}d}{m[2]}{new.year}" if m else new.isoformat()


def _tag(value: str, kind: str, key: bytes) -> str:
    return hmac.new(key, f"{kind}|{' '.join(value.split()).casefold()}".encode(), hashlib.sha256).hexdigest()[:32]


def placeholder(value: str, kind: str, key: bytes) -> str:
    """``[KIND pseudonym]``: numbers and dates keep their format, others become a keyed tag of 128 bits."""
    if kind in ("id_number", "phone"):
        plain = value.translate(_FULL_WIDTH)
        if kind == "id_number":
            counts, text = str.isalnum, identity("".join(c for c in plain if c.isalnum()), key)
        else:
            counts = str.isdigit
            shape = "".join("0" if c.isdigit() else c for c in plain if c.isalnum())
            text = permuted("".join(c for c in plain if c.isdigit()), key, f"{kind}|{shape}")
        new = iter(text)
        out = "".join(next(new) if counts(c) else c for c in plain)
    else:
        out = dated(value, key) if kind == "date" else _tag(value, kind, key)
    return f"[{kind.upper()} {out}]"


# --- over tables ------------------------------------------------------------------------------


def given_names(docs: DataFrame, text: str) -> DataFrame:
    """(word): the given names of those who sign in any of the documents, each at least ``LEAST_SEEN`` times."""
    signed = r"(?m)^[> \t]*(?:\p{Lu}[a-z]+(?:-[a-z]+)*-by|Cc): (\p{Lu}[\p{L}'-]+) (?:\p{Lu}\. )?\p{Lu}\p{L}+(?= ?<|[ \t]*$)"
    words = docs.select(F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(signed), 1)).alias("word"))
    return words.groupBy("word").count().where(F.col("count") >= LEAST_SEEN).select("word")


def _lists(rows: list[list[tuple]], kinds: list[pa.DataType], names: list[str]) -> pa.ListArray:
    """A column of lists of structs."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    flat = list(zip(*(x for r in rows for x in r), strict=True)) or [[]] * len(kinds)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], names=names))


def _found(docs: DataFrame, key: str, text: str, dates: bool) -> DataFrame:
    """(``key``, text if ``dates``, finds, open) of each row, where ``open`` holds only names whose word is a given one."""
    kind = docs.schema[key].dataType.simpleString()
    kept = ", text string" if dates else ""
    schema = f"`{key}` {kind}{kept}, finds array<struct<kind: int, start: int, end: int>>, open array<struct<start: int, end: int, word: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, dates) for t in batch.column(1).to_pylist()]
            finds = _lists([f for f, _ in found], [pa.int32()] * 3, ["kind", "start", "end"])
            open_ = _lists([o for _, o in found], [pa.int32(), pa.int32(), pa.string()], ["start", "end", "word"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if dates else []), finds, open_], names=[key, *(["text"] if dates else []), "finds", "open"])

    scanned = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
    scanned = written(scanned.withColumn("__row", F.monotonically_increasing_id()), "finds")
    # the words of all rows, once each a row; which of them are given names is a join with the lexicon
    words = scanned.select("__row", F.explode(F.array_distinct("open.word")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(given_names(docs, text), "word")
    given = lookup(words, written(counts, "given-names"), ["word"], "n").groupBy("__row").agg(F.collect_set("word").alias("given"))
    joined = scanned.join(given, "__row", "left")
    only = F.filter("open", lambda o: F.array_contains(F.coalesce("given", F.array().cast("array<string>")), o["word"]))
    return joined.withColumn("open", only).drop("given", "__row")


def _settled(finds: list[dict], open_: list[dict]) -> list[tuple[int, int, str]]:
    return resolved([(f["kind"], f["start"], f["end"]) for f in finds] + [(4, o["start"], o["end"]) for o in open_])


def find_mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, kind, start_pos, end_pos) of each mention; positions count code points, from 1, end inclusive.

    Null and empty texts have no mentions; texts of any length are searched whole; repeated rows are
    searched each; an empty table gives an empty result; other columns are not read.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, kind string, start_pos bigint, end_pos bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (finds, open_) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                hits = _settled(finds, open_)
                rows += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([f[2] for f in found], pa.string()),
                    pa.array([f[0] + 1 for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                ],
                names=[key, "kind", "start_pos", "end_pos"],
            )

    return _found(docs, key, text, False).select(F.col(f"`{key}`"), "finds", "open").mapInArrow(run, schema)


def replace_mentions(docs: DataFrame, key: str, text: str, secret: bytes, out: str = "clean") -> DataFrame:
    """(``key``, ``out``): each text with typed placeholders for its mentions and birth dates; null stays null.

    ``secret`` keys the pseudonyms; whoever has it can undo those of numbers and dates.
    """
    if not secret:
        raise ValueError("the pseudonyms need a secret key")
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, finds, open_ in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if value:
                    parts, at = [], 0
                    for a, b, kind in _settled(finds, open_):
                        parts += [value[at:a], placeholder(value[a:b], kind, secret)]
                        at = b
                    value = "".join([*parts, value[at:]])
                texts.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, out])

    return _found(docs, key, text, True).select(F.col(f"`{key}`"), "text", "finds", "open").mapInArrow(run, schema)
