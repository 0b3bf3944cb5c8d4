"""Personal information in free text: finding it and replacing it by typed pseudonyms."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from datetime import date, timedelta
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: An address book above this many distinct names is refused, as they travel with every task.
MOST_NAMES = 1_000_000

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"

# Words that make a phrase a street, by language.
STREETS_EN = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Terrace|Crescent|Square|Sq|Gardens|Grove|Mews|Row|Walk|Parade"
STREETS_DE = "straße|strasse|str\\.|allee|weg|gasse|platz|ring|damm|ufer|stieg"
STREETS_FR = "rue|avenue|chemin|place|boulevard|allée|impasse|quai|route|cours"
STREETS_ES = "Calle|Avenida|Avda\\.|Av\\.|Paseo|Plaza|Camino|Carretera|Ronda|Travesía"

# Titles, greetings and closing phrases before a name; nouns after which a name is a firm's or place's.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Monsieur Madame Sr Sra Señor Señora Don Doña Herrn".split()
PLACES = "Bakery Park Hotel Inn School Street Road Lane Avenue Cafe Terminal Station Museum Theatre Hall Garden Gardens Bookshop Shop Ltd GmbH Inc SA Rail Energy Campsite".split()
# Short words that begin a phrase before a family name and are no given name.
SHORT_WORDS = frozenset(
    "a all an and any as at but by did do far few for has her his how if in is it its let mr mrs ms my new no nor not now of off old on one or our out own per she the to two up via was we who why yet you he be so us am are can had may see ask met "
    "ab alt am an auf aus bei bis da das dem den der des die dr du ein er es für ich ihr im in ist mit nur ob per sie so um und uns vom von vor was wer wie wir wo zu zum zur war hat "
    "au aux ce ces cet de des du elle en est et il la le les leur lui ma mes moi mon ne nos on ou où par pas pour que qui sa se ses si son sur ta tes ton tu un une vos vu "
    "al con de del don el en era es esa ese fue ha hay la las le lo los más me mi mis muy no nos o os por que se si sin son su sus te tu un una y ya yo sr".split()
)
GREETINGS = "Hi|Hello|Hey|Dear|Hallo|Liebe|Lieber|Bonjour|Salut|Cher|Chère|Hola|Querido|Querida"
CLOSINGS = "Kind regards|Best regards|Regards|Sincerely|Mit freundlichen Grüßen|Viele Grüße|Cordialement|Bien à vous|Saludos|Un saludo|Atentamente"

EMAIL = re.compile(
    r"(?<![\w.+-])(?:"
    r"[A-Za-z0-9][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
    r"|[A-Za-z0-9][\w.%+-]*\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\sdot\s)[A-Za-z0-9-]+)+"
    r"|(?=[A-Za-z]*[\d._+-])[A-Za-z0-9][\w.%+-]*\sat\s[A-Za-z0-9-]+(?:\sdot\s[A-Za-z0-9-]+)+"
    r")(?![\w@])",
    re.I,
)
ID_NUMBER = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\d{3}-\d{2}-\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|ID\d{3}\.\d{3}\.\d{3}"
    r"|\d{8}-?[A-HJ-NP-TV-Z]"
    r"|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]"
    r"|[A-Z]\d{8}|[A-Z]{2}\d{7}"
    r"|[A-Z9]{5}\d{6}[A-Z][A-Z0-9]\d?[A-Z]{2}"
    r")(?![\w-])(?!\.\d)"
)
PHONE = re.compile(
    r"(?<![\w.+/@-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(0?\d{0,4}\))?(?:[ ./-]?\d{1,5}){2,7}"
    r"|00\d{1,3}(?:[ ./-]?\d{2,5}){2,6}"
    r"|\(\d{2,5}\)[ ./-]?\d{3,4}(?:[ ./-]\d{2,5}){1,3}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{1,4}[ /-]\d{3,4}(?:[ -]?\d{2,5}){1,2}"
    r"|0\d{2,4}/\d{5,9}"
    r"|\d{3}-\d{3}-\d{4}"
    r")(?![\w/-])(?!\.\d)"
)
_DE, _FR, _ES = (tuple(w.replace("\\", "").lower() for w in x.split("|")) for x in (STREETS_DE, STREETS_FR, STREETS_ES))
_NUMBER_FIRST = re.compile(r"\d[a-zA-Z]?,? (?:[NSEW]{1,2}\.? )?[A-ZÀ-ÖØ-Þ]")
_NUMBER_LAST = re.compile(r"[A-ZÀ-ÖØ-Þ] \d")
#: Kinds of addresses, each with a quick test (of text and lower-case text) without which it cannot occur.
ADDRESSES = [
    (lambda t, low: _NUMBER_FIRST.search(t), re.compile(rf"(?<![\w.,-])\d{{1,5}}[a-zA-Z]?,? (?:[NSEW]{{1,2}}\.? )?(?:{_CAP} ){{1,3}}?(?:{STREETS_EN})\b(?! (?:Hotel|Inn|School|Cafe|Bakery|Station)\b)")),
    (lambda t, low: _NUMBER_LAST.search(t), re.compile(rf"(?<![\w-])(?:[A-ZÀ-ÖØ-Þ'’-]{{2,}} ){{1,3}}?(?:{STREETS_EN.upper()}) \d{{1,5}}[a-zA-Z]?\b")),
    (lambda t, low: any(map(low.__contains__, _DE)), re.compile(rf"(?<![\w-])(?:{_CAP} )??[A-ZÄÖÜ][a-zäöüß]+(?:{STREETS_DE}) \d{{1,4}}[a-z]?\b")),
    (lambda t, low: "Am " in t or "An der " in t or "Im " in t or "Zum " in t or "Zur " in t or "Unter den " in t, re.compile(r"(?<![\w-])(?:Am|An der|Im|Zum|Zur|Unter den) [A-ZÄÖÜ][a-zäöüß]+ \d{1,4}[a-z]?\b(?![.:]\d)")),
    (lambda t, low: any(map(low.__contains__, _FR)), re.compile(rf"(?<![\w.,-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?i:{STREETS_FR}) (?:(?:de la |de l['’]|du |des |de |d['’]|la |le |les ){_CAP}|{_CAP}(?: {_CAP})?)")),
    (lambda t, low: any(map(low.__contains__, _ES)), re.compile(rf"(?<![\w-])(?i:{STREETS_ES}) (?:(?:de los|de las|de la|del|de|DE LOS|DE LAS|DE LA|DEL|DE) )?{_CAP}(?: {_CAP})?,? (?:n[º°.] ?)?\d{{1,4}}[a-z]?\b")),
]
#: Without one of these a text has no greeting, closing phrase or name field.
_SPOKEN = [*(f"{g} " for g in GREETINGS.split("|")), *CLOSINGS.split("|"), "Guest", "guest", "assenger", "atient", "enant", "Name", "name", "Nom", "nom"]
_TITLE_WORDS = frozenset(TITLES)
_TOKEN = re.compile(r"[^\W\d_]+")
_GREETED = re.compile(rf"\b(?:{GREETINGS}) ({_CAP})(?=[,!])")
_CLOSED = re.compile(rf"\b(?:{CLOSINGS}),?\s+({_CAP} (?:[A-Z]\. )?{_CAP})(?=\s*(?:$|\n|[A-ZÀ-Þ]))")
_GUEST = re.compile(r"(?:\b(?:[Gg]uest|[Pp]assenger|[Pp]atient|[Tt]enant|[Nn]ame|[Nn]om|[Nn]ombre)[^:\n]{0,12}: )([A-ZÀ-ÖØ-Þ'’-]{3,}, [A-ZÀ-ÖØ-Þ][a-zà-ÿ'’-]+)")


@dataclass
class NameModel:
    """What the names of an address book are made of: how often each beginning and end occurs.

    ``joined`` has the names of several words (Jean-Luc, O'Neill, de la Cruz) by their first word.
    """

    given: set = field(default_factory=set)
    family: set = field(default_factory=set)
    given_parts: tuple = (Counter(), Counter())
    family_parts: tuple = (Counter(), Counter())
    joined: dict = field(default_factory=dict)

    @staticmethod
    def fit(pairs: list[tuple[str | None, str | None]]) -> NameModel:
        """Learn from (given name, family name) pairs; null and blank names are skipped."""
        given = {_plain(g) for g, _ in pairs if g and g.strip()}
        family = {_plain(f) for _, f in pairs if f and f.strip()}
        joined: dict = {}
        for name in given | family:
            words = _TOKEN.findall(name)
            if words and words[0] != name:
                joined.setdefault(words[0], []).append(name)
        for names in joined.values():
            names.sort(key=len, reverse=True)
        return NameModel(given, family, _parts(given), _parts(family), joined)

    def is_given(self, word: str) -> bool:
        w = word.lower()
        return w in self.given or _made_of(w, self.given_parts)

    def is_family(self, word: str) -> bool:
        w = word.lower()
        return w in self.family or _made_of(w, self.family_parts)

    def ends_like_family(self, word: str) -> bool:
        w, tails = word.lower(), self.family_parts[1]
        return any(tails[w[i:]] >= 3 for i in range(3, len(w) - 3))


def _plain(name: str) -> str:
    return " ".join(name.lower().replace("’", "'").split())


def _parts(names: set) -> tuple[Counter, Counter]:
    heads, tails = Counter(), Counter()
    for n in names:
        for i in range(3, len(n) - 2):
            heads[n[:i]] += 1
            tails[n[i:]] += 1
    return heads, tails


def _made_of(word: str, parts: tuple[Counter, Counter], least: int = 2, joint: int = 2) -> bool:
    """Whether ``word`` is a known beginning and a known end with at most ``joint`` letters between."""
    heads, tails = parts
    n = len(word)
    if heads.get(word[:3], 0) < least:  # longer beginnings are no more frequent
        return False
    return any(
        heads.get(word[:i], 0) >= least and any(tails.get(word[j:], 0) >= least for j in range(i, min(i + joint, n - 3) + 1))
        for i in range(3, n - 2)
    )


def _shape(w: str) -> str:
    last = w if w.isalpha() else _TOKEN.findall(w)[-1]
    return "l" if w.islower() else "U" if len(w) > 1 and w.isupper() else "C" if last[0].isupper() and not last.isupper() else "x"


class Spans:
    """Disjoint stretches of a text, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, a: int, b: int) -> bool:
        """Adds [a, b) if it is free and not empty."""
        i = bisect_right(self.ends, a)
        if b <= a or (i < len(self.starts) and self.starts[i] < b):
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True

    def holds(self, at: int) -> bool:
        i = bisect_right(self.ends, at)
        return i < len(self.starts) and self.starts[i] <= at


def _with_joined(text: str, toks: list, joined: dict) -> list:
    """``toks`` with the words of a name of several words as one token."""
    out, i = [], 0
    ends = {b: j for j, (_, _, b) in enumerate(toks)}
    while i < len(toks):
        w, a, b = toks[i]
        for name in joined.get(w.lower(), ()):
            end = a + len(name)
            if end in ends and _plain(text[a:end]) == name:
                w, b, i = text[a:end].replace("’", "'"), end, ends[end]
                break
        out.append((w, a, b))
        i += 1
    return out


def _names(text: str, model: NameModel, known: dict, taken: Spans):
    """(start, end) of names, in no order; may overlap."""
    out = [m.span(1) for p in (_GREETED, _CLOSED, _GUEST) for m in p.finditer(text)] if any(map(text.__contains__, _SPOKEN)) else []
    words = set(_TOKEN.findall(text))
    alike = known.setdefault("", set())  # the words seen that are made like names or begin one
    for w in words:
        if w not in known:
            known[w] = (model.is_given(w), model.is_family(w))
            if any(known[w]) or w.lower() in model.joined:
                alike.add(w)
    if words.isdisjoint(alike) and words.isdisjoint(_TITLE_WORDS):
        return out  # no word is made like a name, and no title
    toks = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if model.joined:
        toks = _with_joined(text, toks, model.joined)

    def kind(w: str) -> tuple[bool, bool]:
        if w not in known:
            known[w] = (model.is_given(w), model.is_family(w))
        return known[w]

    n, i = len(toks), 0
    while i < n:
        w, a, b = toks[i]
        if len(w) == 1 and w.isupper() and text[b : b + 2] == ". " and i + 1 < n and toks[i + 1][1] == b + 2:
            nxt = toks[i + 1]
            if kind(nxt[0])[1] and _shape(nxt[0]) == "C":
                out.append((a, nxt[2]))
                i += 2
                continue
        title = i and toks[i - 1][0] in TITLES and text[toks[i - 1][2] : a] in (" ", ". ")
        title = title and not taken.holds(toks[i - 1][1])
        given, family = kind(w)
        if not (given or family or (title and _shape(w) == "C")):
            i += 1
            continue
        shape, last = _shape(w), i
        if family and not given and shape == "C" and not title and i and text[toks[i - 1][2] : a] == " ":
            first, after = toks[i - 1], toks[i + 1][0] if i + 1 < n else ""
            if _shape(first[0]) == "C" and first[0].lower() not in SHORT_WORDS and after not in PLACES:
                out.append((first[1], b))  # a given name the address book tells nothing of
                i += 1
                continue
        if given or title:
            j, gap = i + 1, " "
            if j < n and len(toks[j][0]) == 1 and toks[j][0].isupper() and text[b : toks[j][1]] == " " and text[toks[j][2] : toks[j][2] + 2] == ". ":
                j, gap = j + 1, ". "
            if j < n and text[toks[j - 1][2] : toks[j][1]] == gap and _shape(toks[j][0]) == shape:
                f = toks[j][0]
                if kind(f)[1] or (given and shape == "C" and len(f) > 5 and model.ends_like_family(f)):
                    last = j
        if last > i:
            out.append((a, toks[last][2]))
        elif family and shape == "U" and text[b : b + 2] == ", " and i + 1 < n and kind(toks[i + 1][0])[0] and toks[i + 1][1] == b + 2:
            last = i + 1
            out.append((a, toks[last][2]))
        elif shape == "C" and (title or (given and not family)):
            out.append((a, b))
        i = last + 1
    return out


def find(text: str | None, model: NameModel, known: dict | None = None, births: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every piece of personal information, in text order, without overlaps.

    Where pieces overlap, the earlier kind of email, id_number, address, phone,
    birth_date (only with ``births``) and name wins. Null and empty texts hold none.
    """
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    taken = Spans()

    def add(a: int, b: int, kind: str) -> None:
        if taken.take(a, b):
            found.append((a, b, kind))

    # Cheap tests first: most texts hold few kinds.
    low = text.lower()
    if "@" in text or "[at" in low or "(at" in low or (" at " in low and " dot " in low):
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    for m in ID_NUMBER.finditer(text):
        add(*m.span(), "id_number")
    places = [m.span() for hint, p in ADDRESSES if hint(text, low) for m in p.finditer(text)]
    for a, b in sorted(places):
        add(a, b, "address")
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            add(*m.span(), "phone")
    if births:
        for m in BIRTH.finditer(text):
            if _day(m[1]):
                add(*m.span(1), "birth_date")
    for a, b in sorted(_names(text, model, {} if known is None else known, taken), key=lambda s: (s[0], -s[1])):
        add(a, b, "name")
    return sorted(found)


def _digest(key: bytes, *parts: object) -> int:
    h = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key[:64], digest_size=8)
    return int.from_bytes(h.digest(), "big")


# Letters of the Spanish check, by remainder.
_NIF = "TRWAGMYFPDXBNJZSQVHLCKE"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BIRTH = re.compile(
    r"(?i:\b(?:born(?: on)?|date of birth|birthday|dob|geboren am|geb\.|né le|née le|date de naissance|nacid[oa] el|fecha de nacimiento):?\s+)"
    r"(\d{4}-\d{2}-\d{2}|\d{2}[./-]\d{2}[./-]\d{4})(?![\d-])"
)
#: Birth dates are permuted among the days from the first of these, so many of them.
FIRST_DAY, DAYS = date(1880, 1, 1), 80_000


def _day(value: str) -> int | None:
    """The number of the day that a date as 2001-02-03 or 03.02.2001 names; null if it is none or out of range."""
    n = [int(x) for x in re.split(r"[./-]", value)]
    try:
        at = (date(*n) if n[0] > 31 else date(n[2], n[1], n[0])) - FIRST_DAY
    except ValueError:
        return None
    return at.days if 0 <= at.days < DAYS else None


def _as_date(day: int, like: str) -> str:
    d = FIRST_DAY + timedelta(days=day)
    sep = next(c for c in like if not c.isdigit())
    return d.isoformat() if like[4] == "-" else f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year:04d}"


def feistel(a: int, b: int, size_a: int, size_b: int, key: bytes, form: str, rounds: int, back: bool = False) -> tuple[int, int]:
    """A keyed permutation of the pairs below (size_a, size_b) by modular additions, or its inverse."""
    for r in reversed(range(rounds)) if back else range(rounds):
        if r % 2 == 0:
            d = _digest(key, form, r, b)
            a = (a - d if back else a + d) % size_a
        else:
            d = _digest(key, form, r, a)
            b = (b - d if back else b + d) % size_b
    return a, b


def _moved(value: str, key: bytes, rounds: int, back: bool, fixed: frozenset = frozenset()) -> str:
    """``value`` with its letters and digits permuted, each within its class and place; those at ``fixed`` stay."""
    slots = [(i, x) for i, c in enumerate(value) if i not in fixed for x in (_DIGITS, _UPPER, _LOWER) if c in x]
    if not slots:
        return value
    form = "".join(x[0] if i not in fixed else c for i, c in enumerate(value) for x in [next((x for x in (_DIGITS, _UPPER, _LOWER) if c in x), c)])
    half = len(slots) // 2
    nums = []
    for part in (slots[:half], slots[half:]):
        n = 0
        for i, x in part:
            n = n * len(x) + x.index(value[i])
        nums.append(n)
    sizes = [prod(len(x) for _, x in part) for part in (slots[:half], slots[half:])]
    a, b = feistel(*nums, *sizes, key, form, rounds, back)
    if not half:  # one place alone: the other half says nothing
        d = _digest(key, form, "one")
        b = (nums[1] - d if back else nums[1] + d) % sizes[1]
    out = list(value)
    for n, part in ((a, slots[:half]), (b, slots[half:])):
        for i, x in reversed(part):
            n, at = divmod(n, len(x))
            out[i] = x[at]
    return "".join(out)


def valid_number(value: str) -> bool:
    """Whether an official number meets the rule of its format: check letter or digit, or values never issued."""
    plain = re.sub(r"[ .-]", "", value)
    if re.fullmatch(r"\d{8}[A-Z]", plain):
        return _NIF[int(plain[:8]) % 23] == plain[8]
    if re.fullmatch(r"[XYZ]\d{7}[A-Z]", plain):
        return _NIF[int("XYZ".index(plain[0])) * 10**7 % 23 - 23 + int(plain[1:8]) % 23] == plain[8]
    if re.fullmatch(r"\d{11}", plain):  # ISO 7064, mod 11,10
        p = 10
        for c in plain[:-1]:
            p = ((p + int(c)) % 10 or 10) * 2 % 11
        return plain[0] != "0" and (11 - p) % 10 == int(plain[-1])
    if re.fullmatch(r"\d{9}", plain) and value[3] == "-":
        return plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000"
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-Z]", plain):
        return not set(plain[:2]) & set("DFIQUV") and plain[1] != "O" and plain[8] in "ABCD"
    return True


def _fixed(kind: str, value: str) -> frozenset:
    """Places that stay: a phone's country code, the label that begins an official number, the leading letter of one for foreigners."""
    code = re.match(r"\+\d{1,2}(?=[ .-])|00\d{2}", value) if kind == "phone" else re.match(r"ID(?=\d{3}\.)|[XYZ](?=-?\d{7}-?[A-Z]$)", value)
    return frozenset(range(code.end())) if code else frozenset()


def permute(value: str, key: bytes, kind: str = "id_number", rounds: int = 10, back: bool = False) -> str:
    """The pseudonym of a phone number, official number or birth date, in its own format.

    A Feistel network permutes all letters and digits, each within its class.
    A number that is valid by ``valid_number`` is walked on along its cycle to
    the next valid one, and an invalid one to the next invalid one, so check
    letters and digits fit again and the whole is a permutation (``restore``).
    The same walk keeps a number without a country code from getting one.
    Dates are permuted among the days of the calendar in the same way.
    """
    if kind == "birth_date" and (day := _day(value)) is not None:
        low = 283  # 283 x 283 pairs hold all days
        while True:
            a, b = feistel(*divmod(day, low), low, low, key, "day", rounds, back)
            if (day := a * low + b) < DAYS:
                return _as_date(day, value)
    state = lambda v: (_fixed(kind, v), kind != "id_number" or (bool(ID_NUMBER.fullmatch(v)), valid_number(v)))
    begun = state(value)
    while True:
        value = _moved(value, key, rounds, back, begun[0])
        if state(value) == begun:
            return value


def restore(value: str, key: bytes, kind: str = "id_number", rounds: int = 10) -> str:
    """The inverse of ``permute``, for holders of the key."""
    return permute(value, key, kind, rounds, back=True)


def placeholder(kind: str, value: str, key: bytes) -> str:
    """[KIND pseudonym]: numbers and dates keep their format, phones their country code, other values get a keyed tag."""
    if kind in ("phone", "id_number", "birth_date"):
        return f"[{kind.upper()} {permute(value, key, kind)}]"
    return f"[{kind.upper()} {_digest(key, kind, value.casefold()) & 0xFFFFFFFF:08x}]"


def redact_text(text: str | None, model: NameModel, key: bytes, known: dict | None = None, births: bool = False):
    """(text with placeholders, kinds, values); all else of the text is unchanged."""
    spans = find(text, model, known, births)
    if not spans:
        return text, [], []
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], placeholder(kind, text[a:b], key)]
        at = b
    return "".join(out) + text[at:], [k for _, _, k in spans], [text[a:b] for a, b, _ in spans]


def fit_names(contacts: DataFrame, given: str = "given_name", family: str = "family_name") -> NameModel:
    """The name model of an address book of any length with at most ``MOST_NAMES`` distinct names."""
    kinds = contacts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(F.trim(c)).alias("name")) for k, c in (("given", given), ("family", family))])).alias("x"))
    rows = kinds.select("x.*").where("name <> ''").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return NameModel.fit([(r.name if r.kind == "given" else None, r.name if r.kind == "family" else None) for r in rows])


def redacted(text: Column, model: NameModel, key: bytes, births: bool = False) -> Column:
    """struct(text, found array<struct(kind, val)>) of a text column.

    Equal values get equal placeholders under one key, in every document. Null
    texts stay null with nothing found. With ``births``, dates of birth are
    found and permuted too. The key must have 1 to 64 bytes.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")

    @pandas_udf("text string, kinds array<string>, vals array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for t in texts:
            rows.append(redact_text(t, model, key, known, births))
            if len(known) > 500_000:  # only a memo
                known.clear()
        return pd.DataFrame(rows, columns=["text", "kinds", "vals"])

    # Not to be run again for a filter that the optimiser derives from its result.
    return run.asNondeterministic()(text)
