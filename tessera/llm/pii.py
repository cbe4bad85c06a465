"""Personal information in free text: where it stands, typed placeholders, and surrogates.

`Detector` finds e-mail addresses, phone numbers, identity numbers, street addresses and names of private persons
in one text. Patterns are anchored on signs that are rare in prose (digits, @, capitals), so most of a text is passed over
once. Names are runs of capitalised words read by a small grammar; whether a word can be a given name or a surname is told by
the name list and by an affix model trained on it, whether a person is private by the list of members.

Surrogates are keyed replacements of the same type, script and format: digits by a keyed permutation of numbers of their length, letters by letters
of their script and kind, with capitals and the ending that tells a given name's gender kept. The permutations have no fixed point, so no
part is ever its own surrogate. Parts of an entity are replaced each by itself, so one person stays one person however the name is
written. `checked_attempts` compares all surrogates with all real values and with one another and re-keys what meets.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.leakage import pieces
from tessera.util import cut, is_small, join_small

KINDS = ("email", "phone", "id_number", "address", "name")

# --- fixed values: words of the grammar -----------------------------------------------------------
TITLES = "Mr Mrs Ms Miss Mx Dr Doctor Prof Professor Captain Nurse Sir Lady Lord Dame Madam Sergeant Inspector Constable Colonel Major Judge Rev Reverend Father Sister Brother Hon Mme Mlle Madame Mademoiselle Monsieur Docteur Maître MM Mmes Messrs".split()
PARTICLES = "de du des de la van von van der van den della di da dos al el ben bin ibn ter ten le".split()
OFFICES = "Speaker Chair Chairman Chairwoman President Minister Deputy Secretary Clerk Member Members Commissioner Governor Mayor".split()
STREET_TYPES = "Street St Road Rd Lane Ln Avenue Ave Terrace Court Ct Close Row Drive Dr Place Pl Square Sq Crescent Way Gardens Grove Hill Park Walk Mews Boulevard Blvd Quay Green Parade".split()
FRENCH_TYPES = "rue avenue av. quai place boulevard bd chemin allée impasse cours square passage route".split()
FRENCH_WORDS = frozenset("le la les de du des et en un une a est été sur pour dans avec que qui ne au aux par ce cette il elle nous vous carte lettre plainte".split())
ENGLISH_WORDS = frozenset("the of and to in is was for that with on at by from this had has have they when it be as are not who".split())
# --------------------------------------------------------------------------------------------------



def _ranges(test) -> str:
    """Code points that pass a test, as the inside of a character class."""
    out, last = [], -2
    for i in range(sys.maxunicode + 1):
        if test(chr(i)):
            if i == last + 1:
                out[-1][1] = i
            else:
                out.append([i, i])
            last = i
    return "".join(chr(a) + (f"-{chr(b)}" if b > a else "") for a, b in out)


_UP = _ranges(lambda c: c.isupper() or c.istitle())
_CAP = rf"[{_UP}][^\W\d_]*(?:[’'\-](?![sS]\b)[^\W\d_]+)*"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_PARTICLE = r"(?:[dD][eE] [lL][aA] |[dD][eE][sS]? |[dD][uU] |[vV][aA][nN] (?:[dD][eE][rRnN] )?|[vV][oO][nN] |[dD][eE][lL][lL][aA] |[dD][iIaA] |[bB][eEiI][nN] |[iI][bB][nN] |[aAeE][lL][ \-]|[tT][eE][rRnN] |[dD][’'])"
#: A run of at least two capitalised words with what may stand between them in a name.
_RUN = re.compile(rf"(?:(?<![\w@.+\-’'])|(?<=\b[aAeE][lL]-)){_CAP}\.?(?:,? {_PARTICLE}?{_CAP}\.?|(?<=\.)-?{_CAP}\.)+")
_BEFORE = re.compile(rf"(?<![\w’'\-])({_PARTICLE})$")
_TOKEN = re.compile(rf"({_PARTICLE})?({_CAP})(\.?)")

_WORD_LIKE = r"[^\W\d_]+(?:[-’'](?![sS]\b)[^\W\d_]+)*"
_SURNAME_AFTER = re.compile(rf"(?: [^\W\d_]\.)* {_PARTICLE}?({_WORD_LIKE})(?![\w@])")
_LAST_WORD = re.compile(rf"(?<![\w@.+\-’'])({_PARTICLE}?)({_WORD_LIKE})$")
_NEXT_WORD = re.compile(rf" ({_CAP})")
_AT = r"(?:@| ?[(\[{] ?(?:at|AT|arobase) ?[)\]}] ?| (?:at|AT|arobase) )"
_DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT|point) ?[)\]}] ?| (?:dot|DOT|point) )"
_LOCAL = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9_%+\-]*(?:\.[A-Za-zÀ-ÿ0-9_%+\-]+)*"
_EMAIL = re.compile(rf"(?<![\w@.+\-])(?:mailto:)?({_LOCAL}{_AT}[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9\-]*)+)(?![@])")
_EMAIL_HINT = re.compile(r"@|(?:at|AT|arobase) ?[)\]}]| dot | DOT ")

_ID = re.compile(r"(?<![\w+])(?<!\d[ ./\-])\d(?:[ ./\-]?\d){8}(?:[./\-]?[A-Za-z]|[ ][A-Z])(?!\w)")
_PHONE = re.compile(
    r"(?<![\w+/.\-])(?<!\d )(?:(?:\+|00)\d{1,3}[ .\-/]?(?:\(0\)[ .\-/]?)?\(?\d{1,4}\)?|\(0\d{1,4}\)|0\d{1,4})(?:[ .\-/]?\d){5,9}(?!\d)(?:,? ?(?:ext|EXT|Ext|x|extension|poste|p)\.? ?\d{1,6}(?!\d))?"
)
_NUMBERS = re.compile(r"\d[ ./()\-]?\d[ ./()\-]?\d[ ./()\-]{0,2}\d[ ./()\-]{0,2}\d[ ./()\-]{0,2}\d[ ./()\-]?\d")

_TYPES = "|".join(t + "|" + t.upper() for t in sorted(STREET_TYPES, key=len, reverse=True))
_UNIT = r"(?:(?:Flat|FLAT|Apt|APT|Apartment|APARTMENT|Unit|UNIT|Suite|Room|App|Appt|Appartement|appartement|appt)\.? ?\d+[A-Za-z]?,? )?(?:(?:No|NO|no|N°|n°|Nr)\.? ?)?"
_HOUSE = r"\d+(?: ?(?:bis|ter))?[A-Za-z]?(?:[/\-]\d+[A-Za-z]?)?"
_POST = r"[A-Z]{1,2}\d{0,2}[A-Z]? ?\d{3,5}[A-Z]{0,2}"
_TOWN = rf"{_CAP}(?: {_CAP}){{0,2}}"
_ADDRESS = re.compile(rf"(?<![\w/\-])({_UNIT}{_HOUSE} {_CAP}(?: {_CAP})?? (?:{_TYPES})(?![\w])(?:\.(?=,? ?(?:,|[a-z])))?(?:,? {_TOWN}? ?{_POST}\b)?)")
_FRENCH = re.compile(rf"(?<![\w/\-])({_UNIT}{_HOUSE},? (?:{'|'.join(FRENCH_TYPES)}|{'|'.join(FRENCH_TYPES).upper()}) (?:de la |du |des |de |d’|d'|DE LA |DU |DES |DE |D’)?{_CAP}(?:,? {_POST} {_TOWN}|,? \d{{5}} {_TOWN})?)")
_ADDRESS_HINT = re.compile(rf"\d[A-Za-z]? (?:[^\W\d_]+ ){{1,2}}(?:{_TYPES})(?!\w)")
_FRENCH_HINT = re.compile(r"\d\w?(?: (?:bis|ter))?,? (?:" + "|".join(FRENCH_TYPES) + "|" + "|".join(FRENCH_TYPES).upper() + r") ")


class AffixModel:
    """Whether a word is built like those it was trained on: its start and its end both occur, its end repeatedly."""

    def __init__(self, words: list[str]):
        words = [w for w in words if len(w) > 2]
        self.words = frozenset(words)
        self.starts = Counter(w[:2] for w in words)
        self.starts3 = Counter(w[:3] for w in words)
        self.ends = Counter(w[-2:] for w in words)
        self.ends3 = Counter(w[-3:] for w in words)
        self.last = frozenset(w[-1] for w in words)

    def like(self, word: str, strict: bool = False) -> bool:
        if word in self.words:
            return True
        if len(word) < 4:
            return False
        if strict:
            return self.starts3[word[:3]] >= 2 and self.ends3[word[-3:]] >= 2
        return self.starts[word[:2]] >= 1 and self.ends[word[-2:]] >= 2


class Detector:
    """Finds personal information. names: (name, kind) rows; members: full names of persons who are not private."""

    def __init__(self, names: list[tuple[str, str]], members: list[str]):
        low = lambda w: unicodedata.normalize("NFC", w).lower()
        full = [low(m).split() for m in members if m and m.split()]
        self.members: dict[str, set[str]] = {}
        for m in full:
            self.members.setdefault(m[-1], set()).update(m[:-1])
        given = [low(n) for n, k in names if n and k == "given"] + [g for m in full for g in m[:-1] if m[0] != "the"]
        surnames = [low(n) for n, k in names if n and k == "surname" and low(n) not in self.members]
        self.given, self.surname = AffixModel(given), AffixModel(surnames)
        self.titles = {t.lower() for t in TITLES} | {"m"}
        self.offices = {t.lower() for t in OFFICES}
        self.types = {t.lower() for t in STREET_TYPES}
        self.finder = None  # made by the worker that needs it

    # --- names
    def _surname_like(self, word: str, strict: bool) -> bool:
        return any(self.surname.like(p, strict) or p in self.members for p in re.split("[-’']", word.lower()))

    def _given_possible(self, word: str) -> bool:
        """A weaker test, for words beside a strong surname: the start occurs, and it is no word of the language."""
        w = word.lower()
        return len(w) > 3 and self.given.starts[w[:2]] >= 1 and w[-1] in self.given.last and not self._common(word) and w not in self.members

    def _given_like(self, word: str, strict: bool = False) -> bool:
        return all(self.given.like(p, strict) for p in word.lower().split("-")) and not word.lower() in self.members

    def _member(self, surname: str, given: str | None) -> bool:
        """Whether a member may be meant: the surname, with a given name or initial that doesn't speak against it."""
        theirs = self.members.get(surname.lower())
        return theirs is not None and (not given or any(g.startswith(given.lower()) for g in theirs))

    def names(self, text: str) -> Iterator[tuple[int, int, str]]:
        for run in _RUN.finditer(text):
            base, end = run.span()
            tokens = [(m.start(1) if m.group(1) else m.start(2), m.start(2), m.end(2), m.group(2), bool(m.group(3)), bool(m.group(1))) for m in _TOKEN.finditer(text, base, end)]
            if m := _BEFORE.search(text, max(0, base - 9), base):  # a particle before a surname that comes first
                t = tokens[0]
                if m.group(1)[0] not in "dD" or not self._french(text, base):
                    tokens[0] = (m.start(1), *t[1:])
            yield from self._read(text, tokens)

    def small_names(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Names not written with capitals: only those whose given name and surname the list both has, as such words may mean anything."""
        if self.finder is None:
            self.finder = Automaton()
            for w in self.given.words:
                self.finder.add_word(w, len(w))
            if len(self.finder):
                self.finder.make_automaton()
        low = text.lower()
        if len(low) != len(text):  # signs whose small form is longer stay, so that positions hold
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not len(self.finder):
            return
        for end, n in self.finder.iter(low):
            a, b = end - n + 1, end + 1
            if a and text[a - 1].isalnum() or text[b : b + 1].isalnum():
                continue
            # given name, initials, surname; or surname, comma, given name
            if (m := _SURNAME_AFTER.match(text, b)) and not (text[a].isupper() and m.group(1)[0].isupper()):
                yield from self._listed(a, m.end(), m.group(1), text[a:b])
            elif text[max(0, a - 2) : a] == ", " and (m := _LAST_WORD.search(text, max(0, a - 40), a - 2)) and not (text[a].isupper() and m.group(2)[0].isupper()):
                yield from self._listed(m.start(), b, m.group(2), text[a:b])

    def _listed(self, a: int, b: int, surname: str, given: str) -> Iterator[tuple[int, int, str]]:
        if all(p in self.surname.words or p in self.members for p in re.split("[-’']", surname.lower())) and not self._member(surname, given):
            yield a, b, surname

    def _read(self, text: str, tokens: list[tuple]) -> Iterator[tuple[int, int, str]]:
        i, n = 0, len(tokens)
        while i < n:
            titled = False
            start = i
            while i < n and (t := tokens[i])[3].lower() in self.titles and not t[5] and (t[3].lower() != "m" or t[4] and self._french(text, t[0])):
                titled, i = True, i + 1
            if i >= n:
                return
            found = self._name(text, tokens, i, titled)
            if found is None:
                i = max(i, start) + 1
                continue
            first, last, surname, given = found
            surname_first = first < last and tokens[first][3] == surname
            a, b = tokens[first][0 if surname_first or tokens[first][5] else 1], tokens[last][2]
            i = last + 1
            if self._member(surname, given):
                continue
            if not titled and (m := _NEXT_WORD.match(text, b)) and not self._given_like(m.group(1)):
                continue  # a road, reservoir or commission named like a person: a further capitalised word follows at once
            yield a, b, surname

    @staticmethod
    def _french(text: str, at: int) -> bool:
        near = re.findall(r"[^\W\d_]+", text[max(0, at - 80) : at + 80].lower())
        return sum(w in FRENCH_WORDS for w in near) > sum(w in ENGLISH_WORDS for w in near)

    def _name(self, text: str, tokens: list[tuple], i: int, titled: bool):
        """(first token, last token, surname, given name or initial or None) of the name that starts at token i."""
        n = len(tokens)

        def gap(j: int) -> str:
            """What stands between tokens j and j + 1, their dots left out."""
            return text[tokens[j][2] : tokens[j + 1][0]].lstrip(".") if j + 1 < n else ""

        def initial(j: int) -> bool:
            return j < n and len(tokens[j][3]) == 1 and tokens[j][4] and not tokens[j][5]

        def word(j: int) -> bool:
            return j < n and len(tokens[j][3]) > 2 and tokens[j][3].lower() not in self.offices and tokens[j][3].lower() not in self.titles

        # given name, initials, surname
        w = tokens[i]
        j = i + 1
        while initial(j) and gap(j - 1) in (" ", "-", ""):
            j += 1
        if word(i) and not w[5] and not w[4] and word(j) and gap(j - 1) == " ":
            s = tokens[j][3]
            known = w[3].lower() in self.given.words
            middle = j > i + 1
            if s.lower() not in self.types:
                if self._given_like(w[3]) and self._surname_like(s, strict=not (known or titled or middle or tokens[j][5])):
                    return i, j, s, w[3]
                if known and not self._common(s) and (tokens[j][5] or middle or titled):
                    return i, j, s, w[3]
                if self._given_possible(w[3]) and self._surname_like(s, strict=True):
                    return i, j, s, w[3]
                if titled and self._surname_like(s, False) and not self._surname_like(w[3], True):
                    return i, j, s, w[3]
        # initials, surname
        if initial(i):
            j = i + 1
            while initial(j) and gap(j - 1) in (" ", "-", ""):
                j += 1
            if word(j) and gap(j - 1) == " " and self._surname_like(tokens[j][3], strict=not (titled or tokens[j][5])):
                return i, j, tokens[j][3], w[3]
        # surname, given name or initials
        if word(i) and i + 1 < n and gap(i) == ", " and not tokens[i + 1][5] and self._surname_like(w[3], strict=False):
            j = i + 1
            if word(j) and (self._given_like(tokens[j][3]) or self._given_possible(tokens[j][3]) and self._surname_like(w[3], strict=True)) and not (w[3].lower() in self.given.words and not self._surname_like(w[3], True)):
                while initial(j + 1) and gap(j) == " " and not (j + 2 < n and word(j + 2) and gap(j + 1) == " "):
                    j += 1
                return i, j, w[3], tokens[i + 1][3]
            if initial(j):
                while initial(j + 1) and gap(j) in (" ", "-", ""):
                    j += 1
                if not (word(j + 1) and gap(j) == " "):
                    return i, j, w[3], tokens[i + 1][3]
        # surname alone, after a title
        if titled and word(i) and (self._surname_like(w[3], False) or not self._common(w[3])):
            j = i
            if not self._surname_like(w[3], False):  # of names built in another way the whole run belongs to the person
                while word(j + 1) and gap(j) == " " and not self._common(tokens[j + 1][3]) and not self._surname_like(tokens[j + 1][3], True) and j < i + 2:
                    j += 1
            return i, j, tokens[j][3], w[3] if j > i else None
        return None

    def _common(self, word: str) -> bool:
        return word.lower() in self.offices or word.lower() in self.types or word.lower() in ENGLISH_WORDS or word.lower() in FRENCH_WORDS

    # --- the rest
    @staticmethod
    def emails(text: str) -> Iterator[tuple[int, int]]:
        if _EMAIL_HINT.search(text):
            for m in _EMAIL.finditer(text):
                if " at " not in m.group(1).lower() and " arobase " not in m.group(1) or re.search(r" (?:dot|DOT|point) |\.", m.group(1)):
                    yield m.span(1)

    @staticmethod
    def id_numbers(text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in _ID.finditer(text))

    @staticmethod
    def phones(text: str) -> Iterator[tuple[int, int]]:
        for m in _PHONE.finditer(text):
            number = re.split(r"[A-Za-z]", m.group())[0]
            digits = re.sub(r"\D", "", number.replace("(0)", ""))
            if number.lstrip("(").startswith(("+", "00")):
                if 10 <= len(digits.removeprefix("00")) <= 15:
                    yield m.span()
            elif 9 <= len(digits) <= 12 and not re.match(r"[ ./\-]?[A-Za-z]\b", text[m.end() : m.end() + 2] if len(digits) == 9 else ""):
                yield m.span()

    @staticmethod
    def addresses(text: str) -> Iterator[tuple[int, int]]:
        if _ADDRESS_HINT.search(text):
            yield from (m.span(1) for m in _ADDRESS.finditer(text))
        if _FRENCH_HINT.search(text):
            yield from (m.span(1) for m in _FRENCH.finditer(text))

    def find(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, end, unit) in order, without overlaps; where two kinds claim a place, the first of KINDS with id_number before phone holds it.

        The unit is what all spellings of an entity share: a person's surname, a subscriber's digits, else the value in small letters.
        """
        out: list[tuple[str, int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(kind: str, spans: Iterator[tuple]) -> None:
            for a, b, *unit in spans:
                at = bisect(taken, (a, a))
                if not (at and taken[at - 1][1] > a or at < len(taken) and taken[at][0] < b):
                    out.append((kind, a, b, unit[0].lower() if unit else unit_of(kind, text[a:b])))
                    taken.insert(at, (a, b))

        add("email", self.emails(text))
        if _NUMBERS.search(text):
            add("id_number", self.id_numbers(text))
            add("phone", self.phones(text))
        add("address", self.addresses(text))
        add("name", self.names(text))
        add("name", self.small_names(text))
        return sorted(out, key=lambda x: x[1:3])


def unit_of(kind: str, value: str) -> str:
    if kind == "phone":
        return re.sub(r"\D", "", re.split(r"[A-Za-z,]", value)[0])[-7:]
    if kind == "id_number":
        return re.sub(r"\W", "", value).lower()
    return value.lower()


# --- surrogates -----------------------------------------------------------------------------------

_VOWELS = frozenset("aeiou")
_ALPHABETS: dict[tuple, str] = {}


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


def _kind(c: str) -> tuple:
    """What a small letter's surrogate shares with it: script, page of the script, vowel or not in Latin, marked or not."""
    base = unicodedata.normalize("NFD", c)
    return _script(c), ord(c) >> 7, base[0] in _VOWELS, len(base) > 1


def alphabet(c: str) -> str:
    """Letters that may stand for a small letter: those of its kind, or, if it is the only one, those of its page in its script; empty for other signs."""
    if not c.isalpha():
        return ""
    kind = _kind(c)
    if kind not in _ALPHABETS:
        page = [x for i in range(kind[1] << 7, (kind[1] + 1) << 7) if (x := chr(i)).isalpha() and _script(x) == kind[0] and x.lower() == x and not x.isupper() and not x.istitle() and len(x.upper()) == 1 and x.upper().lower() == x]
        same = [x for x in page if _kind(x) == kind]
        _ALPHABETS[kind] = "".join(same if len(same) > 1 else page)
    own = _ALPHABETS[kind]
    return own if len(own) > 1 and c in own else ""


def _digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n): a Feistel network, walked until it ends inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(4):
            a, b = b, a ^ (_digest(key, tweak, n, r, b) & mask)
        x = a << half | b
        if x < n:
            return x


def unpermuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """The inverse of permuted()."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in (3, 2, 1, 0):
            a, b = b ^ (_digest(key, tweak, n, r, a) & mask), a
        x = a << half | b
        if x < n:
            return x


def moved(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n) that is one cycle: it leaves nothing in its place if n > 1."""
    return unpermuted((permuted(x, n, key, tweak) + 1) % n, n, key, tweak)


class Surrogates:
    """Keyed replacements. Each is a permutation of the values of one format, so different values never meet under one attempt, and no value is its own.

    Attempts above 0 re-key all but first letters and what a format keeps.
    """

    def __init__(self, key: str, attempt: int = 0):
        self.key = hashlib.blake2b(f"{attempt}|{key}".encode(), digest_size=32).digest()
        self.first = hashlib.blake2b(f"0|{key}".encode(), digest_size=32).digest()
        self.kept: dict[str, str] = {}

    def word(self, word: str) -> str:
        """Letters by letters of their kind, capitals kept. The first letter depends on the first alone, so that initials stay true; the last, which tells gender, is kept in longer words."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
        if low not in self.kept:
            if len(self.kept) > 100_000:
                self.kept.clear()
            self.kept[low] = self._small(low)
        return "".join(c.upper() if w.isupper() or w.istitle() else c for c, w in zip(self.kept[low], word, strict=True))

    def _small(self, low: str) -> str:
        out, own = list(low), [alphabet(c) for c in low]
        head = next((i for i, a in enumerate(own) if a), None)
        if head is None:  # none of these letters has another of its kind
            return "".join("bcdfg"[_digest(self.key, low, i) % 5] for i in range(len(low)))
        out[head] = own[head][moved(own[head].index(low[head]), len(own[head]), self.first, "first" + own[head])]
        free = [i for i in range(head + 1, len(out) - (len(out) > 2)) if own[i]]
        x, n = 0, 1
        for i in free:
            x, n = x * len(own[i]) + own[i].index(low[i]), n * len(own[i])
        if free:
            x = moved(x, n, self.key, "|".join([str(len(out)), out[-1], *(own[i] for i in free)]))
            for i in reversed(free):
                x, r = divmod(x, len(own[i]))
                out[i] = own[i][r]
        return "".join(out)

    def number(self, digits: str, tweak: str) -> str:
        """A number of as many digits, without a leading zero unless it has one."""
        n = len(digits)
        if n > 1 and digits[0] == "0":
            return "0" + self.number(digits[1:], tweak)
        low = 10 ** (n - 1) if n > 1 else 0
        return str(low + moved(int(digits) - low, 10**n - low, self.key, tweak))

    def digits(self, text: str, last: int, tweak: str) -> str:
        """The last so many digits of text replaced as one number, whatever stands between them."""
        at = [i for i, c in enumerate(text) if c.isdigit()][-last:]
        new = moved(int("".join(text[i] for i in at) or 0), 10 ** len(at), self.key, tweak)
        out = list(text)
        for i, c in zip(at, str(new).zfill(len(at))):
            out[i] = c
        return "".join(out)

    def of(self, kind: str, value: str) -> str:
        out = self._of(kind, value)
        # made of words only that a format keeps: then they are replaced too
        return out if out != value else re.sub(r"[^\W\d_]+", lambda m: self.word(m.group()), value)

    def _of(self, kind: str, value: str) -> str:
        if kind == "phone":
            number, rest = re.match(r"([^A-Za-z,]*)(.*)", value, re.S).groups()
            # country and area stay, the subscriber's seven digits are permuted
            return self.digits(number, 7, "phone") + re.sub(r"\d+", lambda m: self.number(m.group(), "extension"), rest)
        if kind == "id_number":
            letter = value[-1]
            return self.digits(value[:-1], 9, "id") + chr(moved(ord(letter.upper()) - 65, 26, self.key, "letter") + (65 if letter.isupper() else 97))
        if kind == "email":
            return re.sub(r"[^\W\d_]+|\d+", lambda m: m.group() if m.group().lower() in _KEEP_IN_EMAIL else self.number(m.group(), "email") if m.group().isdigit() else self.word(m.group()), value)
        if kind == "address":
            return re.sub(r"[^\W\d_]{3,}|\d+", lambda m: self.number(m.group(), "address") if m.group().isdigit() else m.group() if m.group().lower() in _KEEP_IN_ADDRESS else self.word(m.group()), value)
        return re.sub(r"[^\W\d_]+", lambda m: m.group() if m.group().lower() in _KEEP_IN_NAME and not m.group()[0].isupper() else self.word(m.group()), value)


_KEEP_IN_EMAIL = frozenset("at dot arobase point mailto post com org net edu gov example test invalid localhost".split())
_KEEP_IN_ADDRESS = frozenset([t.lower().strip(".") for t in (*STREET_TYPES, *FRENCH_TYPES, *PARTICLES)] + "flat apt apartment unit suite room app appt appartement bis ter".split())
_KEEP_IN_NAME = frozenset(PARTICLES)


def replaced(text: str, spans: list[tuple[str, int, int]], new: list[str]) -> str:
    """Text with new values in place of spans, which are sorted and don't overlap."""
    out, at = [], 0
    for (_, a, b, *_), v in zip(spans, new):
        out += [text[at:a], v]
        at = b
    return "".join([*out, text[at:]])


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


FOUND = "doc_id bigint, kind string, start_pos int, end_pos int, value string, unit string"


def _found(detector: Detector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            rows = [(d, k, a, b, t[a:b], u) for d, t in zip(ids.tolist(), texts) for k, a, b, u in detector.find(t)]
            if rows:
                d, k, a, b, v, u = zip(*rows)
                yield pa.record_batch({"doc_id": pa.array(d, pa.int64()), "kind": pa.array(k), "start_pos": pa.array(a, pa.int32()), "end_pos": pa.array(b, pa.int32()), "value": pa.array(v), "unit": pa.array(u)})

    return run


def _replaced(key: str, at: int):
    """Adds surrogate from kind, value and attempt, the columns from `at` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_attempt: dict[int, Surrogates] = {}
        for b in batches:
            new = []
            for k, v, t in zip(*(b.column(at + i).to_pylist() for i in range(3))):
                if t not in by_attempt:
                    by_attempt[t] = Surrogates(key, t)
                new.append(by_attempt[t].of(k, v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "surrogate"])

    return run


def _rewritten(detector: Detector, key: str, attempts: dict[tuple[str, str], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_attempt = {t: Surrogates(key, t) for t in {0, *attempts.values()}}
        for ids, texts in pieces(batches):
            spans = [detector.find(t) for t in texts]
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids), "n_found": pa.array([len(s) for s in spans], pa.int32()), "redacted": pa.array([replaced(t, s, [placeholder(x[0]) for x in s]) for t, s in zip(texts, spans)]),
                    "surrogated": pa.array([replaced(t, s, [by_attempt[attempts.get((k, u), 0)].of(k, t[a:b]) for k, a, b, u in s]) for t, s in zip(texts, spans)]),
                }
            )

    return run


def detector_of(names: DataFrame, members: DataFrame, most: int = 200_000) -> Detector:
    """Both tables are lists of bounded size; beyond `most` rows they are refused rather than cut."""
    n = [tuple(r) for r in names.select("name", "kind").limit(most + 1).collect()]
    m = [r[0] for r in members.select("full_name").limit(most + 1).collect()]
    if max(len(n), len(m)) > most:
        raise ValueError(f"name lists of more than {most} rows")
    return Detector(n, m)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")


def find_personal(documents: DataFrame, names: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, kind, start_pos, end_pos, value, unit of each occurrence; positions count code points from 0.

    Null and empty texts have none; repeated ids give the rows of each text; other columns aren't read.
    """
    return _texts(documents).mapInArrow(_found(detector_of(names, members)), FOUND)


def clashes(surrogated: DataFrame) -> DataFrame:
    """kind and value of entities whose surrogate is some text's real entity, or that share one surrogate with another spelling-blind value."""
    plain = surrogated.select("kind", F.lower("value").alias("value"), F.lower("surrogate").alias("surrogate")).distinct()
    real = plain.select("kind", F.col("value").alias("surrogate")).distinct()
    shared = plain.groupBy("kind", "surrogate").count().where("count > 1").select("kind", "surrogate")
    return plain.join(real.union(shared).distinct(), ["kind", "surrogate"], "left_semi").select("kind", "value")


def checked_attempts(found: DataFrame, key: str, tries: int = 50) -> DataFrame:
    """kind, unit, attempt of the units that must be re-keyed, so that no surrogate is anybody's real datum and no two values share one. found: cut.

    All surrogates are compared with all real values and with one another, by joins over distinct values. What meets is keyed again, the whole unit,
    so that every spelling of the entity follows; of values that share a surrogate the first unit stays. Rounds end when nothing meets.
    """
    values = cut(found.groupBy("kind", F.lower("value").alias("value")).agg(F.min("unit").alias("unit"), F.lit(0).alias("attempt")))
    for _ in range(tries):
        # kind, value and attempt come in the order in which _replaced() reads them
        d = values.select("unit", "kind", "value", "attempt")
        d = cut(d.mapInArrow(_replaced(key, 1), "unit string, kind string, value string, attempt int, surrogate string").withColumn("surrogate", F.lower("surrogate")))
        real = d.join(d.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "unit")
        first = d.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "unit")).alias("first"), F.count_distinct("value").alias("n")).where("n > 1")
        shared = d.join(first, ["kind", "surrogate"]).where(F.struct("attempt", "unit") != F.col("first")).select("kind", "unit")
        again = cut(real.union(shared).distinct())
        if again.isEmpty():
            return d.where("attempt > 0").select("kind", "unit", "attempt").distinct()
        values = cut(d.join(again.withColumn("again", F.lit(1)), ["kind", "unit"], "left").select("kind", "value", "unit", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))
    raise ValueError(f"values still meet after {tries} attempts")


def with_surrogates(found: DataFrame, key: str) -> DataFrame:
    """found (cut) with the surrogate of each occurrence, checked against all values."""
    attempts = checked_attempts(found, key)
    d = join_small(found, attempts, ["kind", "unit"], "left").select("doc_id", "start_pos", "end_pos", "kind", "value", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return d.mapInArrow(_replaced(key, 3), "doc_id bigint, start_pos int, end_pos int, kind string, value string, attempt int, surrogate string").select("doc_id", "kind", "start_pos", "end_pos", "value", "surrogate")


def rewrite(documents: DataFrame, names: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """doc_id, n_found, redacted (typed placeholders), surrogated (checked surrogates) of every text that isn't null.

    The re-keyed units go along to the texts; there are few, as surrogates seldom meet anything. Should they be too many for that, the key
    is refused, and one with a longer format or another key must be chosen.
    """
    detector = detector_of(names, members)
    texts = _texts(documents)
    attempts = cut(checked_attempts(cut(texts.mapInArrow(_found(detector), FOUND)), key))
    if not is_small(attempts):
        raise ValueError("too many surrogates meet real values under this key")
    known = {(r.kind, r.unit): r.attempt for r in attempts.collect()}
    return texts.mapInArrow(_rewritten(detector, key, known), "doc_id bigint, n_found int, redacted string, surrogated string")
