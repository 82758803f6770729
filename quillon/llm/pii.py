"""Replacement of personal data by keyed surrogates.

E-mail addresses, phone numbers, IP addresses, payment cards, US social security numbers, IBANs and
names are replaced. Names are found after a form of address or a phrase that introduces a name, and then
wherever the document has them again, bare or in capitals. A surrogate has the type, script, length
pattern and validity of what it replaces (check digits, address class, gender of a name). It depends on
the value in its canonical form and a secret key only, so all mentions of a value get one surrogate, in
every document, without a table: case doesn't matter for mails and names, nor grouping for numbers, nor
a country code or trunk zero for phones.

Values of a format are numbers of a mixed radix. They move one step along a keyed cycle through all of
them (a Feistel permutation around an increment), so two values never meet and none stays as it is.
Names are drawn from a larger space by a keyed hash. Over the values of the whole corpus it is checked
that no two names meet and that no surrogate is a value of its own. Else all names are drawn from a larger
space, but of other values only those that meet one: each goes on over further cycles to the first surrogate
that is neither a value of the corpus nor another's. Of a format that the corpus fills by a part that counts (as of
192.168.0.0/16), all free places are listed and dealt out instead, in an order that the key gives, so no place stays
free while a value wants one. Only where the corpus holds more than half of all values of a format are there fewer
places than values, whatever is drawn: those left over keep their first surrogate, still apart, but a value of the corpus.
"""

from __future__ import annotations

import contextlib
import hashlib
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import parallelism, table

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "name")
KEY_SETTING = "quillon.pii.key"
DEMO_KEY = "no secret: set quillon.pii.key"
OFFERS = (1, 4, 16)  # cycles that the rounds of redrawing try for each value that is left; the last of them for all further rounds
DENSE = 32  # of a format with at most so many values for each that the corpus has, all places are listed: so the work stays linear
PLACES = 1 << 14  # places that are listed at a time
MOST_CARRIED = 1 << 16  # redrawn values that tasks get as a list; of more, each text gets its own by a join
# Forms of address and the gender they tell.
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Lord": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Dra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "", "Doctor": "", "Prof": "", "Professor": "", "Mx": "", "Rev": ""}
# Phrases that introduce a name.
CUES = ("my name is", "My name is", "je m'appelle", "Je m'appelle", "mon nom est", "Mon nom est", "ich heiße", "Ich heiße", "mein Name ist", "Mein Name ist", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "Name:", "Contact:", "Author:", "Signed:")
# Country calling codes of one and of two digits; all others have three.
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
# The part before the @ is looked for backwards from it. Letters of scripts that are written without spaces end it.
_LOCAL = re.compile(r"[A-Za-z0-9._%+\-\u00C0-\u024F\u0370-\u052F]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]{0,62}[^\W_])?\.){1,8}(?:[A-Za-z]{2,24}|[^\W\d_]{2,24})")
_NUMBERS = re.compile(
    r"(?=[\d+(]|[A-Z]{2}\d)(?:(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w+])\+\d(?:[ ().\-/]{0,2}\d){6,14}(?!\w)"
    r"|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"
    r"|(?<![\w+.-])0\d{9}(?![\w-])"
    r"|(?<![\w+.-])0\d{1,4}(?:[ ./-]\d{2,8}){1,4}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<!\w)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)))"
)
_DIGIT = re.compile("[0-9]")
# Words of family names that begin with a small letter, and offices, which follow a title and are no names.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "du", "la", "le", "el", "al", "bin", "bint", "ben", "ibn", "ter", "ten", "zu", "zum", "zur", "af", "av", "y")
OFFICES = ("President", "Vice", "Chairman", "Chairwoman", "Speaker", "Minister", "Ambassador", "Secretary", "Justice", "Mayor", "Chancellor", "Director", "Senator", "Präsident", "Präsidentin", "Minister", "Ministerin", "Bundeskanzler", "Bundeskanzlerin", "Président", "Présidente", "Ministre", "Presidente", "Ministro", "Ministra", "Президент", "Министр")
_TITLES = "|".join(sorted(TITLES, key=len, reverse=True))
_TITLE = re.compile(rf"(?:{_TITLES})\.?\s")
_MARKED = r"(?:\p{M}|[ʼ‌‍](?=\p{L})|['’](?=\p{L})(?!s\b))"
_PLAIN = r"[\p{Lo}\u10D0-\u10FF]"  # letters without capitals
_WORD = rf"(?:[\p{{Lu}}\p{{Lt}}]{_MARKED}*\p{{L}}(?:\p{{L}}|{_MARKED})*|{_PLAIN}(?:{_PLAIN}|{_MARKED})*)(?:[-‐]\p{{L}}(?:\p{{L}}|{_MARKED})*)*"
_INITIAL = r"[\p{Lu}\p{Lt}](?:\.-?|(?=\s))"
_SMALL = "|".join(PARTICLES)
_GAP = r"[^\S\r\n]+"
_BETWEEN = rf"(?:{_GAP}|(?<=\.)|(?<=d['’]))"
_PART = rf"(?:{_INITIAL}|{_WORD}(?![\p{{L}}\p{{N}}])|(?:{_SMALL}){_GAP}|d['’])"
_NAMES = regex.compile(
    rf"(?:(?<![\p{{L}}\p{{N}}_])(?P<titles>(?:(?:{_TITLES})\b\.?\s+)+)(?:(?:{'|'.join(sorted(OFFICES, key=len, reverse=True))})\b(?:{_GAP}|(?=\W|\Z)))*+|(?:{'|'.join(CUES)})\s+)"
    rf"(?P<words>(?:{_PART})(?:{_BETWEEN}?(?:{_PART}))*)"
)
_PIECE = regex.compile(rf"(?P<small>(?:{_SMALL})(?=\s)|d['’])|(?P<word>{_WORD})|(?P<initial>[\p{{Lu}}\p{{Lt}}])")
_MENTION = regex.compile(rf"(?<![\p{{L}}\p{{N}}_]){_WORD}")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{1,4}|:)|::[0-9A-Fa-f])[0-9A-Fa-f:]*(?![\w:]|\.\d)")
# Blocks of addresses that stay within themselves, as (first, size): own, private, loopback, multicast and reserved.
_BLOCKS = ((0, 1 << 24), (10 << 24, 1 << 24), (127 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16), (224 << 24, 1 << 29))
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2), "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2))
_PLACE = {c: (n, i) for n, a in enumerate(_ALPHABETS) for i, c in enumerate(a)}
_SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдклмнпрстз", "аеиоу"), "greek": ("βγδκλμνπρστφ", "αειου")}
_ENDS = {"latin": {"m": "on", "f": "ia"}, "cyrillic": {"m": "ин", "f": "ина"}, "greek": {"m": "ος", "f": "ια"}}


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    value: str
    gender: str = ""


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _mails(text: str) -> Iterator[Entity]:
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        own = local[0].lstrip("._%+-") if local else ""
        if own and domain:
            yield Entity(at - len(own), domain.end(), "email", f"{own}@{domain[0]}")
        at = text.find("@", at + 1)


def _numbers(text: str) -> Iterator[Entity]:
    for m in _NUMBERS.finditer(text):
        kind, raw = m.lastgroup, re.sub("[ -]", "", m[0])
        if kind == "ip" and any(int(x) > 255 for x in raw.split(".")):
            continue
        if kind == "phone" and not 7 + 2 * (m[0][0] == "0") <= len(_DIGIT.findall(raw)) <= 15:
            continue  # a plain number or a date: with a trunk zero a phone has nine digits at least
        if kind == "card" and len(raw) not in (15, 16) and not luhn(raw):
            continue  # of other lengths only numbers with a right check digit are cards
        if kind == "iban" and (len(raw) < 15 or _iban_rest(raw) != 1):
            continue
        yield Entity(m.start(), m.end(), kind, m[0])


def _names(text: str) -> Iterator[Entity]:
    """Names after titles and cues, and all other mentions of their words in the text.

    A name goes on over any number of capitalised words, initials and particles of one line; titles may be several, and
    an office after them is no name. Letters of scripts without case count as capitals, so of a sentence in
    such a script all words after the title are taken. The last word is a family name, the others have the gender of the
    titles, wherever they stand in the text. Initials are replaced where they stand in a name.
    """
    genders: dict[str, str] = {}
    if not _TITLE.search(text) and not any(cue in text for cue in CUES):  # far quicker than the whole pattern
        return
    for m in _NAMES.finditer(text):
        pieces = [p for p in _PIECE.finditer(text, m.start("words"), m.end("words")) if not p["small"]]
        title = next((g for t in re.findall(r"\w+", m["titles"] or "") if (g := TITLES.get(t))), "")
        last = max((i for i, p in enumerate(pieces) if p["word"]), default=-1)
        for i, p in enumerate(pieces):
            if p["initial"]:
                yield Entity(p.start(), p.end(), "name", p[0])
            elif p[0] not in TITLES:
                genders[p[0].casefold()] = genders.get(p[0].casefold()) or (title if i < last else "")
    if genders:
        for m in _MENTION.finditer(text):
            word = m[0] if m[0].casefold() in genders else re.split("['’]", m[0])[0]  # a genitive
            if word.casefold() in genders and word not in TITLES:
                yield Entity(m.start(), m.start() + len(word), "name", word, genders[word.casefold()])
            elif word == m[0] and "-" in word:  # a part of a double name
                at = m.start()
                for part in word.split("-"):
                    if part.casefold() in genders and part not in TITLES:
                        yield Entity(at, at + len(part), "name", part, genders[part.casefold()])
                    at += len(part) + 1


def _addresses(text: str) -> Iterator[Entity]:
    """IPv6 addresses; those of the machine itself and of nothing tell nothing and stay."""
    for m in _IP6.finditer(text):
        with contextlib.suppress(ValueError):
            own = ipaddress.IPv6Address(m[0])
            if int(own) > 1:
                yield Entity(m.start(), m.end(), "ip", m[0])


def detect(text: str | None) -> list[Entity]:
    """Non-overlapping entities in order; the earlier and then the longer one wins."""
    if not text:
        return []
    found = [*_mails(text)]
    if _DIGIT.search(text):
        found += _numbers(text)
        if text.count(":") > 1:
            found += _addresses(text)
    found += _names(text)
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _phone(text: str) -> tuple[int, str]:
    """How many digits lead (country code, trunk zero), and the others."""
    digits = "".join(_DIGIT.findall(text))
    before = text.split("(")[0] if "(" in text else ""
    lead = 0
    if text[0] == "+":
        lead = next((n for n in (1, 2) if digits[:n] in CALLING_CODES), 3)
    elif _DIGIT.search(before):
        lead = len(_DIGIT.findall(before))
    return lead + (digits[lead : lead + 1] == "0"), digits[lead + (digits[lead : lead + 1] == "0") :]


def canonical(kind: str, text: str) -> str:
    """What all mentions of one value have in common."""
    if kind in ("email", "name"):
        return text.casefold()
    if kind == "phone":
        return _phone(text)[1]
    if kind == "ip" and ":" in text:
        return ipaddress.IPv6Address(text).exploded
    return text if kind == "ip" else "".join(c for c in text if c.isalnum()).upper()


def _script(letter: str) -> str:
    """The first word of the letter's name in Unicode: LATIN, CYRILLIC, HEBREW, CJK and so on, in small letters."""
    return unicodedata.name(letter, "latin ").split(" ")[0].casefold()


@lru_cache(maxsize=256)
def _stock(letter: str) -> str:
    """The letters that surrogates of a script without sounds of its own here are drawn from: those of the letter's script
    and kind in its block of 256, or all common ones for ideographs and Hangul."""
    wide = {"cjk": (0x4E00, 0x9FA6), "hangul": (0xAC00, 0xD7A4)}.get(_script(letter))
    low, high = wide or (ord(letter) & ~0xFF, (ord(letter) | 0xFF) + 1)
    same = (unicodedata.category(letter), _script(letter))
    return "".join(c for c in map(chr, range(low, high)) if (unicodedata.category(c), _script(c)) == same)


def initial(kind: str, text: str) -> bool:
    """Whether an entity is a name's initial. Those are apart within their alphabet, but can't be apart from other initials' letters."""
    return kind == "name" and len(text) == 1 and text in _PLACE


class Surrogates:
    """Surrogates under one key. width: least syllables of a name, the size of the space names are drawn
    from; draw: which of many cycles through the values of a format is taken; again: the draws of values,
    by (kind, canonical form), that take another."""

    def __init__(self, key: bytes, width: int = 3, draw: int = 0, again: dict[tuple[str, str], int] | None = None):
        self.secret, self.width, self.draw, self.again = key, width, draw, again or {}
        self.key = hashlib.blake2b(b"%d|" % draw + key, digest_size=32).digest()
        self.of = lru_cache(100_000)(self._of)

    def __reduce__(self):
        return Surrogates, (self.secret, self.width, self.draw, self.again)

    @lru_cache(maxsize=2048)  # noqa: B019
    def at(self, draw: int) -> Surrogates:
        """The surrogates of another draw; a negative one is a place (see Placed)."""
        return self if draw == self.draw else Placed(-1 - draw) if draw < 0 else Surrogates(self.secret, self.width, draw)

    def _hash(self, data: bytes, size: int = 64) -> int:
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=size).digest())

    def _feistel(self, tweak: bytes, value: int, half: int, back: bool) -> int:
        mask, size = (1 << half) - 1, -(-half // 8)
        left, right = value >> half, value & mask
        for r in range(6)[:: -1 if back else 1]:
            if back:
                left, right = right ^ (self._hash(tweak + bytes([r]) + left.to_bytes(size)) & mask), left
            else:
                left, right = right, left ^ (self._hash(tweak + bytes([r]) + right.to_bytes(size)) & mask)
        return left << half | right

    def step(self, tweak: bytes, value: int, total: int) -> int:
        """The next of 0 ... total-1 on a keyed cycle through all of them."""
        if total < 2:
            return value
        half = max(1, -(-(total - 1).bit_length() // 2))
        for back in (True, False):
            value = self._feistel(tweak, value, half, back)
            while value >= total:
                value = self._feistel(tweak, value, half, back)
            if back:
                value = (value + 1) % total
        return value

    def same_pattern(self, kind: str, text: str, valid: Callable[[str], bool] = lambda _: True, fixed: int = 0) -> str:
        """text with letters and digits replaced within their alphabets; the first fixed of them stay."""
        places = [(i, *_PLACE[c]) for i, c in enumerate(text) if c in _PLACE][fixed:]
        pattern = list(text)
        for i, n, _ in places:
            pattern[i] = f"\0{n}"
        tweak = f"{kind}|{''.join(pattern)}".encode()[:900]
        value, total = 0, 1
        for _, n, d in places:
            value, total = value * len(_ALPHABETS[n]) + d, total * len(_ALPHABETS[n])
        if total.bit_length() > 1000:  # longer than any real value: halves on their own
            middle = len(text) // 2
            return self.same_pattern(kind, text[:middle]) + self.same_pattern(kind, text[middle:])
        while True:
            value, out, rest = self.step(tweak, value, total), list(text), 0
            rest = value
            for i, n, _ in reversed(places):
                rest, d = divmod(rest, len(_ALPHABETS[n]))
                out[i] = _ALPHABETS[n][d]
            if valid("".join(out)):
                return "".join(out)

    def name(self, word: str, gender: str) -> str:
        """As long as the word, or a little longer; all genders of a word begin alike. Initials move within their alphabet."""
        if len(word) == 1 and word in _PLACE:
            return self.same_pattern("initial", word)
        script = _script(word[0])
        if script not in _SOUNDS:
            stock, out = _stock(word[0]), ""
            n = self._hash(f"name|{script}|{self.width}|{word.casefold()}".encode())
            for _ in range(max(len(word), self.width - 2)):
                n, c = divmod(n, len(stock))
                out += stock[c]
            return out
        consonants, vowels = _SOUNDS[script]
        n, out = self._hash(f"name|{script}|{self.width}|{word.casefold()}".encode()), ""
        for _ in range(max(self.width, -(-len(word) // 2) - bool(gender))):
            n, c = divmod(n, len(consonants))
            n, v = divmod(n, len(vowels))
            out += consonants[c] + vowels[v]
        out = out[:-1] + _ENDS[script][gender] if gender else out
        return out.upper() if word.isupper() and len(word) > 1 else out.capitalize()

    def _of(self, kind: str, text: str, gender: str = "") -> str:
        if kind == "name":
            return self.name(text, gender)
        if kind == "email":
            local, _, domain = text.lower().partition("@")
            labels = domain.split(".")
            keep = 2 if labels[-2] == "example" and len(labels) > 2 else 1
            own = ".".join(labels[:-keep])
            new = f"{self.same_pattern('email@' + domain, local)}@{self.same_pattern('domain', own)}.{'.'.join(labels[-keep:])}"
            return "".join(n.upper() if o.isupper() else n for o, n in zip(text, new, strict=True)) if len(new) == len(text) else new
        if kind == "ip":
            return self._ip(text)
        digits = [c for c in text if c.isalnum()]
        if kind == "card":
            if not luhn("".join(digits)):
                return _filled(text, self.same_pattern("card", "".join(digits), lambda s: not luhn(s), fixed=1))
            body = self.same_pattern("card", "".join(digits[:-1]), fixed=1)
            check = next(d for d in "0123456789" if luhn(body + d))
            return _filled(text, body + check)
        if kind == "iban":
            body = self.same_pattern("iban", "".join(digits[:2]) + "00" + "".join(digits[4:]), fixed=4)
            return _filled(text, body[:2] + f"{98 - _iban_rest(body):02d}" + body[4:])
        if kind == "ssn":
            good = lambda s: s[:3] not in ("000", "666") and s[0] != "9"
            return self.same_pattern("ssn", text, good if good(text) else lambda s: not good(s))
        lead, own = _phone(text)
        real = own[:1] in ("0", "1")
        rest = iter(self.same_pattern("phone", own, lambda s: (s[:1] in ("0", "1")) == real))
        seen, out = 0, ""
        for c in text:
            seen += c in "0123456789"
            out += next(rest) if c in "0123456789" and seen > lead else c
        return out

    def _ip(self, text: str) -> str:
        if ":" in text:
            return self._ip6(text)

        value = int(ipaddress.IPv4Address(".".join(str(int(x)) for x in text.split("."))))
        for low, size in _BLOCKS:
            if low <= value < low + size:
                return str(ipaddress.IPv4Address(low + self.step(b"ip%d" % low, value - low, size)))
        while True:  # on the cycle through all, past the blocks above
            value = self.step(b"ip", value, 1 << 32)
            if not any(low <= value < low + size for low, size in _BLOCKS):
                return str(ipaddress.IPv4Address(value))

    def _ip6(self, text: str) -> str:
        """Of the same kind: link-local in its /64, unique local in its /8, global in its /3, others in their /16."""
        own = ipaddress.IPv6Address(text)
        keep = 64 if own.is_link_local else 8 if int(own) >> 121 == 0x7E else 3 if int(own) >> 125 == 1 else 16
        rest = 128 - keep
        new = self.step(b"ip6|%d" % (int(own) >> rest), int(own) & ((1 << rest) - 1), 1 << rest) | int(own) >> rest << rest
        out = str(ipaddress.IPv6Address(new)) if "::" in text or new <= 1 else ":".join(f"{int(x, 16):x}" for x in ipaddress.IPv6Address(new).exploded.split(":"))
        return out.upper() if text != text.lower() else out

    def rewrite(self, text: str | None, again: dict[tuple[str, str], int] | None = None) -> tuple[str | None, Counter]:
        """The text with surrogates, and how many of each kind. again: as of the whole, for this text alone."""
        found, again = detect(text), again or self.again
        if not found:
            return text, Counter()
        out, at = [], 0
        for e in found:
            draw = again.get((e.kind, canonical(e.kind, e.value)), self.draw) if again and e.kind != "name" else self.draw
            out += [text[at : e.start], self.at(draw).of(e.kind, e.value, e.gender)]
            at = e.end
        return "".join([*out, text[at:]]), Counter(e.kind for e in found)


class Placed(Surrogates):
    """Of every value the one that has the number `place` among all of its format, where there is one; else ValueError."""

    def __init__(self, place: int = 0):
        super().__init__(b"")
        self.place = place

    def __reduce__(self):
        return Placed, (self.place,)

    def _of(self, kind: str, text: str, gender: str = "") -> str:
        self.rest, self.steps = self.place, []
        return super()._of(kind, text, gender)

    def step(self, tweak: bytes, value: int, total: int) -> int:
        if tweak in self.steps:
            raise ValueError(f"place {self.place} is none of this format")  # it was no valid value
        self.steps.append(tweak)
        self.rest, own = divmod(self.rest, total)
        return own


class _Format(Surrogates):
    """What makes the format of a value: its surrogate is the value itself, and the steps are noted."""

    def step(self, tweak: bytes, value: int, total: int) -> int:
        self.tweaks.append(tweak)
        self.total *= total
        return value

    def of_value(self, kind: str, text: str) -> tuple[str, int]:
        """(shape, total): values of one shape can stand for each other, and have numbers below total, of which some may be invalid."""
        self.tweaks, self.total = [], 1
        own = canonical(kind, self._of(kind, text))
        tweaks = [t.decode(errors="replace") for t in self.tweaks]
        if kind == "email":  # without the domain, which takes a step too
            domain = own.partition("@")[2].split(".")
            tweaks = [t.split("|", 1)[-1] for t in tweaks] + domain[-2 if domain[-2] == "example" and len(domain) > 2 else -1 :]
        good = {"card": luhn, "ssn": lambda s: s[:3] not in ("000", "666") and s[:1] != "9", "phone": lambda s: s[:1] in ("0", "1")}.get(kind, bool)
        return "|".join([*tweaks, str(good(own))]), min(self.total, 1 << 62)


def _filled(pattern: str, characters: str) -> str:
    rest = iter(characters)
    return "".join(next(rest) if c.isalnum() else c for c in pattern)


def entities(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """(kind, value, text, gender) of every distinct entity of the corpus; text is one mention of the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(e.kind, canonical(e.kind, e.value), e.gender): e.value for t in batch.column(0).to_pylist() for e in detect(t) if not initial(e.kind, e.value)}
            cols = list(zip(*[(k, v, t, g) for (k, v, g), t in sorted(found.items())], strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "value", "text", "gender"])

    rows = documents.select(F.col(text_column).cast("string")).mapInArrow(run, "kind string, value string, text string, gender string")
    return rows.groupBy("kind", "value", "gender").agg(F.min("text").alias("text")).select("kind", "value", "text", "gender")


def drawn(found: DataFrame, made: Surrogates) -> DataFrame:
    """(kind, value, text, surrogate) of entities, written; the surrogate in its canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, _, texts, genders = (c.to_pylist() for c in batch.columns)
            new = [canonical(k, made.of(k, t, g)) for k, t, g in zip(kinds, texts, genders, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], names=["kind", "value", "text", "surrogate"])

    return table(found.mapInArrow(run, "kind string, value string, text string, surrogate string"), "drawn")


def clashes(rows: DataFrame) -> DataFrame:
    """(kind, surrogate, least) of the surrogates that stand for several values, of which only the least may keep it, or
    that are a value of the corpus, which none may keep (null)."""
    shared = rows.groupBy("kind", "surrogate").agg(F.min("value").alias("least"), F.max("value").alias("most")).where("least <> most").drop("most")
    values = rows.select(F.col("kind").alias("own_kind"), F.col("value").alias("own")).distinct()
    real = rows.join(values, (F.col("kind") == F.col("own_kind")) & (F.col("surrogate") == F.col("own")), "left_semi").select("kind", "surrogate").distinct()
    return shared.unionByName(real.withColumn("least", F.lit(None).cast("string"))).groupBy("kind", "surrogate").agg(F.when(F.count("*") == F.count("least"), F.min("least")).alias("least"))


def _formats(rows: DataFrame, made: Surrogates) -> DataFrame:
    """rows (kind, value, text, surrogate) with the shape and total of their format and a number that the key draws for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Format(b"")
        for batch in batches:
            kinds, values, texts = (batch.column(c).to_pylist() for c in ("kind", "value", "text"))
            shapes = [of.of_value(k, t) for k, t in zip(kinds, texts, strict=True)]
            lots = [made._hash(f"lot|{k}|{v}".encode(), 8) >> 1 for k, v in zip(kinds, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in shapes], pa.string()), pa.array([n for _, n in shapes], pa.int64()), pa.array(lots, pa.int64())], names=[*batch.schema.names, "shape", "total", "lot"])

    return rows.mapInArrow(run, "kind string, value string, text string, surrogate string, shape string, total long, lot long")


def _places(formats: DataFrame) -> DataFrame:
    """(kind, shape, place, surrogate) of all values of formats (kind, shape, total, text), in canonical form; text is one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Placed()
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                for made.place in range(r["first"], min(r["first"] + PLACES, r["total"])):
                    with contextlib.suppress(ValueError):
                        out.append((made.place, canonical(r["kind"], made._of(r["kind"], r["text"]))))
                cols = [[r["kind"]] * len(out), [r["shape"]] * len(out), [p for p, _ in out], [x for _, x in out]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["kind", "shape", "place", "surrogate"])

    some = formats.select("kind", "shape", "total", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(PLACES).cast("long"))).alias("first"))
    return some.repartition(parallelism(formats.sparkSession), "shape", "first").mapInArrow(run, "kind string, shape string, place long, surrogate string")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows (kind, shape, ...) with their number `no` in their format. Parts number their own rows; what is ahead of a part comes from a table with a row for each."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("kind", "shape", order), F.lit(parallelism(rows.sparkSession, 64))))
    ahead = F.sum("n").over(Window.partitionBy("kind", "shape").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("kind", "shape", "part").agg(F.count("*").alias("n")).select("kind", "shape", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("kind", "shape", "part").orderBy(order))
    return rows.withColumn("own", own).join(sizes, ["kind", "shape", "part"]).withColumn("no", F.col("ahead") + F.col("own")).drop("part", "own", "ahead")


def _dealt(left: DataFrame, taken: DataFrame, dense: DataFrame) -> DataFrame:
    """(kind, value, draw, surrogate) of what is left in dense formats: free places, one each, until there are no more."""
    places = _places(dense).join(taken, ["kind", "surrogate"], "left_anti")
    free = table(places.groupBy("kind", "surrogate").agg(F.min(F.struct("shape", "place")).alias("x")).select("kind", "surrogate", "x.shape", "x.place"), "free")
    wanted = _numbered(left.select("kind", "shape", "value", F.struct("lot", "value").alias("lot")), "lot")
    return wanted.join(_numbered(free, "place"), ["kind", "shape", "no"]).select("kind", "value", (-1 - F.col("place")).alias("draw"), "surrogate")


def redrawn(rows: DataFrame, bad: DataFrame, made: Surrogates) -> DataFrame:
    """(kind, value, draw) of the values other than names whose surrogate is bad (see clashes), as long as their format has places.

    Of dense formats all places are listed, and those that no value has, as its own or as its surrogate, are dealt out.
    In all others most places are free. Every round offers each value that is left surrogates of further cycles; a value
    asks for its first free one, and the least value that asks gets it. Rounds end when no value is left.
    """

    def offered(first: int, count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    some = batch.slice(at, 64).to_pylist()
                    new = [(r["kind"], r["value"], d, canonical(r["kind"], made.at(d).of(r["kind"], r["text"]))) for d in range(first, first + count) for r in some]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in new], pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True))))

        names = ("kind", "value", "draw", "surrogate")
        return run

    rows = table(_formats(rows.where("kind <> 'name'"), made), "formats")
    left = table(rows.join(bad, ["kind", "surrogate"]).where("least is null or value <> least").select("kind", "value", "text", "shape", "lot"), "left")
    taken = rows.select("kind", "surrogate").unionByName(rows.select("kind", F.col("value").alias("surrogate")))
    dense = rows.groupBy("kind", "shape", "total").agg(F.count("*").alias("held"), F.min("text").alias("text")).where(F.col("total") / DENSE <= F.col("held"))
    dense = table(dense.join(left.select("kind", "shape").distinct(), ["kind", "shape"], "left_semi"), "dense")
    got, first = [], 1
    if not dense.isEmpty():
        got.append(table(_dealt(left.join(dense, ["kind", "shape"], "left_semi"), taken, dense), "dealt"))
        taken = taken.unionByName(got[-1].select("kind", "surrogate"))
        left = table(left.join(dense, ["kind", "shape"], "left_anti"), "left")
    for count in chain(OFFERS, repeat(OFFERS[-1])):
        if left.isEmpty():
            break
        offers = table(left.select("kind", "value", "text").mapInArrow(offered(first, count), "kind string, value string, draw long, surrogate string"), "offers")
        free = offers.join(taken.join(offers.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi"), ["kind", "surrogate"], "left_anti")
        asked = free.groupBy("kind", "value").agg(F.min(F.struct("draw", "surrogate")).alias("x")).select("kind", "value", "x.draw", "x.surrogate")
        won = asked.groupBy("kind", "surrogate").agg(F.min(F.struct("value", "draw")).alias("x")).select("kind", "x.value", "x.draw", "surrogate")
        got.append(table(won, "won"))
        taken = taken.unionByName(got[-1].select("kind", "surrogate"))
        left = table(left.join(got[-1].select("kind", "value"), ["kind", "value"], "left_anti"), "left")
        first += count
    out = got[0]
    for more in got[1:]:
        out = out.unionByName(more)
    return out.select("kind", "value", "draw")


def checked(documents: DataFrame, key: bytes, text_column: str = "text") -> tuple[Surrogates, DataFrame | None]:
    """Surrogates of the least width that keep all names of these documents apart, from each other and from all names,
    and the (kind, value, draw) of other values that have to take another draw; None if there are none."""
    found, width = table(entities(documents, text_column), "entities"), 3
    while True:
        made = Surrogates(key, width)
        rows = drawn(found, made)
        bad = table(clashes(rows), "clashes")
        kinds = {r["kind"] for r in bad.select("kind").distinct().collect()}  # a row for each kind
        if "name" not in kinds:
            return made, redrawn(rows, bad, made) if kinds else None
        width += 1


def checked_surrogates(documents: DataFrame, key: bytes, text_column: str = "text") -> Surrogates:
    """What `checked` gives, with all draws in the object; for corpora whose redrawn values fit into memory."""
    made, again = checked(documents, key, text_column)
    return made if again is None else Surrogates(key, made.width, again={(r["kind"], r["value"]): r["draw"] for r in again.collect()})


def key_of(spark: SparkSession) -> bytes:
    """The secret that the session names; without one, a key that everybody knows, for trials only."""
    return spark.conf.get(KEY_SETTING, DEMO_KEY).encode()


def draws_of(documents: DataFrame, again: DataFrame, text_column: str) -> DataFrame:
    """(digest, draws) of every text of documents that has values of `again`: draws lists those as (kind, value, draw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(d, k, v) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, v in sorted({(e.kind, canonical(e.kind, e.value)) for e in detect(t) if e.kind != "name"})]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*pairs, strict=True)) or [()] * 3], names=["digest", "kind", "value"])

    text = F.col(f"`{text_column}`").cast("string")
    said = documents.select(F.md5(text).alias("digest"), text.alias("text")).mapInArrow(run, "digest string, kind string, value string")
    return said.join(again, ["kind", "value"]).groupBy("digest").agg(F.collect_set(F.struct("kind", "value", "draw")).alias("draws"))


def replace_private(documents: DataFrame, key: bytes, text_column: str = "text", counts: bool = False, most_carried: int = MOST_CARRIED) -> DataFrame:
    """documents with the text rewritten, all other columns as they are; counts adds n_<kind> columns.

    A name of those that is taken gets underscores. Null texts stay null, empty ones empty. Rows are
    independent: repeated rows stay repeated and equal. Values with a draw of their own are carried to all tasks if they are
    at most most_carried; if more, a join gives each text its own.
    """
    made, again = checked(documents, key, text_column)
    place, n_columns = documents.columns.index(text_column), len(documents.columns)
    schema = documents.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_column else F.col(f"`{c}`") for c in documents.columns]).schema
    for kind in KINDS if counts else ():
        name = f"n_{kind}"
        while name in schema.names:
            name += "_"
        schema = schema.add(name, "long")
    rows = documents.withColumn(text_column, F.col(f"`{text_column}`").cast("string"))
    few = again.limit(most_carried + 1).collect() if again is not None else []
    if len(few) > most_carried:
        digest, draws = (next(n for n in (f"{x}{'_' * i}" for i in range(n_columns + 1)) if n not in documents.columns) for x in ("digest", "draws"))
        lists = table(draws_of(documents, again, text_column), "draws").toDF(digest, draws)
        rows = rows.withColumn(digest, F.md5(f"`{text_column}`")).join(lists, digest, "left").select(*[F.col(f"`{c}`") for c in (*documents.columns, draws)])
    else:
        made = Surrogates(key, made.width, again={(r["kind"], r["value"]): r["draw"] for r in few})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                own = some.column(n_columns).to_pylist() if some.num_columns > n_columns else [None] * len(some)
                done = [made.rewrite(t, {(x["kind"], x["value"]): x["draw"] for x in d or ()}) for t, d in zip(some.column(place).to_pylist(), own, strict=True)]
                columns = list(some.columns[:n_columns])
                columns[place] = pa.array([t for t, _ in done], pa.string())
                if counts:
                    columns += [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def private_stage(documents: DataFrame, key: bytes | None = None) -> DataFrame:
    """documents with the text rewritten, and n_chars following it (null for null texts)."""
    done = replace_private(documents, key or key_of(documents.sparkSession))
    return done.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in done.columns else done
