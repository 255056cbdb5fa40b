"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation are permuted inside their own format by a keyed Feistel network: a card
number becomes another valid card number, a date another date written alike. The permutation depends on the key, the kind
and the format's size alone, so equal values stay linked across documents and different values stay apart.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept_in_worker, valid_text

KINDS = ("email", "date", "ip", "card", "iban", "ssn", "phone")
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: Values whose pseudonyms a Python worker remembers.
REMEMBERED = 100_000

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:(?:[^\W_]|-){1,63}\.)+[^\W\d_]{2,24}")
NUMBERS = re.compile(r"""
  (?P<date>(?<![\d.-])(?:(?:19|20)\d\d(?P<s1>[-/.])\d\d(?P=s1)\d\d|\d\d?(?P<s2>[-/.])\d\d?(?P=s2)(?:19|20)\d\d)(?![\d]|[-/.]\d))
| (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))
| (?P<iban>(?<![A-Z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Z0-9]))
| (?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{4}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?!\d))
| (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
| (?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?|\(\d{2,4}\)|(?<!\d)\d{3}[ .-](?=\d{3}[ .-]))[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\d-]))
""", re.VERBOSE | re.ASCII)  # fmt: skip
#: Characters of an IBAN by country, as the public registry lists them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Country calling codes of one and two digits, as the public numbering plan lists them; all others have three.
CALLING_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56",
    "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
_digit = re.compile(r"[0-9]").search


class Feistel:
    """Keyed permutations of ``range(size)``: a balanced Feistel network over enough bits, walked until inside."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permuted(self, value: int, size: int, tweak: str) -> int:
        half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        mask, name, width = (1 << half) - 1, f"{tweak}/{size}/".encode(), -(-half // 8)
        while True:
            left, right = value >> half, value & mask
            for k in range(ROUNDS):
                told = name + bytes([k]) + right.to_bytes(width, "big")
                left, right = right, left ^ (int.from_bytes(self._mixed(told, width), "big") & mask)
            value = left << half | right
            if value < size:
                return value

    def _mixed(self, told: bytes, width: int) -> bytes:
        """``width`` bytes, as wide as half of a value may be."""
        if width <= 64:
            return hashlib.blake2b(told, key=self.key, digest_size=max(16, width)).digest()
        return b"".join(hashlib.blake2b(told + at.to_bytes(8, "big"), key=self.key).digest() for at in range(0, width, 64))


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1])


def luhn_digit(digits: str) -> int:
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[::-2])
    return -(sum(twice) + sum(map(int, digits[-2::-2]))) % 10


def _laid(shape: str, symbols: str) -> str:
    """``shape`` with its digits and letters replaced in turn."""
    new = iter(symbols)
    return "".join(next(new) if c.isalnum() else c for c in shape)


@cache
def _alphabet(block: int, kind: str) -> str:
    """The characters of one kind in a stretch of 128 code points: ASCII's a to z, the lower-case Greek or Cyrillic ones."""
    return "".join(c for c in map(chr, range(block << 7, (block + 1) << 7)) if _kind(c) == kind)


@cache
def _kind(c: str) -> str:
    """The Unicode category of letters and decimal digits; other characters have none and stay as they are."""
    found = unicodedata.category(c)
    return found if found in ("Lu", "Ll", "Lo", "Nd") else ""


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonyms:
    """Each kind's pseudonym of a text that its pattern found, or None where the value isn't valid."""

    def __init__(self, key: bytes) -> None:
        self.net, self.known = Feistel(key), {}

    def of(self, kind: str, found: str) -> str | None:
        if (kind, found) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[kind, found] = getattr(self, f"_{kind}")(found)
        return self.known[kind, found]

    def _digits(self, digits: str, tweak: str) -> str:
        return str(self.net.permuted(int(digits), 10 ** len(digits), tweak)).zfill(len(digits))

    def _card(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        new = self._digits(digits[:-1], "card")
        return _laid(found, new + str(luhn_digit(new)))

    def _ip(self, found: str) -> str | None:
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255:
            return None
        new = self.net.permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, new.to_bytes(4, "big")))

    def _date(self, found: str) -> str | None:
        separator = re.search(r"[-/.]", found)[0]
        parts = found.split(separator)
        year_first = len(parts[0]) == 4
        year, month, day = parts if year_first else parts[::-1]
        swapped = int(month) > 12
        if swapped:
            month, day = day, month
        try:
            at = dt.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        new = dt.date.fromordinal(FIRST_DAY + self.net.permuted(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
        width = [len(p) for p in parts]
        fields = [new.year, new.month, new.day] if year_first else [new.day, new.month, new.year]
        if swapped:
            fields = [new.year, new.day, new.month] if year_first else [new.month, new.day, new.year]
        return separator.join(str(f).zfill(w) for f, w in zip(fields, width, strict=True))

    def _ssn(self, found: str) -> str | None:
        area, group, serial = found.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        at = (int(area) - 1 - (int(area) > 666)) * 99 * 9999 + (int(group) - 1) * 9999 + int(serial) - 1
        rest, serial_at = divmod(self.net.permuted(at, 898 * 99 * 9999, "ssn"), 9999)
        area_at, group_at = divmod(rest, 99)
        return f"{area_at + 1 + (area_at >= 665):03}-{group_at + 1:02}-{serial_at + 1:04}"

    def _iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34 or len(plain) != IBAN_LENGTHS.get(plain[:2], len(plain)) or _mod97(plain) != 1:
            return None
        body = self._classes(plain[4:], f"iban/{plain[:2]}")
        return _laid(found, f"{plain[:2]}{98 - _mod97(plain[:2] + '00' + body):02}{body}")

    def _iban_in(self, found: str) -> tuple[str, str] | None:
        """The IBAN at the start of ``found``, which may run on into the next words, and its pseudonym."""
        ends = [m.end() for m in re.finditer(r"[A-Z0-9](?= |$)", found)]
        for end in reversed(ends):
            if (new := self.of("iban", found[:end])) is not None:
                return found[:end], new
        return None

    def _phone(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if not 7 <= len(digits) <= 15:
            return None
        country = next((n for n in (1, 2) if digits[:n] in CALLING_CODES), 3) if found[0] == "+" else 0
        return _laid(found, digits[:country] + self._digits(digits[country:], f"phone/{digits[:country]}"))

    def _email(self, found: str) -> str | None:
        local, _, domain = found.partition("@")
        return f"{self._classes(local, f'email/{domain.lower()}')}@{domain}"

    def _classes(self, text: str, tweak: str) -> str:
        """Each digit and letter becomes one of its kind and stretch of code points; other characters stay."""
        shape = [(ord(c) >> 7, kind) if (kind := _kind(c)) else None for c in text]
        value, size = 0, 1
        for c, at in zip(text, shape, strict=True):
            if at:
                letters = _alphabet(*at)
                value, size = value * len(letters) + letters.index(c), size * len(letters)
        told = "".join(f"{at[0]}{at[1]}" if at else "." for at in shape)
        value, out = self.net.permuted(value, size, f"{tweak}/{told}"), []
        for c, at in zip(reversed(text), reversed(shape), strict=True):
            if at:
                letters = _alphabet(*at)
                value, k = divmod(value, len(letters))
                c = letters[k]
            out.append(c)
        return "".join(reversed(out))

    def rewritten(self, text: str) -> tuple[str, dict[str, int]]:
        """``text`` with the pseudonyms of all valid values, and how many of each kind."""
        counts, out, at = dict.fromkeys(KINDS, 0), [], 0
        if "@" in text:
            for m in EMAIL.finditer(text):
                out += [self._numbers(text[at : m.start()], counts), self.of("email", m[0])]
                counts["email"] += 1
                at = m.end()
        return "".join([*out, self._numbers(text[at:], counts)]), counts

    def _numbers(self, text: str, counts: dict[str, int]) -> str:
        if not _digit(text):
            return text
        out, done, at = [], 0, 0
        while m := NUMBERS.search(text, at):
            kind, found = next(k for k in KINDS[1:] if m[k]), m[0]
            if kind == "iban":
                found, new = self._iban_in(found) or (found, None)
            else:
                new = self.of(kind, found)
            if new is None:
                at = m.start() + 2 if kind == "iban" else m.end()
                continue
            counts[kind] += 1
            at = m.start() + len(found)
            out += [text[done : m.start()], new]
            done = at
        return "".join([*out, text[done:]])


def pseudonymised(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_replaced`` and ``n_<kind>`` for each row of ``docs``; a text without valid values is unchanged.

    A null text stays null and holds nothing; bytes that aren't UTF-8 come out as U+FFFD. An international phone number
    keeps its calling code, and all spellings of its digits get the same digits. The domain of an e-mail address stays in
    the clear, and its names are permuted within it; domains may have letters of any script. Values that fail their validation (Luhn digit, calendar, octets, mod 97)
    stay; so do digits of other scripts outside e-mail names, and e-mail names beyond 64 characters, which aren't valid.
    Where two kinds fit at one place the first of KINDS' patterns decides. Texts of any length are read whole. Repeated
    rows give equal rows. An empty table gives an empty result. Other columns are not read.
    """

    def make():
        names = kept_in_worker(("pseudonyms", key), lambda: Pseudonyms(key))

        def rows(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            new, counts = (None, dict.fromkeys(KINDS, 0)) if text is None else names.rewritten(text)
            yield doc_id, new, sum(counts.values()), *(counts[k] for k in KINDS)

        return rows

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), valid_text(text_col).alias("text"))
    return arrow_rows(slim, "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{k} long" for k in KINDS), make)
