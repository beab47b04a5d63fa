"""Format-preserving pseudonyms for personal data (operator 5).

Values are found by pattern and validated (check digits, calendar, ranges); each is read as a number, permuted under a
key by a Feistel network over exactly the numbers of its format, and written back in that format with valid check
digits. One key gives one permutation per kind of value, so equal values stay equal across all documents and tasks
without any table, and whoever holds the key can undo it.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.batches import bound_batches

ROUNDS = 8

# Letters that stay within their kind. Other letters, digits and marks have an alphabet by ``_alphabet``; all other
# characters of a value stay as they are.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_KIND = {letter: alphabet for alphabet in ALPHABETS for letter in alphabet}
HEX_OF_BOTH_CASES = "0123456789abcdefABCDEF"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)



def _ranges(codes: Iterable[int]) -> str:
    """Code points in rising order as the inside of a character class."""
    spans: list[list[int]] = []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


# Marks and joiners inside words, which \w leaves out.
_MARKS = _ranges(n for n in range(0x300, 0x20000) if unicodedata.category(chr(n))[0] == "M" or n in (0x200C, 0x200D))
_PATTERN = re.compile(
    rf"(?P<email>(?<![\w{_MARKS}.+%-])[\w{_MARKS}.+%-]++@[\w{_MARKS}-]++(?:\.[\w{_MARKS}-]++)+)"
    r"""
  | (?P<secret>(?<!\w)(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}(?!\w))
  | (?P<iban>(?<!\w)[A-Z]{2}\d\d(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))
  | (?P<ymd>(?<![\w-])\d{4}-\d\d-\d\d(?:(?![\w-])|(?=T\d\d|t\d\d|Z\b)))
  | (?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w))
  | (?P<dmy>(?<![\w./])\d{1,2}(?P<mark>[./])\d{1,2}(?P=mark)\d{4}(?:(?![\w/])|(?=T\d\d)))
  | (?P<phone>(?<![\w+])\+1[\ .-]?(?:\(\d{3}\)|\d{3})[\ .-]?\d{3}[\ .-]?\d{4}(?!\w)
      |(?<![\w+])\+\d{1,3}[\ .-]?(?:\(\d{1,4}\)[\ .-]?|\d{1,4}[\ .-])\d{2,4}(?:[\ .-]?\d{2,4}){1,3}(?!\w)
      |(?<![\w+])\+\d{7,15}(?!\w|\.\d)
      |(?<!\w)\(\d{3}\)\ ?\d{3}[\ .-]\d{4}(?!\w)|(?<![\w-])\d{3}(?P<between>[.-])\d{3}(?P=between)\d{4}(?![\w-]))
  | (?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
  | (?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<fours>[\ -])\d{4}(?P=fours)\d{4}(?P=fours)\d{1,7}|\d{4}(?P<six>[\ -])\d{6}(?P=six)\d{5})(?!\w))
    """,
    re.VERBOSE,
)
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SIGN = re.compile(r"[\d@]\S*+")
# Characters behind a word with a digit that may belong to the same value.
REACH = 40


def permute(number: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of 0 .. ``size`` - 1: a balanced Feistel network, applied again while it leaves the range."""
    if size < 2:
        return number
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    rounds = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    label = f"{tweak}|{size}|".encode()

    def mixed(turn: int, value: int) -> int:
        digest = hashlib.blake2b(label + bytes([turn]) + value.to_bytes(width, "big"), key=key, digest_size=width + 8)
        return int.from_bytes(digest.digest(), "big") & mask

    while True:
        left, right = number >> half, number & mask
        for turn in rounds:
            if undo:
                left, right = right ^ mixed(turn, left), left
            else:
                left, right = right, left ^ mixed(turn, right)
        number = left << half | right
        if number < size:
            return number


def _group(letter: str) -> tuple[str, str, int]:
    return unicodedata.category(letter), unicodedata.name(letter, "").split(" ")[0], ord(letter) >> 16


@functools.cache
def _groups() -> dict[tuple, str]:
    """Letters, digits and marks outside ``ALPHABETS`` by category (so by case), script and plane, in rising order.

    Groups of fewer than ten are put together by category, and the smallest categories with each other.
    """
    groups: dict[tuple, list[str]] = {}
    for letter in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.category(letter)[0] in "LNM" and letter not in _KIND:
            groups.setdefault(_group(letter), []).append(letter)
    for part in (lambda group: group[:1], lambda group: ()):
        for group in [group for group, letters in groups.items() if group and len(letters) < 10]:
            groups.setdefault(part(group), []).extend(groups.pop(group))
    return {group: "".join(sorted(letters)) for group, letters in groups.items()}


@functools.lru_cache(maxsize=10_000)
def _alphabet(letter: str) -> str | None:
    """The letters among which ``letter`` is permuted; none for characters that are no letter, digit or mark.

    Beyond Latin-1 they depend on the Unicode version of the Python that runs, ``unicodedata.unidata_version``.
    """
    if letter in _KIND or ord(letter) < 128 or unicodedata.category(letter)[0] not in "LNM":
        return _KIND.get(letter)
    groups, group = _groups(), _group(letter)
    return next(groups[part] for part in (group, group[:1], ()) if letter in groups.get(part, ""))


def _letters(value: str, key: bytes, tweak: str, undo: bool) -> str:
    """Permute the letters, digits and marks of ``value``, each within its alphabet."""
    number, size = 0, 1
    kinds = [_alphabet(letter) for letter in value]
    for letter, kind in zip(value, kinds):
        if kind:
            place = kind.index(letter) if letter in _KIND else bisect_left(kind, letter)
            number, size = number * len(kind) + place, size * len(kind)
    number = permute(number, size, key, tweak, undo)
    out = []
    for letter, kind in zip(reversed(value), reversed(kinds)):
        if kind:
            number, place = divmod(number, len(kind))
            letter = kind[place]
        out.append(letter)
    return "".join(reversed(out))


def _fill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if letter.isdigit() else letter for letter in form)


def _luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    doubled = (int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled)


def _card(value: str, key: bytes, undo: bool) -> str | None:
    digits = "".join(filter(str.isdigit, value))
    if _luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = _letters(digits[:-1], key, "card", undo)
    # The check digit in the script of the old one.
    zero = ord(digits[-1]) - int(digits[-1])
    return _fill(value, body + chr(zero + -_luhn(body + "0") % 10))


def _iban_remainder(letters: str) -> int:
    return int("".join(str(int(letter, 36)) for letter in letters[4:] + letters[:4])) % 97


def _ibans(value: str) -> list[str]:
    """What may be the IBAN at the start of ``value``, which can hold words behind it: of its country's length, or all of
    it; for other countries any beginning."""
    beginnings = [value[:at] for at in range(len(value), 0, -1) if at == len(value) or value[at] == " "]
    length = IBAN_LENGTHS.get(value[:2])
    if length is None:
        return beginnings
    return sorted((v for v in beginnings if v == value or len(v.replace(" ", "")) == length), key=len)


def _iban(value: str, key: bytes, undo: bool) -> str | None:
    letters = value.replace(" ", "")
    if _iban_remainder(letters) != 1:
        return None
    body = _letters(letters[4:], key, "iban" + letters[:2], undo)
    check = f"{98 - _iban_remainder(letters[:2] + '00' + body):02d}"
    rest = iter(letters[:2] + check + body)
    return "".join(letter if letter == " " else next(rest) for letter in value)


def _date(year: str, month: str, day: str, key: bytes, undo: bool, first_day: int = 1) -> datetime.date | None:
    """The pseudonym of a date among the dates from ``first_day`` of their months on, to which it must belong."""
    try:
        date = datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    if not FIRST_DAY <= date <= LAST_DAY:
        return None
    days = (LAST_DAY - FIRST_DAY).days + 1
    while True:
        date = FIRST_DAY + datetime.timedelta(permute((date - FIRST_DAY).days, days, key, "date", undo))
        if date.day >= first_day:
            return date


def _like(value: str, text: str) -> str:
    """``text`` with its digits in the script of the first digit of ``value``."""
    first = next(letter for letter in value if letter.isdecimal())
    zero = ord(first) - unicodedata.decimal(first)
    return text if zero == ord("0") else "".join(chr(zero + int(c)) if c.isdecimal() else c for c in text)


def _ymd(value: str, key: bytes, undo: bool) -> str | None:
    date = _date(*value.split("-"), key, undo)
    return date and _like(value, date.isoformat())


def _dmy(value: str, key: bytes, undo: bool) -> str | None:
    mark = "." if "." in value else "/"
    first, second, year = value.split(mark)
    # Day first with points. With slashes month first; what has no such month is day first and stays a date like that.
    swapped = mark == "/" and int(first) > 12
    day_first = mark == "." or swapped
    date = _date(year, *((second, first) if day_first else (first, second)), key, undo, 13 if swapped else 1)
    if date is None:
        return None
    one, two = (date.day, date.month) if day_first else (date.month, date.day)
    return _like(value, f"{one:02d}{mark}{two:02d}{mark}{date.year:04d}")


def _ip(value: str, key: bytes, undo: bool) -> str | None:
    parts = value.split(".")
    if any(int(part) > 255 or (len(part) > 1 and int(part[0]) == 0) for part in parts):
        return None
    number = int.from_bytes(bytes(map(int, parts)), "big")
    return _like(value, ".".join(map(str, permute(number, 1 << 32, key, "ip", undo).to_bytes(4, "big"))))


def _phone(value: str, key: bytes, undo: bool) -> str | None:
    country, rest = re.fullmatch(r"(\+\d{1,3}(?=[ .(-]))?(.*)", value, re.DOTALL).groups()
    digits = "".join(filter(str.isdigit, rest))
    if not 7 <= len(digits) <= (14 if country else 15):
        return None
    return (country or "") + _fill(rest, _letters(digits, key, "phone" + (country or ""), undo))


def _ssn(value: str, key: bytes, undo: bool) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    # Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
    place = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    place, serial = divmod(permute(place, 898 * 99 * 9999, key, "ssn", undo), 9999)
    area, group = divmod(place, 99)
    return _like(value, f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}")


def _email(value: str, key: bytes, undo: bool) -> str | None:
    name, _, host = value.rpartition("@")
    labels, _, top = host.rpartition(".")
    if not all(letter.isalpha() or unicodedata.category(letter)[0] in "MC" for letter in top):
        return None
    if not any(map(_alphabet, name + labels)):
        return None
    return _letters(f"{name}@{labels}", key, "email", undo) + "." + top


def _one_case(value: str) -> bool:
    return value in (value.lower(), value.upper())


def _secret(value: str, key: bytes, undo: bool) -> str:
    if _one_case(value):
        other = f"{permute(int(value, 16), 16 ** len(value), key, 'secret', undo):0{len(value)}x}"
        return other.upper() if value == value.upper() else other
    # Both cases in one value: each digit is one of 22, and what would have one case only is permuted again.
    size = len(HEX_OF_BOTH_CASES)
    number = functools.reduce(lambda n, digit: n * size + HEX_OF_BOTH_CASES.index(digit), value, 0)
    while True:
        number = rest = permute(number, size ** len(value), key, "secret of both cases", undo)
        digits = []
        for _ in value:
            rest, place = divmod(rest, size)
            digits.append(HEX_OF_BOTH_CASES[place])
        other = "".join(reversed(digits))
        if not _one_case(other):
            return other


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email,
    "secret": _secret,
    "iban": _iban,
    "ymd": _ymd,
    "ip": _ip,
    "dmy": _dmy,
    "phone": _phone,
    "ssn": _ssn,
    "card": _card,
}


@functools.lru_cache(maxsize=20_000)
def pseudonym(kind: str, value: str, key: bytes, undo: bool = False) -> str | None:
    """The pseudonym of a value, or the value of a pseudonym with ``undo``; None where validation fails."""
    return KINDS[kind](value, key, undo)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that may hold values: words with a digit or an at sign and what follows them."""
    found: list[tuple[int, int]] = []
    for word in _SIGN.finditer(text):
        begin, end = word.span()
        if found and begin < found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], end + REACH))
            continue
        # Back to the start of the word.
        while begin and not text[begin - 1].isspace():
            begin -= 1
        found.append((begin, end + REACH))
    return found


def replace(text: str, key: bytes) -> tuple[str, int]:
    """The text with pseudonyms, and how many values were replaced."""
    out, at, count = [], 0, 0
    for begin, end in _stretches(text):
        while end < len(text) and not text[end].isspace():
            end += 1
        begin = max(at, begin)
        while found := _PATTERN.search(text, begin, end):
            kind = next(kind for kind in KINDS if found[kind] is not None)
            # What fails validation may still begin with a value.
            begin = found.start() + 1
            for value in _ibans(found[kind]) if kind == "iban" else [found[kind]]:
                other = pseudonym(kind, value, key)
                if other is not None:
                    out += [text[at : found.start()], other]
                    begin = at = found.start() + len(value)
                    count += 1
                    break
    return ("".join(out) + text[at:], count) if count else (text, 0)


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Replace personal values in every whole text by pseudonyms of the same format; add ``n_values``.

    Found: e-mail addresses, phone numbers, payment cards (Luhn), IBANs (modulo 97), social security numbers, IPv4
    addresses, dates with or without a time behind them (year-month-day; day.month.year; month/day/year, or
    day/month/year where that is none; 1900 to 2099) and keys of 32 to 64 hexadecimal digits in lower, upper or both
    cases; digits of other scripts count like ASCII ones and stay in their script. What fails its validation stays as it
    is; so do all other characters. ``key`` has 16 to 64 bytes. A null text stays null with 0 values. Rows and other
    columns stay.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("a key has 16 to 64 bytes")
    bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<text string, n bigint>")
    def masked(texts: pa.Array) -> pa.Array:
        rows = [(None, 0) if text is None else replace(text, key) for text in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([text for text, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["text", "n"]
        )

    # Every pattern holds an at sign or a digit of any script; other texts stay in the JVM. What its Unicode version does
    # not know yet may be a digit.
    seen = F.when(F.col(text_col).rlike(r"[\p{Nd}\p{Cn}@]"), F.col(text_col))
    found = docs.withColumn("__llm_masked", masked(seen))
    return found.withColumns(
        {
            text_col: F.coalesce("__llm_masked.text", F.col(text_col)),
            "n_values": F.coalesce("__llm_masked.n", F.lit(0)).cast("bigint"),
        }
    ).drop("__llm_masked")
