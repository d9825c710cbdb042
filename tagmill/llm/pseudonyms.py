"""Format-preserving pseudonyms for numbers and dates in texts.

A value is looked for by its format, validated (check digits, calendar, ranges), turned
into a number of the format's domain, and moved by a keyed permutation of that domain: a
Feistel network over two halves, walked on until it lands inside the domain and on a valid
value again. The permutation depends on the key and the kind of value only, so equal
values get equal pseudonyms in every document, unlike values unlike ones, and whoever
holds the key can reverse it. Separators, lengths of the written parts and check digits'
validity stay as they were. What fails validation is left alone, but shorter values at its
start and values that begin inside it are looked for, as other digits or capitals may
stand right beside a value.

Rows of numbers are not values: one whose groups are apart by a sign, as in 4111 1111 1111
1111, is left alone where more than three further groups follow or precede it with the same
sign, unless these are cards too.

Kinds: payment card numbers (Luhn, an issuer's first digits, unbroken with 13 to 19 digits
or in groups of 4-4-4-4, 4-6-5 or 4-6-4 with one sign between), IBANs (mod 97), US social security
numbers (issuable ranges), phone numbers written with + and a country code, North American
ones (area and exchange from 200) and those of 10 to 12 digits with a leading 0, IPv4
addresses (four octets), dates of 1900 to 2099 (calendar), mail addresses (letters and
digits of the part before the @). A pseudonym can be the value itself, as in any
permutation, with a probability of one in the size of the domain.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .slices import in_slices

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}",
    "american": r"(?:\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-]|[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1)[0-9]{4}",
    "trunk": r"\(0[1-9][0-9]{0,4}\) ?[0-9]{2,8}(?:[ -][0-9]{2,4}){0,3}|0[1-9][0-9]{0,4}([ ./-])[0-9]{2,8}(?:\1[0-9]{2,4}){0,3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
}
KINDS = tuple(_PATTERNS)
_LABELS = {"american": "phone", "trunk": "phone"}
_OPEN, _CLOSE = r"(?<![0-9A-Za-z+@])(?<![0-9]\.)", r"(?![0-9A-Za-z@]|\.[0-9])"
_CLOSES = {"date": r"(?![0-9A-SU-Za-z@]|T(?![0-9])|\.[0-9])"}  # a time may follow
_BEGIN = re.compile(_OPEN + "(?:" + "|".join(p.replace(r"([ .-])", "[ .-]").replace(r"([ ./-])", "[ ./-]").replace(r"\1", "[ ./-]")
                                             for p in _PATTERNS.values()) + ")")
_VALUES = {k: re.compile(f"(?:{p}){_CLOSES.get(k, _CLOSE)}") for k, p in _PATTERNS.items()}
_ENDS = re.compile(_CLOSE)
_SHORT_PHONE = re.compile(_PATTERNS["phone"].replace("{2,3}", "{2}") + _CLOSE)
_SHORT_TRUNK = [re.compile(f"(?:{_PATTERNS['trunk'].replace('{0,3}', f'{{{n}}}')}){_CLOSE}") for n in (2, 1, 0)]
#: Lengths of IBANs by country.
_IBAN_LENGTHS = {c: int(n) for n, *codes in map(str.split, (
    "15 NO", "16 BE", "18 DK FI FO GL NL SD", "19 MK SI", "20 AT BA EE KZ LT LU MN XK", "21 CH HR LI LV",
    "22 BG BH CR DE GB GE IE ME RS VA", "23 AE GI IL IQ OM SO TL", "24 AD CZ ES MD PK RO SA SE SK TN VG", "25 LY PT ST",
    "26 IS TR", "27 BI DJ FR GR IT MC MR SM", "28 AL AZ BY CY DO GT HU LB NI PL SV", "29 BR EG PS QA UA", "30 JO KW MU YE",
    "31 MT SC", "32 LC", "33 RU")) for c in codes}
#: First digits of card issuers, and how cards are written.
_ISSUER = re.compile(r"3[0-9]|4|5[0-9]|6|2(?:2[2-9]|[3-6]|7[01]|720)")
_SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}
#: So many other numbers may stand in one row with a value whose groups are apart by the same sign.
STRANGERS = 3
_GROUPED = re.compile(r"[0-9]+(?:([ .-])[0-9]+)(?:\1[0-9]+)*")
_SIGN = re.compile(r"[0-9]")


def permute(value: int, size: int, key: bytes, purpose: str) -> int:
    """The keyed permutation of 0..size-1 for a purpose."""
    width = isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, width)
        for turn in range(ROUNDS):
            mark = blake2b(f"{purpose}:{turn}:{right}".encode(), key=key, digest_size=16).digest()
            left, right = right, (left + int.from_bytes(mark, "big")) % width
        value = left * width + right
        if value < size:
            return value


def _walk(value: int, size: int, key: bytes, purpose: str, valid: Callable[[int], bool]) -> int:
    value = permute(value, size, key, purpose)
    while not valid(value):
        value = permute(value, size, key, purpose)
    return value


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))


def _card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if luhn(digits) % 10 or not _ISSUER.match(digits):
        return None
    body = len(digits) - 1
    new = _walk(int(digits[:-1]), 10 ** body, key, f"card{body}", lambda n: bool(_ISSUER.match(f"{n:0{body}d}")))
    number = f"{new:0{body}d}"
    return _refill(text, number + str(-luhn(number + "0") % 10))


def _mod97(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _symbols(text: str, key: bytes, purpose: str) -> str:
    """Digits to digits and letters to letters of the same case, in place."""
    sizes = [10 if c in "0123456789" else 26 for c in text]
    value = 0
    for c, size in zip(text, sizes):
        value = value * size + (int(c) if size == 10 else ord(c.lower()) - 97)
    total = 1
    for size in sizes:
        total *= size
    shape = "".join("9" if size == 10 else "a" for size in sizes)
    value, out = permute(value, total, key, f"{purpose}:{shape}"), []
    for c, size in zip(reversed(text), reversed(sizes)):
        value, rest = divmod(value, size)
        out.append(str(rest) if size == 10 else chr(rest + (65 if c.isupper() else 97)))
    return "".join(reversed(out))


def _iban(text: str, key: bytes) -> str | None:
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34 or _mod97(compact) != 1:
        return None
    body = _symbols(compact[4:], key, f"iban:{compact[:2]}")
    new = iter(f"{compact[:2]}{98 - _mod97(compact[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _ssn(text: str, key: bytes) -> str | None:
    def valid(n: int) -> bool:
        area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0
    value = int(_digits(text))
    return _refill(text, f"{_walk(value, 10**9, key, 'ssn', valid):09d}") if valid(value) else None


def _phone(text: str, key: bytes) -> str | None:
    country = re.match(r"\+[0-9]{1,3}", text).group()
    digits = _digits(text[len(country):])
    if not 7 <= len(digits) <= 15 - len(country) + 1:
        return None
    new = permute(int(digits), 10 ** len(digits), key, f"phone{country}:{len(digits)}")
    return country + _refill(text[len(country):], f"{new:0{len(digits)}d}")


def _american(text: str, key: bytes) -> str | None:
    valid = lambda n: n // 10**9 > 1 and n // 10**6 % 10 > 1
    return _refill(text, str(_walk(int(_digits(text)), 10**10, key, "american", valid)))


def _trunk(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if not 10 <= len(digits) <= 12:
        return None
    size = 10 ** (len(digits) - 1)
    new = _walk(int(digits), size, key, f"trunk{len(digits)}", lambda n: n >= size // 10)
    return _refill(text, f"0{new}")


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(p) for p in text.split(".")]
    if max(octets) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip").to_bytes(4, "big")))


def _day(year: str, month: str, day: str) -> int | None:
    try:
        value = date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    return value - FIRST_DAY if FIRST_DAY <= value <= LAST_DAY else None


def _date(text: str, key: bytes) -> str | None:
    """Day first where that is a date; month first else, and then with a day over 12 again."""
    span = LAST_DAY - FIRST_DAY + 1
    at = lambda n: date.fromordinal(n + FIRST_DAY)
    if text[4] == "-":
        value = _day(text[:4], text[5:7], text[8:])
        return None if value is None else at(permute(value, span, key, "date")).isoformat()
    sign, (a, b, year) = text[2], (text[:2], text[3:5], text[6:])
    if (value := _day(year, b, a)) is not None:
        new = at(permute(value, span, key, "date"))
        return f"{new.day:02d}{sign}{new.month:02d}{sign}{new.year:04d}"
    if (value := _day(year, a, b)) is None:
        return None
    new = at(_walk(value, span, key, "date", lambda n: at(n).day > 12))
    return f"{new.month:02d}{sign}{new.day:02d}{sign}{new.year:04d}"


def _email(text: str, key: bytes) -> str | None:
    name, domain = text.split("@")
    plain = "".join(c for c in name if c.isalnum())
    new = iter(_symbols(plain, key, f"mail:{domain.lower()}"))
    return "".join(next(new) if c.isalnum() else c for c in name) + "@" + domain


_MAKE: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "american": _american, "trunk": _trunk,
    "card": _card}


@lru_cache(maxsize=20_000)
def _pseudonym(kind: str, value: str, key: bytes) -> str | None:
    return _MAKE[kind](value, key)


@lru_cache(maxsize=64)
def _iban_of(size: int) -> re.Pattern:
    full, rest = divmod(size - 4, 4)
    return re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{full}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "") + _CLOSE)


def _is_card(digits: str) -> bool:
    return bool(_ISSUER.match(digits)) and not luhn(digits) % 10


def _card_ends(text: str, start: int) -> Iterator[int]:
    """Ends of the cards that begin at a place, the longest first."""
    group, groups, digits, at, sign, found = 0, [], "", start, None, []
    while len(digits) < 19 and at < len(text) and text[at] in "0123456789":
        digits, group, at = digits + text[at], group + 1, at + 1
        if at < len(text) and text[at] in "0123456789":
            continue
        groups, group = [*groups, group], 0
        if tuple(groups) in _SHAPES and _ENDS.match(text, at) and _is_card(digits):
            found.append(at)
        if at < len(text) and text[at] in " -" and sign in (None, text[at]):
            sign, at = text[at], at + 1
    return reversed(found)


def _in_a_row(text: str, start: int, end: int, cards: bool) -> bool:
    """Whether more than ``STRANGERS`` other groups stand before or behind a value, apart by its own sign.

    Neighbours that are cards of four groups are no strangers to a card.
    """
    inside = _GROUPED.fullmatch(text, start, end)
    if not inside:
        return False
    sign, left, right = inside[1], [], []
    at = start
    while len(left) < 64 and at > 1 and text[at - 1] == sign and text[at - 2] in "0123456789":
        stop = at = at - 1
        while at and text[at - 1] in "0123456789":
            at -= 1
        left.append(text[at:stop])
    at = end
    while len(right) < 64 and at + 1 < len(text) and text[at] == sign and text[at + 1] in "0123456789":
        begin = at = at + 1
        while at < len(text) and text[at] in "0123456789":
            at += 1
        right.append(text[begin:at])
    others = 0
    for side, order in ((left, -1), (right, 1)):
        while cards and len(side) >= 4 and all(len(g) == 4 for g in side[:4]) and _is_card("".join(side[:4][::order])):
            side = side[4:]
        others += len(side)
    return others > STRANGERS


def _ends(kind: str, text: str, start: int) -> Iterator[int]:
    """Where a value of the kind may end, in the order in which they are tried."""
    if kind == "card":
        yield from _card_ends(text, start)
        return
    own = _IBAN_LENGTHS.get(text[start:start + 2]) if kind == "iban" else None
    shorter: list[re.Pattern] = {"phone": [_SHORT_PHONE], "trunk": _SHORT_TRUNK}.get(kind, [])
    if own:
        if match := _iban_of(own).match(text, start):
            yield match.end()
    elif kind == "iban":
        shorter = [_iban_of(size) for size in range(34, 14, -1)]
    for pattern in (_VALUES[kind], *shorter):
        if match := pattern.match(text, start):
            yield match.end()


def _value_at(text: str, start: int, key: bytes) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the value that begins at a place."""
    for kind in KINDS:
        for end in _ends(kind, text, start):
            if (new := _pseudonym(kind, text[start:end], key)) is not None and not _in_a_row(text, start, end, kind == "card"):
                return kind, end, new
    return None


def rewrite(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, length, kind) of each value in the given text."""
    if not text or not (_SIGN.search(text) or "@" in text):
        return text, []
    spans: list[tuple[int, int, str]] = []
    parts, done, at = [], 0, 0
    while match := _BEGIN.search(text, at):
        start = match.start()
        if (value := _value_at(text, start, key)) is None:
            at = start + 1
            continue
        kind, end, new = value
        spans.append((start, end - start, _LABELS.get(kind, kind)))
        parts += [text[done:start], new]
        done = at = end
    return "".join([*parts, text[done:]]), spans


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, plus ``pii array<struct<start, length, kind>>``.

    A column of ``docs`` named ``pii`` is replaced. Positions count characters of the given
    text. A null text stays null and has no values, as has an empty one. Rows are treated
    each on its own, at any length, so repeated rows get the same result.
    """
    kept = [f for f in docs.schema.fields if f.name != "pii"]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [rewrite(t, key) for t in batch.column("text").to_pylist()]
            columns = [pa.array([t for t, _ in found], pa.string()) if f.name == "text" else batch.column(f.name) for f in kept]
            pii = pa.array([[dict(zip(("start", "length", "kind"), s)) for s in each] for _, each in found], spans)
            yield pa.RecordBatch.from_arrays([*columns, pii], names=[*(f.name for f in kept), "pii"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(
        run, f"{fields}, pii array<struct<start:int,length:int,kind:string>>")
