"""Personal data under format-preserving Feistel pseudonyms."""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.llm.batches import slices

ROUNDS = 8
SLICE_BYTES = 2 << 20
_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())

# Punctuation before an address is passed over with its run, so that long runs are read once.
_EMAIL = re.compile(r"(?<![\w.+-])[._+-]*([A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?![A-Za-z0-9])", re.A)
_NUMBER = re.compile(
    r"""(?<![\w@])(?:
      (?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    | (?P<ip>(?<!\.)(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))
    | (?P<date>(?<![/.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!(?!T\d\d:)[\w/-]|\.\d))
    | (?P<ssn>(?<!-)\d{3}-\d{2}-\d{4}(?![\w-]))
    | (?P<card>\d{4}([ -])\d{4}\6\d{4}\6\d{1,7}(?!\w)|\d{4}[ -]\d{6}[ -]\d{5}(?!\w)|\d{13,19}(?!\w))
    | (?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)
        |\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])
        |(?:1[ ])?[2-9]\d{2}[ ][2-9]\d{2}[ ]\d{4}(?![\w-])|(?<!\d[./-])0[1-9](?:[ .-]\d{2}){4}(?![\w-])
        |(?<!\d[./-])0[1-9]\d{0,4}[ /-]\d{3,8}(?:[ -]\d{2,8}){0,3}(?![\w-]))
    )""",
    re.X | re.A,
)

# Characters of an IBAN by country.
_IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


# Country codes of one and of two digits; all others have three.
_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def permute(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. n - 1: a Feistel network over two parts, walked until inside.

    ``back`` gives its inverse.
    """
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    wide = (n.bit_length() + 7) // 8 + 8
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            half = right if i % 2 == 0 else left
            digest = hashlib.blake2b(f"{tweak}|{n}|{i}|{half}".encode(), key=key, digest_size=min(64, wide)).digest()
            shift = -int.from_bytes(digest, "big") if back else int.from_bytes(digest, "big")
            if i % 2 == 0:
                left = (left + shift) % a
            else:
                right = (right + shift) % b
        x = left * b + right
        if x < n:
            return x


_KINDS = ((re.compile("[0-9]"), "0123456789"), (re.compile("[a-z]"), "abcdefghijklmnopqrstuvwxyz"), (re.compile("[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def permute_text(value: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Permute ASCII digits among digits and letters among letters of their case; the rest stays."""
    sets = [next((letters for pattern, letters in _KINDS if pattern.match(c)), c) for c in value]
    x, n = 0, 1
    for c, letters in zip(value, sets):
        x, n = x * len(letters) + letters.index(c), n * len(letters)
    x = permute(x, n, key, f"{tweak}:{[len(s) for s in sets]}", back)
    out = []
    for letters in reversed(sets):
        x, k = divmod(x, len(letters))
        out.append(letters[k])
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _put(digits: str, shape: str) -> str:
    """``digits`` in the places of the digits and letters of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _date_parts(value: str) -> tuple[list[int], list[int], str] | None:
    """Numbers of a date, the order of (year, month, day) among them, and its separator."""
    sep = next(c for c in value if not c.isdigit())
    parts = [int(p) for p in value.split(sep)] if value.count(sep) == 2 else []
    if len(parts) != 3:
        return None
    orders = [[0, 1, 2]] if len(value.split(sep)[0]) == 4 else ([[2, 1, 0], [2, 0, 1]] if sep == "." else [[2, 0, 1], [2, 1, 0]])
    for order in orders:
        try:
            day = datetime.date(*(parts[k] for k in order)).toordinal()
        except ValueError:
            continue
        if _DAYS[0] <= day <= _DAYS[1]:
            return parts, order, sep
    return None


def _dated(day: int, order: list[int], widths: list[int], sep: str) -> str:
    new, out = datetime.date.fromordinal(day), [""] * 3
    for k, number in zip(order, (new.year, new.month, new.day)):
        out[k] = str(number).zfill(widths[k])
    return sep.join(out)


def _phone_parts(value: str) -> tuple[str, str]:
    """What a phone number keeps, its country code or leading noughts, and the digits after it."""
    digits = "".join(c for c in value if c.isdigit())
    if value[0] == "+":
        n = next((n for n in (1, 2) if digits[:n] in _CODES), 3)
        given = re.match(r"\+(\d{1,3})[ .(-]", value)  # a code set apart is taken as it is
        n = len(given[1]) if given else n
    elif re.match(r"1[ ]", value):
        n = 1
    else:
        n = len(digits) - len(digits.lstrip("0"))
    return digits[:n], digits[n:]


def _phone_kind(rest: str) -> int:
    """Numbers of one kind stay among themselves: ten digits as in North America, others by a nought in front."""
    if len(rest) == 10 and rest[0] in "23456789" and rest[3] in "23456789":
        return 2
    return int(rest[:1] != "0")


@functools.lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, of the same kind and format, or None if the value is not valid.

    Equal values of a kind get equal pseudonyms whatever their separators, different values
    different ones; check digits are valid again. Where some results would be no value of
    the format, the permutation is walked on until one is, so it is one-to-one among those that
    are: dates are read in the order of the old one, social security numbers are
    valid, and phone numbers keep their country code, leading noughts and kind. ``back``
    gives the value of a pseudonym.
    """
    if kind == "email":
        name, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return permute_text(f"{name}@{host}", key, kind, back) + "." + top
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, kind, back)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        found = _date_parts(value)
        if not found:
            return None
        parts, order, sep = found
        widths = [len(p) for p in value.split(sep)]
        day = datetime.date(*(parts[k] for k in order)).toordinal()
        while True:
            day = _DAYS[0] + permute(day - _DAYS[0], _DAYS[1] - _DAYS[0] + 1, key, kind, back)
            new = _dated(day, order, widths, sep)
            if _date_parts(new)[1] == order:
                return new
    bare = "".join(c for c in value if c.isalnum())
    if kind == "card":
        if len(set(bare)) == 1 or _luhn(bare[:-1]) != int(bare[-1]):
            return None
        n = len(bare) - 1
        payload = bare[:-1]
        while True:
            payload = str(permute(int(payload), 10**n, key, f"{kind}{n}", back)).zfill(n)
            if len(set(whole := payload + str(_luhn(payload)))) > 1:
                return _put(whole, value)
    if kind == "iban":
        if not 15 <= len(bare) <= 34 or _iban_check(bare[:2], bare[4:]) != int(bare[2:4]):
            return None
        rest = permute_text(bare[4:], key, kind, back)
        return _put(bare[:2] + str(_iban_check(bare[:2], rest)).zfill(2) + rest, value)
    if kind == "ssn":
        def valid(s: str) -> bool:
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        if not valid(bare):
            return None
        x = bare
        while True:
            x = str(permute(int(x), 10**9, key, kind, back)).zfill(9)
            if valid(x):
                return _put(x, value)
    kept, rest = _phone_parts(value)
    if not 7 <= len(kept) + len(rest) <= 15 or len(rest) < 6:
        return None
    new = rest
    while True:
        new = str(permute(int(new), 10 ** len(rest), key, f"{kind}{len(rest)}", back)).zfill(len(rest))
        if _phone_kind(new) == _phone_kind(rest):
            return _put(kept + new, value)


def _ends(kind: str, value: str) -> list[int]:
    """Where a value that may have taken in what follows it can end, best first."""
    ends = [len(value)]
    if kind in ("iban", "phone"):
        ends += [i for i in range(len(value) - 1, 0, -1) if not value[i].isalnum() and value[i - 1].isalnum()]
    if kind == "iban":
        places = [i + 1 for i, c in enumerate(value) if c.isalnum()]
        n = _IBAN_LENGTHS.get(value[:2])
        ends.sort(key=lambda e: n is None or n > len(places) or e != places[n - 1])
    return ends


def cover(text: str, key: bytes) -> tuple[str, list[str]]:
    """``text`` with pseudonyms for personal data, and the kinds found, in order."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for m in _EMAIL.finditer(text):
            found.append((m.start(1), m.end(1), "email", pseudonym("email", m[1], key)))
    taken = [(a, b) for a, b, _, _ in found]
    pos = 0
    while m := _NUMBER.search(text, pos):
        kind = m.lastgroup or next(k for k, v in m.groupdict().items() if v)
        for length in _ends(kind, m[0]):
            end, new = m.start() + length, pseudonym(kind, m[0][:length], key)
            if new is not None:
                break
        inside = any(a < end and m.start() < b for a, b in taken) if taken else False
        if new is None or inside:
            # Not valid as a whole: what starts later in it may be.
            pos = m.start() + 1
            while pos < m.end() and text[pos - 1].isalnum():
                pos += 1
            continue
        found.append((m.start(), end, kind, new))
        pos = end
    if not found:
        return text, []
    out, at = [], 0
    for a, b, _, new in sorted(found):
        out += [text[at:a], new]
        at = b
    out.append(text[at:])
    return "".join(out), [k for _, _, k, _ in sorted(found)]


def cover_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, text, n_private, kinds``.

    E-mail addresses, IPv4 addresses, payment cards (Luhn), IBANs (mod 97), social security
    numbers, phone numbers and numeric dates of 1900 to 2099 are validated and replaced by
    pseudonyms of the same format under ``key``, a secret of the caller's: equal values are equal
    in all documents, and the key's holder can undo them (``pseudonym`` with ``back``). ``kinds`` names what was found, in text order. A
    text without such data is returned as it is; a null text stays null with none found.
    Repeated rows and null ids are rows like others; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, end - start)
                done = [(None, []) if t is None else cover(t, key) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(k) for _, k in done], pa.int64()), pa.array([k for _, k in done], pa.list_(pa.string()))],
                    names=["id", "text", "n_private", "kinds"],
                )

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text string, n_private bigint, kinds array<string>").withColumnRenamed("id", id_col)
