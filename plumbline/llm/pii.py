"""Pseudonyms for personal data that keep its format, by keyed Feistel permutations.

Card, phone, account and social security numbers, IP addresses, dates, mail addresses and credentials are
found by pattern and, where their kind has one, by a validity rule (Luhn, mod 97, octets, the calendar).
A valid value is numbered within the set of valid values of its kind, the number is permuted by a Feistel
network under a secret key, and the value of the permuted number takes its place: a card stays a Luhn
card of as many digits, a date a date. The same value gets the same pseudonym in every document, whatever
its separators and notation, and the key's owner can undo it: a phone number is read with its country code
(without one it is a number of +1), a date by its day, a mail address without regard to case.

Beside other digits a card or account number can be read in several ways. Of the readings of its run of groups
(card groups have three digits at least, and six at most unless a card is one group) the first counts that is valid and has the length that its issuer or
country gives it, whatever stands around. Pseudonyms keep the issuer and the country, so they are read alike,
and a value has one pseudonym in every surrounding. Only numbers of no known issuer or country are taken by the longest
reading first, and such a one between other groups is permuted on until it is found again there: it alone can differ from its pseudonym elsewhere.

Numbers that fail their rule are left alone, as is all other text. Defined results: a null text stays
null; an empty text stays empty; long texts are searched in full; repeated rows are treated alike; an
empty table gives an empty result. All other columns are returned as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.llm.common import mapped

#: Stands in for the owner's secret; pass another in production.
KEY = b"pseudonym key for tests"
ROUNDS = 8
KINDS = ("card", "phone", "ssn", "ip", "iban", "date", "email", "secret")

PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9]))"
    r"|password=(?P<word>[^\s\"'&;,<>]{4,})"
    r"|(?i:passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access|auth|private)[_-]?key)[\"']?[ \t]?[=:][ \t]?[\"']?(?P<keyed>(?=[^\s\"'&;,<>]*[0-9])(?=[^\s\"'&;,<>]*[A-Za-z])[^\s\"'&;,<>]{8,}|[0-9]{16,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![\w/-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\w])|(?<![\w+.-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])|(?<![\w+])\+[0-9](?:[ .-]?[0-9]){7,14}(?![\w]))"
    r"|(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9]))"
)
#: Hexadecimal strings with letters and digits stay such; others are permuted letter by letter.
_HEX = re.compile("(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{8,}")
_PREFIXED = re.compile("(A[KS]IA(?=[A-Z0-9]{16}$)|gh[oprsu]_(?=[A-Za-z0-9]{36}$)|sk-(?=[A-Za-z0-9]{20,}$)|xox[abprs]-(?=[A-Za-z0-9-]{10,}$))")
#: Groups of PATTERN that find credentials by what stands before them.
_KIND_OF = {"word": "secret", "keyed": "secret"}
# Country codes of two digits; 1 and 7 have one digit and all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Of kinds that stand in groups: the run of groups, how a reading starts, its least and greatest length, the least length of a group.
_RUNS = {"card": (re.compile("[0-9]+(?:[ -][0-9]+)*"), re.compile("[0-9]"), 13, 19, 3), "iban": (re.compile("[A-Z0-9]+(?: [A-Z0-9]+)*"), re.compile("[A-Z]{2}[0-9]{2}"), 15, 34, 1)}
# First digits and lengths of cards by issuer, and lengths of account numbers by country.
ISSUERS = (
    ("visa", ((4, 4),), (13, 16)),
    ("mastercard", ((51, 55), (2221, 2720)), (16,)),
    ("amex", ((34, 34), (37, 37)), (15,)),
    ("discover", ((6011, 6011), (644, 649), (65, 65)), (16,)),
    ("diners", ((300, 305), (36, 36), (38, 39)), (14,)),
    ("jcb", ((3528, 3589),), (16,)),
    ("unionpay", ((62, 62),), (16,)),
)
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: A walk to a pseudonym that is found again ends after so many steps; about one reading in ten is valid by chance.
MOST_STEPS = 1_000
_MAYBE = re.compile("[0-9@]|[AS]KIA|password=|gh[oprsu]_|sk-|xox")


def permute(number: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """The place of `number` in a keyed permutation of range(size); `back` undoes it.

    A Feistel network permutes the least square of a power of two that holds the range, and numbers
    outside are permuted again until one lies inside.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    n_bytes = (half + 7) // 8 + 1

    def mix(turn: int, right: int) -> int:
        got = b""
        while len(got) < n_bytes:
            got += hashlib.blake2b(bytes([turn, len(got) // 64]) + right.to_bytes(n_bytes, "big") + tweak, key=key[:64]).digest()
        return int.from_bytes(got[:n_bytes], "big") & mask

    while True:
        left, right = number >> half, number & mask
        if back:
            for turn in reversed(range(ROUNDS)):
                left, right = right ^ mix(turn, left), left
        else:
            for turn in range(ROUNDS):
                left, right = right, left ^ mix(turn, right)
        number = left << half | right
        if number < size:
            return number


def luhn_digit(digits: str) -> str:
    """The check digit that makes `digits` and it a valid card number."""
    total = sum(sum(divmod(int(d) * 2, 10)) if at % 2 == 0 else int(d) for at, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _by_class(value: str, key: bytes, tweak: bytes, back: bool) -> str:
    """Letters and digits permuted among strings with letters and digits in the same places."""
    alphabets = ["0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else "" for c in value]
    number, size = 0, 1
    for c, alphabet in zip(value, alphabets):
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
    number = permute(number, size, key, tweak + "".join(c if not a else a[0] for c, a in zip(value, alphabets)).encode(), back)
    out = []
    for c, alphabet in zip(reversed(value), reversed(alphabets)):
        if alphabet:
            number, at = divmod(number, len(alphabet))
            c = alphabet[at]
        out.append(c)
    return "".join(reversed(out))


def _hex(value: str, key: bytes, tweak: bytes, back: bool) -> str:
    return f"{permute(int(value, 16), 16 ** len(value), key, tweak + str(len(value)).encode(), back):0{len(value)}x}"


def _in_place(value: str, new: str) -> str:
    """`new` letters and digits with the separators of `value`."""
    left = iter(new)
    return "".join(next(left) if c.isalnum() else c for c in value)


def issuer(digits: str) -> str | None:
    """The issuer whose first digits and lengths a card number has."""
    for name, ranges, lengths in ISSUERS:
        if len(digits) in lengths and any(low <= int(digits[: len(str(low))]) <= high for low, high in ranges):
            return name
    return None


def card(value: str, key: bytes, back: bool) -> str | None:
    """Another card of the same issuer, or of none if it has none."""
    digits = re.sub("[^0-9]", "", value)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    own, body = issuer(digits), digits[:-1]
    while True:
        body = f"{permute(int(body), 10 ** len(body), key, b'card%d' % len(digits), back):0{len(body)}d}"
        new = body + luhn_digit(body)
        if issuer(new) == own and len(set(new)) > 1:
            return _in_place(value, new)


def phone(value: str, key: bytes, back: bool) -> str | None:
    """The country code stays, the national number is permuted; without a code it is one of +1."""
    digits = re.sub("[^0-9]", "", value)
    kept = 0 if value[0] != "+" else 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    code, number = digits[:kept] or "1", digits[kept:]
    new = f"{permute(int(number), 10 ** len(number), key, f'phone{code}-{len(number)}'.encode(), back):0{len(number)}d}"
    return _in_place(value, digits[:kept] + new)


def ssn(value: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, value.split("-"))
    areas = [n for n in range(1, 900) if n != 666]
    if area not in areas or not group or not serial:
        return None
    number = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, b"ssn", back)
    return f"{areas[number // (99 * 9999)]:03d}-{number // 9999 % 99 + 1:02d}-{number % 9999 + 1:04d}"


def ip(value: str, key: bytes, back: bool) -> str | None:
    octets = [int(part) for part in value.split(".")]
    if any(octet > 255 for octet in octets) or any(str(octet) != part for octet, part in zip(octets, value.split("."))):
        return None
    number = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, b"ip", back)
    return ".".join(map(str, number.to_bytes(4, "big")))


def iban(value: str, key: bytes, back: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_digits(plain[:2], plain[4:]) != plain[2:4]:
        return None
    rest = _by_class(plain[4:], key, b"iban" + plain[:2].encode(), back)
    return _in_place(value, plain[:2] + iban_digits(plain[:2], rest) + rest)


def date(value: str, key: bytes, back: bool) -> str | None:
    """A valid date of 1900 to 2099 becomes another such date in the same notation.

    Days over 12 and others are permuted among themselves, so that a month before the day is read as such again.
    """
    parts = re.split("[./-]", value)
    mark = value[4] if len(parts[0]) == 4 else value[2]
    year, month, day = parts if len(parts[0]) == 4 else parts[::-1]
    swapped = mark == "/" and int(month) > 12  # month before day
    month, day = (day, month) if swapped else (month, day)
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not first <= at <= last or len({c for c in value if not c.isdigit()}) != 1:
        return None
    number = at - first
    while True:
        number = permute(number, last - first + 1, key, b"date", back)
        new = datetime.date.fromordinal(first + number)
        if (new.day > 12) == (int(day) > 12):
            break
    if len(parts[0]) == 4:
        return new.isoformat()
    return f"{new.month:02d}{mark}{new.day:02d}{mark}{new.year}" if swapped else f"{new.day:02d}{mark}{new.month:02d}{mark}{new.year}"


def email(value: str, key: bytes, back: bool) -> str | None:
    """The part before the @ is permuted in lower case and takes its capitals again; hosts, which are no person's, stay."""
    local, _, host = value.partition("@")
    new = _by_class(local.lower(), key, b"email" + host.lower().encode(), back)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, local)) + "@" + host


def secret(value: str, key: bytes, back: bool) -> str | None:
    if known := _PREFIXED.match(value):
        return known.group() + _by_class(value[known.end() :], key, b"key" + known.group().encode(), back)
    if not re.search("[A-Za-z0-9]", value):
        return None
    is_hex = bool(_HEX.fullmatch(value))
    while True:
        value = _hex(value, key, b"hex", back) if is_hex else _by_class(value, key, b"word", back)
        if bool(_HEX.fullmatch(value)) == is_hex and not _PREFIXED.match(value):  # else it would be read as another sort
            return value


RULES: dict[str, Callable[[str, bytes, bool], str | None]] = {"card": card, "phone": phone, "ssn": ssn, "ip": ip, "iban": iban, "date": date, "email": email, "secret": secret}


def _readings(kind: str, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The readings of the run of groups at `start` that begin before `end`, by start, the longest first."""
    run, opening, least, most, group = _RUNS[kind]
    found = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", text[start : run.match(text, start, end + 2 * most).end()])]
    for first, (at, _) in enumerate(found):
        if start + at >= end:
            return
        if not opening.match(text, start + at):
            continue
        stops, size = [], 0
        for left, right in found[first:]:
            size += right - left
            if size > most or right - left < group:
                break
            after = text[start + right : start + right + 2]
            if size >= least and not re.match(r"\w|[.][0-9]", after):
                stops.append(start + right)
        for stop in reversed(stops):
            yield start + at, stop


def _known(kind: str, text: str, start: int, end: int, key: bytes, back: bool) -> tuple[int, int, str] | None:
    """The first valid reading of the length that its issuer or country gives it, and its pseudonym."""
    for at, stop in _readings(kind, text, start, start + 1 if kind == "iban" else end):
        parts = re.split("[ -]", text[at:stop])
        plain = "".join(parts)
        fits = (len(parts) == 1 or max(map(len, parts)) <= 6) and issuer(plain) is not None if kind == "card" else ACCOUNT_LENGTHS.get(plain[:2]) == len(plain)
        if fits and (new := RULES[kind](text[at:stop], key, back)) is not None:
            return at, stop, new
    return None


def _within(kind: str, text: str, start: int, end: int, key: bytes, back: bool) -> tuple[int, int, str] | None:
    """The first valid reading within a match that is not valid as a whole, and its pseudonym."""
    rule, earlier = RULES[kind], [(start, end)]
    for at, stop in _readings(kind, text, start, start + 1 if kind == "iban" else end):  # the search goes on at an iban's next group
        new = rule(text[at:stop], key, back)
        if new is None:
            earlier.append((at, stop))
            continue
        for _ in range(MOST_STEPS):  # should none be found again, the last is taken
            low, high = min(a for a, _ in earlier), max(stop, *(b for _, b in earlier))
            seen = text[low:at] + new + text[stop:high]
            if all(b <= at or rule(seen[a - low : b - low], key, back) is None for a, b in earlier):
                break
            new = rule(new, key, back)
        return at, stop, new
    return None


def replace(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """`text` with pseudonyms, and how many of each kind it now has."""
    counts = dict.fromkeys(KINDS, 0)
    if not _MAYBE.search(text):
        return text, counts

    pieces, done, at = [], 0, 0
    while match := PATTERN.search(text, at):
        kind, (start, at) = _KIND_OF.get(match.lastgroup, match.lastgroup), match.span(match.lastgroup)
        if kind in _RUNS and (part := _known(kind, text, start, at, key, back)):
            start, stop, new = part
            at = stop
        else:
            new, stop = RULES[kind](text[start:at], key, back), at
        if new is None:
            part = _within(kind, text, start, at, key, back) if kind in _RUNS else None
            if part is None:
                if kind == "iban":  # a card can stand behind what only looks like a country's code
                    at = start + re.match("[A-Z0-9]+", match.group()).end()
                continue
            start, stop, new = part
            at = stop
        counts[kind] += 1
        pieces += text[done:start], new
        done = stop
    return "".join(pieces) + text[done:], counts


def _replace_rows(batches: Iterator[pa.RecordBatch], key: bytes, back: bool, counted: bool) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        at = rows.schema.get_field_index("text")
        texts, totals = [], {kind: [] for kind in KINDS}
        for text in rows.column(at):
            new, counts = (None, dict.fromkeys(KINDS, 0)) if not text.is_valid else replace(text.as_py(), key, back)
            texts.append(new)
            for kind, total in totals.items():
                total.append(counts[kind])
        columns = [pa.array(texts, pa.string()) if i == at else column for i, column in enumerate(rows.columns)]
        found = [pa.StructArray.from_arrays([pa.array(total, pa.int32()) for total in totals.values()], list(KINDS))] if counted else []
        yield pa.RecordBatch.from_arrays([*columns, *found], [*rows.schema.names, *(["added"] if counted else [])])


def pseudonymise(documents: DataFrame, key: bytes = KEY, back: bool = False, found: str | None = "found") -> DataFrame:
    """`documents` with pseudonyms in text; a struct column `found`, in place of any of that name, counts them by kind, unless it is None."""
    kinds = StructType([StructField(kind, IntegerType()) for kind in KINDS])
    return mapped(documents.drop(found) if found else documents, lambda batches: _replace_rows(batches, key, back, bool(found)), found, kinds)


def report(documents: DataFrame, key: bytes = KEY) -> DataFrame:
    """Per document: doc_id, text with pseudonyms, n_found and the count of each kind."""
    got = pseudonymise(documents.select(F.col("doc_id").cast("long"), "text"), key, found="found")
    total = sum((F.col(f"found.{kind}") for kind in KINDS[1:]), F.col(f"found.{KINDS[0]}"))
    return got.select("doc_id", "text", total.alias("n_found"), *(F.col(f"found.{kind}").alias(f"n_{kind}") for kind in KINDS))
