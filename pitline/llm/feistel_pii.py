"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

A value that passes its kind's validation becomes a number in that kind's domain, is permuted there under a key, and is
written back in the format it had. The permutation depends on the key, the kind and the domain alone, so equal values get
equal pseudonyms in all documents, however they are punctuated, without any table of values.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import batch_of
from pitline.session import read_table

ROUNDS = 8
KEY = b"a key of the user's own"
KINDS = ("card", "phone", "email", "ip", "date", "iban", "ssn")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1

#: Characters of an e-mail address's local part that are permuted together; more than the 64 of a deliverable one.
PIECE = 256

LATIN = "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", LATIN)


# ---- permutations ----


def _round(key: bytes, tag: bytes, number: int, half: int, bits: int) -> int:
    size = (half.bit_length() + 7) // 8 or 1
    want = (bits + 7) // 8
    out = b""
    while len(out) < want:
        out += hashlib.blake2b(tag + bytes([number, len(out) % 251]) + half.to_bytes(size, "little"), key=key[:64], digest_size=64).digest()
    return int.from_bytes(out[:want], "little") & ((1 << bits) - 1)


def permute(value: int, domain: int, kind: str, key: bytes = KEY, back: bool = False) -> int:
    """A keyed bijection of range(domain): a balanced Feistel network over the next even number of bits, walked until it
    comes back into the domain (fewer than four steps on average)."""
    if domain < 2:
        return value
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    tag = f"{kind}:{domain}:".encode()
    while True:
        a, b = value >> half, value & low
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ _round(key, tag, r, a, half), a
            else:
                a, b = b, a ^ _round(key, tag, r, b, half)
        value = a << half | b
        if value < domain:
            return value


def _digits(text: str, new: str) -> str:
    """``text`` with its digits replaced in order; everything between them stays."""
    it = iter(new)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


# ---- kinds: each takes the matched text and gives its pseudonym, or None if it isn't valid ----


def luhn_sum(digits: str) -> int:
    back = [int(c) for c in reversed(digits)]
    return sum(back[0::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = only_digits(text)
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10 or not digits.strip("0"):
        return None
    size = len(digits) - 1
    payload = str(permute(int(digits[:-1]), 10**size, "card", key, back)).zfill(size)
    return _digits(text, payload + str(-luhn_sum(payload + "0") % 10))


def phone(text: str, key: bytes, back: bool) -> str | None:
    """North American numbers stay valid ones; of others the country code's first digits stay."""
    digits = only_digits(text)
    lead = text.lstrip("(").startswith("+")
    if len(digits) == 11 and digits[0] == "1" or len(digits) == 10 and not lead:
        head, own = digits[:-10], digits[-10:]
        if own[0] < "2" or own[3] < "2":
            return None
        number = ((int(own[0]) - 2) * 100 + int(own[1:3])) * 800 + (int(own[3]) - 2) * 100 + int(own[4:6])
        mixed = permute(number * 10_000 + int(own[6:]), 800 * 800 * 10_000, "phone", key, back)
        number, line = divmod(mixed, 10_000)
        area, exchange = divmod(number, 800)
        return _digits(text, f"{head}{area + 200:03d}{exchange + 200:03d}{line:04d}")
    if lead and 8 <= len(digits) <= 15 and digits[0] not in "01":
        size = len(digits) - 2
        return _digits(text, digits[:2] + str(permute(int(digits[2:]), 10**size, "phone", key, back)).zfill(size))
    return None


def email(text: str, key: bytes, back: bool) -> str | None:
    """The part before the @; letters and digits stay letters and digits, and upper case stays where it was. A part of over
    ``PIECE`` characters is permuted piece by piece, which keeps the numbers small."""
    local, _, host = text.rpartition("@")
    return "".join(_mixed(local[k : k + PIECE], key, back) for k in range(0, len(local), PIECE)) + "@" + host


def _mixed(local: str, key: bytes, back: bool) -> str:
    value, domain, places = 0, 1, []
    for at, c in enumerate(local):
        for alphabet in ALPHABETS:
            if c.lower() in alphabet:
                value, domain = value * len(alphabet) + alphabet.index(c.lower()), domain * len(alphabet)
                places.append((at, alphabet))
    value = permute(value, domain, "email", key, back)
    out = list(local)
    for at, alphabet in reversed(places):
        value, d = divmod(value, len(alphabet))
        out[at] = alphabet[d].upper() if local[at].isupper() else alphabet[d]
    return "".join(out)


def ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    mixed = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", key, back)
    return ".".join(map(str, mixed.to_bytes(4, "big")))


def date(text: str, key: bytes, back: bool) -> str | None:
    """Year-month-day with dashes; day and month with dots or slashes, the other way round if only that is a date."""
    parts = re.split(r"[-./]", text)
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)) if "/" in text else ((2, 1, 0),)
    for order in orders:
        try:
            day = datetime.date(*(int(parts[k]) for k in order))
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = FIRST_DAY + datetime.timedelta(permute((day - FIRST_DAY).days, DAYS, "date", key, back))
        out = dict(zip(order, (new.year, new.month, new.day), strict=True))
        mark = text[len(parts[0])]
        return mark.join(str(out[k]).zfill(2 if len(parts[k]) == 2 or parts[k][0] == "0" else 1) for k in range(3))
    return None


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban(text: str, key: bytes, back: bool) -> str | None:
    """Country and length stay; account digits are permuted, letters stay, and the check digits are made anew."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    account = only_digits(plain[4:])
    new = _digits(plain[4:], str(permute(int(account or "0"), 10 ** len(account), "iban", key, back)).zfill(len(account)))
    check = 98 - _mod97(plain[:2] + "00" + new)
    it = iter(f"{plain[:2]}{check:02d}{new}")
    return "".join(c if c == " " else next(it) for c in text)


def ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    mixed = permute((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn", key, back)
    rest, serial = divmod(mixed, 9999)
    place, group = divmod(rest, 99)
    return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
PSEUDONYMS: dict[str, Callable[[str, bytes, bool], str | None]] = {"card": card, "phone": phone, "email": email, "ip": ip, "date": date, "iban": iban, "ssn": ssn}

#: Alternatives in order of preference at the same place.
NUMBERS = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,5})){2,6}|(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}"
    r"|(?:1 )?\([0-9]{3}\) ?[0-9]{3} [0-9]{4}|(?<![0-9] )(?:1 )?[0-9]{3} [0-9]{3} [0-9]{4}(?! [0-9])|[2-9][0-9]{9}(?![A-Za-z]))(?![0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<wide>[ -])[0-9]{6}(?P=wide)[0-9]{5}|[0-9]{13,19})(?![0-9]))"
)
DIGITS = re.compile(r"[0-9][0-9 .()/+-]*")
NOT_LOCAL = re.compile(r"[^\w.%+'-]")
DATE_BEHIND = re.compile(r"(?<= )(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])")
#: What makes ten digits without separators a telephone number.
PHONE_WORD = re.compile(r"\b(?:tel|telephone|phone|mobile|cell|call|fax|ph|text|sms|whatsapp)(?: (?:no|number|us|me|at|on|is))*[.:# ]{0,3}\Z", re.I)
HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+")
#: Characters before and after a run of digits that can belong to the value.
BEFORE, AFTER = 6, 40


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, merged; all numbers lie inside, so that long texts aren't searched letter by letter."""
    out: list[tuple[int, int]] = []
    for m in DIGITS.finditer(text):
        a, b = max(0, m.start() - BEFORE), min(len(text), m.end() + AFTER)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _local_start(text: str, low: int, at: int) -> int:
    """Where the local part that ends at ``at`` begins; stretches between two @ are looked at a fixed number of times."""
    width = 64
    while True:
        a = max(low, at - width)
        ends = [m.end() for m in NOT_LOCAL.finditer(text, a, at)]
        if ends or a == low:
            return ends[-1] if ends else a
        width *= 4


def _ends(kind: str, text: str, start: int, end: int) -> Iterator[int]:
    """Ends to try for a match, best first. What follows a number can look like more of it: an IBAN ends at its country's
    length, a telephone number before a date, and either at an earlier separator if it isn't valid as a whole."""
    if kind == "iban":
        place, left = start, IBAN_LENGTHS.get(text[start : start + 2], 0)
        while left and place < end:
            left -= text[place] != " "
            place += 1
        if not left and start < place < end and text[place] == " ":
            yield place
    if kind == "phone" and text[start] in "+(" and (m := DATE_BEHIND.search(text, start, min(len(text), end + AFTER))) and m.start() < end:
        yield m.start() - 1
    yield end
    if kind == "iban" or kind == "phone" and text[start] == "+":
        for at in range(end - 1, start, -1):
            if text[at] in " .-" and text[at - 1] not in " .-":
                yield at


def _value(kind: str, text: str, start: int, end: int, key: bytes, back: bool) -> tuple[int, str] | None:
    """End and pseudonym of the value that begins at ``start``, if one does."""
    if kind == "phone" and text[start:end].isdigit() and not PHONE_WORD.search(text[max(0, start - 32) : start]):
        return None
    for at in _ends(kind, text, start, end):
        new = PSEUDONYMS[kind](text[start:at], key, back)
        if new is not None:
            return at, new
    return None


def found_values(text: str, key: bytes = KEY, back: bool = False) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, pseudonym`` of the valid values, in order and not overlapping."""
    values = []
    low, at = 0, text.find("@")
    while at >= 0:
        left, right = _local_start(text, low, at), HOST.match(text, at + 1)
        if left < at and right:
            values.append((left, right.end(), "email", email(text[left : right.end()], key, back)))
        low, at = at + 1, text.find("@", at + 1)
    mails, mail_ends = list(values), [e for _, e, _, _ in values]
    for a, b in _windows(text):
        at = a
        while m := NUMBERS.search(text, at, b):
            kind = m.lastgroup if m.lastgroup in PSEUDONYMS else "card"
            found = _value(kind, text, m.start(), m.end(), key, back)
            if found is None:
                at = m.start() + 1
            else:
                at, new = found
                k = bisect.bisect_left(mail_ends, m.start() + 1)
                if k == len(mails) or mails[k][0] >= at:
                    values.append((m.start(), at, kind, new))
    return sorted(values)


def pseudonymised(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, Counter]:
    values = found_values(text, key, back)
    out, at = [], 0
    for start, end, _, new in values:
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join(out) + text[at:], Counter(kind for _, _, kind, _ in values)


def _replace(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.get_field_index("text")
        done = [(None, {}) if t is None else pseudonymised(t, key) for t in batch.column(place).to_pylist()]
        schema = pa.schema([*batch.schema, *(pa.field(f"n_{k}", pa.int64()) for k in KINDS)])
        columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema)} | {"text": [t for t, _ in done]}
        yield batch_of(schema, **columns, **{f"n_{k}": [c.get(k, 0) for _, c in done] for k in KINDS})


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``doc_id, text`` of every row of ``docs`` with valid personal values replaced, and how many of each kind.

    Valid are payment card numbers (13 to 19 digits, Luhn), North American and international telephone numbers, e-mail
    addresses, IPv4 addresses, calendar dates of 1900 to 2099, IBANs (mod 97) and US social security numbers. Whatever
    isn't valid stays; ten bare digits are a telephone number only behind a word that says so. Values keep length, punctuation and validity. Where two kinds overlap, an e-mail address wins, then
    the first in the order of NUMBERS. A value of a tiny domain can stay the same, with chance 1 in the domain's size.
    A null text stays null with zero counts; every row gives a row, repeated ones too; an empty table gives none. Other
    columns are not looked at. One pass over the rows without a shuffle; no values are gathered anywhere.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lambda it: _replace(it, key), f"doc_id {kinds['doc_id']}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with pseudonyms in place of personal data."""
    return pseudonymise(read_table(spark, sf_dir, "documents"))
