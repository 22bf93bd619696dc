"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass validation are replaced by others of the same format, chosen by a keyed permutation
of all valid values. Equal values get equal pseudonyms in every document, however they are written; without the
key nothing can be turned back.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROUNDS = 10
# The key is a parameter of every run; this one is for tests and the registered query.
KEY = b"termsieve pseudonym key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


# ---------------------------------------------------------------- keyed permutation

def _round(key: bytes, tweak: str, number: int, half: int, modulus: int) -> int:
    digest = hmac.new(key, f"{tweak}|{number}|{half}|{modulus}".encode(), hashlib.sha256).digest()
    return int.from_bytes(digest, "big") % modulus


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of 0 .. size-1: a Feistel network over a rectangle, walked until it lands inside."""
    a = math.isqrt(size - 1) + 1 if size > 1 else 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for number in range(ROUNDS):
            if number % 2:
                right = (right + _round(key, tweak, number, left, b)) % b
            else:
                left = (left + _round(key, tweak, number, right, a)) % a
        value = left * b + right
        if value < size:
            return value


# ---------------------------------------------------------------- formats

def luhn_digit(digits: str) -> str:
    """Check digit that completes `digits`."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _filled(template: str, characters: str) -> str:
    """`template` with its letters and digits replaced, in order, by `characters`."""
    rest = iter(characters)
    return "".join(next(rest) if c.isalnum() else c for c in template)


def card(found: re.Match, key: bytes) -> str | None:
    """Payment card: first digit and length stay, the check digit is set anew."""
    text = found[0]
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = f"{permute(int(d[1:-1]), 10 ** (len(d) - 2), key, f'card{d[0]}-{len(d)}'):0{len(d) - 2}d}"
    return _filled(text, d[0] + body + luhn_digit(d[0] + body))


def phone(found: re.Match, key: bytes) -> str:
    """North American number; the country code stays.

    Numbers that can be assigned, whose area and exchange start with 2 to 9, are permuted among themselves, and
    so are all others of the same writing.
    """
    text = found[0]
    d = _digits(text)
    country, d = d[:-10], d[-10:]
    if d[0] < "2" or d[3] < "2":
        return _filled(text, country + _unassigned(d, key))
    rank = (int(d[:3]) - 200) * 8_000_000 + (int(d[3:6]) - 200) * 10_000 + int(d[6:])
    rank = permute(rank, 800 * 8_000_000, key, "phone")
    area, rest = divmod(rank, 8_000_000)
    return _filled(text, f"{country}{area + 200}{rest // 10_000 + 200}{rest % 10_000:04d}")


def _unassigned(d: str, key: bytes) -> str:
    """Ten digits whose area or exchange starts with 0 or 1: first all with such an area, then the rest."""
    area, rest, low = int(d[:3]), int(d[3:]), 200 * 10_000_000
    rank = area * 10_000_000 + rest if area < 200 else low + (area - 200) * 2_000_000 + rest
    rank = permute(rank, low + 800 * 2_000_000, key, "phone-unassigned")
    if rank < low:
        return f"{rank:010d}"
    area, rest = divmod(rank - low, 2_000_000)
    return f"{area + 200}{rest:07d}"


def international(found: re.Match, key: bytes) -> str | None:
    """Other number with a country code: its first two digits stay."""
    text = found[0]
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    return _filled(text, d[:2] + f"{permute(int(d[2:]), 10 ** (len(d) - 2), key, f'phone{len(d)}'):0{len(d) - 2}d}")


def social(found: re.Match, key: bytes) -> str | None:
    """United States social security number: no group of zeros, no area 666 or above 899."""
    areas = [a for a in range(1, 900) if a != 666]
    area, group, serial = int(found[0][:3]), int(found[0][4:6]), int(found[0][7:])
    if area not in areas or not group or not serial:
        return None
    rank = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "social")
    rank, serial = divmod(rank, 9999)
    area, group = divmod(rank, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def address(found: re.Match, key: bytes) -> str | None:
    """Internet address of four numbers below 256, without leading zeros."""
    parts = found[0].split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    rank = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, rank.to_bytes(4, "big")))


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country)
    return f"{98 - int(number + '00') % 97:02d}"


def iban(found: re.Match, key: bytes) -> str | None:
    """Bank account: country, length and letters stay, the check digits are set anew."""
    plain = "".join(c for c in found[0] if c.isalnum())
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, account) != check:
        return None
    d = _digits(account)
    new = iter(f"{permute(int(d), 10 ** len(d), key, f'iban{country}{len(d)}'):0{len(d)}d}" if d else "")
    account = "".join(next(new) if c.isdigit() else c for c in account)
    return _filled(found[0], country + _iban_check(country, account) + account)


def date(found: re.Match, key: bytes) -> str | None:
    """Day between 1900 and 2099 as y-m-d, d.m.y or m/d/y; separators and zero padding stay."""
    text = found[0]
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    order = {"-": "ymd", "/": "mdy", ".": "dmy"}[mark] if len(parts[0]) < 4 else "ymd"
    value = dict(zip(order, map(int, parts), strict=True))
    try:
        day = datetime.date(value["y"], value["m"], value["d"])
    except (ValueError, KeyError):
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    days = (LAST_DAY - FIRST_DAY).days + 1
    new = FIRST_DAY + datetime.timedelta(permute((day - FIRST_DAY).days, days, key, "date"))
    padded = all(len(p) > 1 for p in parts)
    shown = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month),
             "d": f"{new.day:02d}" if padded else str(new.day)}
    return mark.join(shown[x] for x in order)


def mail(found: re.Match, key: bytes) -> str:
    """Mail address: letters and digits of the local part; its marks and the domain stay."""
    local, _, domain = found[0].partition("@")
    alphabets = [("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz") for c in local if c.isalnum()]
    low = [c for c in local.lower() if c.isalnum()]
    if not low or any(c not in a for c, a in zip(low, alphabets, strict=True)):
        return found[0]
    rank, size = 0, 1
    for c, a in zip(low, alphabets, strict=True):
        rank, size = rank * len(a) + a.index(c), size * len(a)
    shape = "".join("0" if len(a) == 10 else "a" for a in alphabets)
    rank, out = permute(rank, size, key, f"mail{shape}@{domain.lower()}"), []
    for a in reversed(alphabets):
        rank, c = divmod(rank, len(a))
        out.append(a[c])
    new = iter(reversed(out))
    return "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(new)) else c for c in local) + "@" + domain


@dataclass(frozen=True)
class Format:
    name: str
    pattern: str
    pseudonym: Callable[[re.Match, bytes], str | None]
    # A refused match is tried again without its last groups, down to so many letters and digits; 0: not at all.
    least: int = 0


# In order of preference where two start at the same place.
FORMATS = [
    Format("mail", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![\w-])", mail),
    Format("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", iban, 15),
    Format("phone", r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])", phone),
    Format("phone", r"(?<![\w+])\+1[0-9]{10}(?!\w)", phone),
    Format("phone", r"(?<![\w+])\+[2-9][0-9](?:[ ./-]?[0-9]){6,13}(?!\w)", international),
    Format("social", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", social),
    Format("date", r"(?<![\w./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-])", date),
    Format("address", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])", address),
    Format("card", r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?:(?![\w-])|(?=-[0-9]))", card, 13),
]
KINDS = sorted({f.name for f in FORMATS})
_ANY = re.compile("|".join(f"(?P<_{i}>{f.pattern})" for i, f in enumerate(FORMATS)))
_SINGLE = [re.compile(f.pattern) for f in FORMATS]
_HINT = re.compile(r"[0-9@]")
_SHORTER = re.compile(r".+")


def _accepted(i: int, text: str, start: int, key: bytes) -> tuple[str, int] | None:
    """Pseudonym and end of what format `i` takes at `start`: its whole match, else the longest shorter one that
    ends where a separator follows."""
    match = _SINGLE[i].match(text, start)
    new = FORMATS[i].pseudonym(match, key) if match else None
    if new is not None or not match or not FORMATS[i].least:
        return None if new is None else (new, match.end())
    for end in range(match.end() - 1, start, -1):
        if text[end] in " -" and sum(c.isalnum() for c in text[start:end]) >= FORMATS[i].least:
            new = FORMATS[i].pseudonym(_SHORTER.fullmatch(text, start, end), key)
            if new is not None:
                return new, end
    return None


def pseudonymized(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text, in code points.

    What one format's validation refuses is offered to the others at the same place; cards and bank accounts
    are first tried without the groups that follow them.
    """
    if not _HINT.search(text):
        return text, []
    out, spans, at, length = [], [], 0, 0
    where = 0
    while found := _ANY.search(text, where):
        start, first = found.start(), int(found.lastgroup[1:])
        where = start + 1
        for i in range(first, len(FORMATS)):
            taken = _accepted(i, text, start, key)
            if taken is None:
                continue
            new, end = taken
            out += [text[at:start], new]
            length += start - at
            spans.append((FORMATS[i].name, length, length + len(new)))
            length += len(new)
            at = where = end
            break
        else:
            # No format accepts it; a run of digits is not tried again from within.
            if text[start].isdigit():
                while where < len(text) and text[where].isdigit():
                    where += 1
    return "".join(out) + text[at:], spans


def pseudonymize(docs: DataFrame, key: bytes = KEY, spans: bool = True) -> DataFrame:
    """`docs` with `text` replaced and, with `spans`, `pii_spans` (kind, start, end in the new text) added.

    All other columns stay as they are, `n_chars` too; a column called pii_spans is replaced. Null texts stay null and have
    no spans, texts without valid personal data stay as they are, rows that repeat are treated alike, and an
    empty table stays empty.
    """
    kind = F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")

    @F.udf("struct<text:string,spans:array<struct<kind:string,start:int,end:int>>>", useArrow=True)
    def replaced(text):
        if text is None:
            return None, []
        new, found = pseudonymized(text, key)
        return new, found

    changed = docs.select(F.struct("*").alias("_doc"), replaced(F.col("text").cast("string")).alias("_new"))
    columns = [F.col("_new.text").alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns if c != "pii_spans"]
    return changed.select(*columns, *([F.coalesce("_new.spans", kind).alias("pii_spans")] if spans else []))


def op6_pii(spark, sf: str) -> DataFrame:
    """Every document's new text, how many values of each kind it holds, and their places."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = pseudonymize(docs)

    def count(kind):
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).alias(f"n_{kind}")

    places = F.array_join(F.transform("pii_spans", lambda s: F.concat_ws("-", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "text", *map(count, KINDS), places.alias("spans"))


QUERIES = {"op6_pii": op6_pii}
