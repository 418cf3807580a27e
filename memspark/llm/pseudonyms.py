"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Digits are permuted by an alternating Feistel network over the digit strings of their length. Where a value is valid
in some way (a check digit, the parts of a social security number, a date), the permutation is walked on until it is
valid in the same ways, which is a permutation of the valid values. A value is first reduced to what it means: the
national digits of a phone number without country code and trunk zero, the day of a date, the address of an e-mail
however it is written out, the given name and surname of a person in whatever order; so equal values get equal
pseudonyms in every format, and are written in the format found. Numbers and dates can be undone with the key; words
get a keyed tag of ``TAG_BYTES`` bytes, which cannot.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Callable
from datetime import date, timedelta

from memspark.llm.names import person

ROUNDS = 10
#: 80 bits: a billion different values share no tag but with a chance of about one in a million.
TAG_BYTES = 10


def _round(key: bytes, i: int, n: int, half: str, modulus: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{i}|{n}|{half}".encode(), key=key, digest_size=16).digest(), "big") % modulus


def permute(digits: str, key: bytes, inverse: bool = False) -> str:
    """A keyed permutation of the digit strings of this length (alternating Feistel network, radix 10)."""
    n = len(digits)
    if n < 2:
        return digits if not n else str((int(digits) + (-1 if inverse else 1) * _round(key, 0, 1, "", 10)) % 10)
    u, v = n // 2, n - n // 2
    a, b = digits[:u], digits[u:]
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    for i in order:
        width = u if i % 2 == 0 else v
        if inverse:
            c = (int(b) - _round(key, i, n, a, 10**width)) % 10**width
            a, b = str(c).zfill(width), a
        else:
            c = (int(a) + _round(key, i, n, b, 10**width)) % 10**width
            a, b = b, str(c).zfill(width)
    return a + b


def walk(digits: str, key: bytes, kind: Callable[[str], object], inverse: bool = False) -> str:
    """The permutation applied until the digits are of the kind they were: a permutation of each kind."""
    own = kind(digits)
    while True:
        digits = permute(digits, key, inverse)
        if kind(digits) == own:
            return digits


# ---------------------------------------------------------------- validity
def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others (ISO/IEC 7812)."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def social(digits: str) -> tuple[bool, ...]:
    """What the three parts of a nine-digit social security number must not be."""
    area, middle, last = digits[:3], digits[3:5], digits[5:]
    return area == "000", area == "666", area >= "900", middle == "00", last == "0000"


def _number_kind(digits: str) -> object:
    return luhn(digits), social(digits) if len(digits) == 9 else None


def _no_zero_first(digits: str) -> object:
    return digits[:1] == "0"


# ---------------------------------------------------------------- dates
_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
_SHORT_FIRST, _SHORT_DAYS = date(1930, 1, 1), (date(2030, 1, 1) - date(1930, 1, 1)).days


def permute_day(day: date, key: bytes, inverse: bool = False, short: bool = False) -> date:
    """A keyed permutation of the days from 1900 to 2099, or (``short``) from 1930 to 2029; other days stay."""
    first, size = (_SHORT_FIRST, _SHORT_DAYS) if short else (_FIRST, _DAYS)
    at = (day - first).days
    if not 0 <= at < size:
        return day
    return first + timedelta(int(walk(str(at).zfill(5), key, lambda x: int(x) < size, inverse)))


_DATE = re.compile(r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>\d{4})")


def date_pseudonym(value: str, key: bytes, inverse: bool = False) -> str | None:
    """A numeric date (year first, or day, month, year) permuted and written in its format; None if it is no date."""
    m = _DATE.fullmatch(value)
    if not m:
        return None
    y, mon, d = (int(m[k] or m[k + "2"]) for k in "ymd")
    try:
        new = permute_day(date(y, mon, d), key, inverse)
    except ValueError:
        return None
    two = lambda n, like: str(n).zfill(len(like)) if len(like) == 2 else str(n)
    if m["y"]:
        return f"{new.year}{m['s']}{two(new.month, m['m'])}{m['s']}{two(new.day, m['d'])}"
    return f"{two(new.day, m['d2'])}{m['s2']}{two(new.month, m['m2'])}{m['s2']}{new.year}"


def _order(value: str) -> str:
    """How an identity number that begins with six digits and a mark writes its day: year first, or last if a letter ends it."""
    return "%d%m%y" if value[-1:].isalpha() else "%y%m%d"


def _six(digits: str, order: str = "%y%m%d") -> date | None:
    """The day that six digits name, from 1930 to 2029."""
    y, m, d = (digits[:2], digits[2:4], digits[4:6]) if order == "%y%m%d" else (digits[4:6], digits[2:4], digits[:2])
    try:
        return date(int(y) + (2000 if int(y) < 30 else 1900), int(m), int(d))
    except ValueError:
        return None


# ---------------------------------------------------------------- values
def _in_format(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


#: Country codes of two digits (ITU-T E.164); 1 and 7 have one digit, all others three.
_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def national(value: str) -> tuple[int, str]:
    """How many of a phone number's digits come before its national ones, and these."""
    digits = "".join(c for c in value if c.isdigit())
    lead = 0
    bare = value.lstrip(" (")
    if bare.startswith("+") or (digits.startswith("00") and not bare.startswith("(")):
        lead = 0 if bare.startswith("+") else 2
        lead += 1 if digits[lead : lead + 1] in ("1", "7") else 2 if digits[lead : lead + 2] in _TWO else 3
        if digits[lead : lead + 1] == "0":
            lead += 1
    elif digits.startswith("0"):
        lead = 1
    elif len(digits) == 11 and digits.startswith("1"):
        lead = 1
    return lead, digits[lead:]


def phone(value: str, key: bytes, inverse: bool = False) -> str:
    lead, rest = national(value)
    digits = "".join(c for c in value if c.isdigit())
    return _in_format(value, digits[:lead] + (walk(rest, key, _no_zero_first, inverse) if rest else ""))


def _check(head: str) -> int:
    return next(c for c in range(10) if luhn(f"{head}{c}"))


def id_number(value: str, key: bytes, inverse: bool = False) -> str:
    """Letters stay; a date at the beginning stays a date; check digits and parts stay as valid as they are."""
    digits = "".join(c for c in value if c.isdigit())
    if re.match(r"\d{6}[-+A]", value) and (day := _six(digits, _order(value))):
        new = permute_day(day, key, inverse, short=True).strftime(_order(value))
        # the last digit stays as far from the check digit of the others as it is, so a valid number stays valid
        rest = permute(digits[6:-1], key, inverse)
        rest += str((_check(new + rest) + int(digits[-1]) - _check(digits[:-1])) % 10)
        return _in_format(value, new + rest)
    dated = bool(re.match(r"\d{6}[-+A]", value))
    return _in_format(value, walk(digits, key, lambda d: (_number_kind(d), dated and _six(d, _order(value)) is None), inverse) if digits else "")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def tag(kind: str, value: str, key: bytes) -> str:
    return base64.b32encode(hashlib.blake2b(f"{kind}|{value}".encode(), key=key, digest_size=TAG_BYTES).digest()).decode().lower()


_AT_SIGN, _DOT_SIGN = re.compile(r"\s*[\[({<]?\s*(?:@|\bat\b)\s*[\])}>]?\s*"), re.compile(r"\s*[\[({<]\s*(?:dot|punkt|punto|point)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+")
_ROAD = {"st": "street", "rd": "road", "ln": "lane", "dr": "drive", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "ct": "court", "pl": "place", "sq": "square", "str": "strasse"}


def email_key(value: str) -> str:
    return _DOT_SIGN.sub(".", _AT_SIGN.sub("@", value.lower(), count=1))


def name_key(value: str) -> str:
    """Given name and surname of the one reading a name has; else its words in order of the alphabet."""
    read = {(kind, given, sur) for kind, given, sur in person(value)}
    if len(read) == 1:
        return "|".join(read.pop())
    return " ".join(sorted(re.findall(r"\w+", plain(value))))


def street_key(value: str) -> str:
    words = [_ROAD.get(w, w) for w in re.findall(r"[^\W\d_]+", plain(value).replace("ß", "ss"))]
    return " ".join(re.sub(r"str$", "strasse", w) if len(w) > 5 else w for w in words if len(w) > 1)


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """Numbers and dates permuted in their format; e-mail addresses, names and street names as tags."""
    if kind == "phone":
        return phone(value, key)
    if kind == "id_number":
        return id_number(value, key)
    if kind == "date":
        return date_pseudonym(value, key) or tag(kind, value, key)
    if kind == "street_address":
        house = re.search(r"\d+", value)
        number = walk(house.group(), key, _no_zero_first) + " " if house else ""
        return number + tag(kind, street_key(value), key)
    return tag(kind, email_key(value) if kind == "email" else name_key(value), key)
