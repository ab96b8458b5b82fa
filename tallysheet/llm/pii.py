"""Personal data: validated numbers, dates, addresses and keys are replaced by keyed pseudonyms of the same format."""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
import string
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallysheet.llm.common import columns, kept_by_worker

ROUNDS = 8


def feistel(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 to size - 1: a balanced Feistel network on the next even number of bits, walked until it is back in range."""
    if size < 2:
        return x
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, n = (1 << half) - 1, -(-half // 8)
    while True:
        left, right = x >> half, x & mask
        for i in range(ROUNDS):
            f = hashlib.blake2b(tweak + bytes([i]) + right.to_bytes(n, "big"), key=key, digest_size=min(64, n + 8)).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        x = left << half | right
        if x < size:
            return x


CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def same_classes(s: str, key: bytes, tweak: bytes, hex_digits: bool = False) -> str:
    """Digits, lower and upper case letters are permuted within their class; other characters stay. hex_digits: 0-9a-f is one class."""
    classes = ("0123456789abcdef", *CLASSES) if hex_digits else CLASSES
    alphabets = [next((c for c in classes if ch in c), "") for ch in s]
    out, at = list(s), 0
    while at < len(s):  # long strings in stretches, as a round gives at most 64 bytes
        size = value = 0
        end, size = at, 1
        while end < len(s) and size < 1 << 400:
            if a := alphabets[end]:
                value, size = value * len(a) + a.index(s[end]), size * len(a)
            end += 1
        value = feistel(value, size, key, tweak + at.to_bytes(4, "big"))
        for i in range(end - 1, at - 1, -1):
            if a := alphabets[i]:
                value, d = divmod(value, len(a))
                out[i] = a[d]
        at = end
    return "".join(out)


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _refill(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def card(s: str, key: bytes) -> str | None:
    """13 to 19 digits with a right check digit: all but that are permuted, and it is computed anew."""
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = str(feistel(int(d[:-1]), 10 ** (len(d) - 1), key, b"card%d" % len(d))).zfill(len(d) - 1)
    return _refill(s, body + luhn_digit(body))


def ssn(s: str, key: bytes) -> str | None:
    """Area, group and serial in their valid ranges; the result is valid again."""
    d = s.replace("-", "")
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if not ok(d):
        return None
    while True:
        d = str(feistel(int(d), 10**9, key, b"ssn")).zfill(9)
        if ok(d):
            return _refill(s, d)


def ip(s: str, key: bytes) -> str | None:
    """IPv4 with numbers up to 255."""
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = feistel(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def phone(s: str, key: bytes) -> str | None:
    """The last ten digits are permuted, whatever stands between them; a country code stays."""
    d = re.sub(r"\D", "", s)
    if not 10 <= len(d) <= 13:
        return None
    return _refill(s, d[:-10] + str(feistel(int(d[-10:]), 10**10, key, b"phone")).zfill(10))


def iban(s: str, key: bytes) -> str | None:
    """Country, then check digits by mod 97: the account is permuted and the check computed anew."""
    d = s.replace(" ", "")
    num = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(d) <= 34 or not 2 <= int(d[2:4]) <= 98 or num(d[4:] + d[:4]) % 97 != 1:
        return None
    account = same_classes(d[4:], key, b"iban" + d[:2].encode())
    new = d[:2] + str(98 - num(account + d[:2] + "00") % 97).zfill(2) + account
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in s)


FIRST_YEAR, YEARS = 1900, 200


def is_day(year: int, month: int, day: int) -> bool:
    try:
        datetime.date(year, month, day)
    except ValueError:
        return False
    return FIRST_YEAR <= year < FIRST_YEAR + YEARS


def date(s: str, key: bytes) -> str | None:
    """A day from 1900 to 2099: year first, or day and month in either order, with one or two digits each.

    All texts of one layout (order and digits) that are such a day are permuted among themselves, so that two different
    dates of a layout have different pseudonyms, and the digits and separators stay where they are.
    """
    a, sep1, b, sep2, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", s).groups()
    if sep1 != sep2:
        return None
    first = len(a) == 4
    year, x, y = (a, b, c) if first else (c, a, b)
    ok = (lambda t, x, y: is_day(t, x, y)) if first else (lambda t, x, y: is_day(t, y, x) or is_day(t, x, y))
    # Two digits are 01 to 31, one is 1 to 9.
    nx, ny = (31 if len(v) == 2 else 9 for v in (x, y))
    if not ok(int(year), int(x), int(y)):
        return None
    tweak, v = f"date{first}{nx},{ny}".encode(), ((int(year) - FIRST_YEAR) * nx + int(x) - 1) * ny + int(y) - 1
    while True:  # walked until it is a day again
        v = feistel(v, YEARS * nx * ny, key, tweak)
        t, u, w = FIRST_YEAR + v // (nx * ny), v // ny % nx + 1, v % ny + 1
        if ok(t, u, w):
            u, w = (f"{n:02d}" if size == 31 else str(n) for n, size in ((u, nx), (w, ny)))
            return sep1.join((str(t), u, w) if first else (u, w, str(t)))


def email(s: str, key: bytes) -> str | None:
    """The name before the @ and all of the domain but its last part, class by class."""
    name, _, domain = s.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{same_classes(name, key, b'mail')}@{same_classes(host, key, b'host')}.{top}"


def access_key(s: str, key: bytes) -> str | None:
    return s[:4] + same_classes(s[4:], key, b"access")


def secret(s: str, key: bytes) -> str | None:
    """Class by class; a value of hexadecimal digits stays one, and no other becomes one."""
    head, value = re.fullmatch(r"(?s)(.*?[=:]\s*[\"']?)([^\"'\s]+)", s).groups()
    is_hex = lambda v: re.fullmatch("[0-9a-f]+", v) is not None
    hex_digits = is_hex(value)
    while True:
        value = same_classes(value, key, b"secret", hex_digits)
        if is_hex(value) == hex_digits:
            return head + value


KINDS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("secret", r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)\s*[=:]\s*[\"']?[A-Za-z0-9_./+-]{8,}", secret),
    ("access_key", r"\bA[KS]IA[0-9A-Z]{16}\b", access_key),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b", iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)", ip),
    ("date", r"(?<![\d/.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)", date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)", phone),
)
PATTERN = re.compile("|".join(f"(?P<{k}>{p.replace(chr(92) + '1', '(?P=ymd)').replace(chr(92) + '2', '(?P=dmy)').replace('([-/.])', '(?P<ymd>[-/.])', 1).replace('([-/.])', '(?P<dmy>[-/.])', 1)})" for k, p, _ in KINDS))
#: Every kind has one of these; most texts have none.
HINT = re.compile(r"\d|@|[=:]\s*[\"']?[A-Za-z0-9_./+-]{8}|A[KS]IA[0-9A-Z]{16}")
REPLACE = {k: f for k, _, f in KINDS}


@lru_cache(maxsize=50_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The replacement of a value; None if it isn't valid for its kind. As in any permutation, a value may be its own image."""
    return REPLACE[kind](value, key)


#: The Spark setting that has the key.
KEY_SETTING = "spark.tallysheet.pseudonymKey"
_OWN: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key of the session's setting. Where that is unset, a random one for this application: pseudonyms are then linked across its documents, but not with those of another run."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key.encode()
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms of this run have a key of their own", stacklevel=2)
        _OWN[app] = secrets.token_bytes(32)
    return _OWN[app]


def private_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, before validation."""
    return [(m.start(), m.end(), next(k for k in REPLACE if m[k] is not None)) for m in PATTERN.finditer(text)]


def pseudonymised(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with its private values replaced, and the kind of each."""
    if HINT.search(text) is None:
        return text, []
    out, at, kinds = [], 0, []
    for start, end, kind in private_spans(text):
        if (new := pseudonym(kind, text[start:end], key)) is not None:
            out += text[at:start], new
            at = end
            kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with text_col's private values replaced, and n_private (long) and private_kinds (sorted, by comma) added.

    Card numbers (check digit), bank accounts (mod 97), social security numbers, IPv4 addresses, dates and phone numbers
    are validated; e-mail addresses, access keys and passwords or tokens are found by form. Each is permuted by a Feistel
    network keyed by key and kind, within its format and valid again. Equal values get equal pseudonyms in
    all documents, different values of a kind and format different ones. The rest of the text stays.

    Who has the key can invert this: keep it out of code (see key_of). It may have any length but 0.

    A null text stays null (n_private 0). Other columns stay as they are; columns that are named like an added one are
    replaced. Repeated rows give repeated rows. One map, no shuffle.
    """
    if not key:
        raise ValueError("a key is needed")
    key = hashlib.blake2b(key, digest_size=32).digest()
    keep = [c for c in docs.columns if c not in ("n_private", "private_kinds")]
    docs = columns(docs, *keep)
    schema, at = docs.schema, keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("pseudonyms")
        for b in batches:
            texts, counts, kinds = [], [], []
            for x in b.column(at):
                text = x.as_py()
                new, found = (None, []) if text is None else pseudonymised(text, key)
                texts.append(new)
                counts.append(len(found))
                kinds.append(",".join(sorted(set(found))))
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*keep, "n_private", "private_kinds"])

    return docs.mapInArrow(run, type(schema)([*schema.fields]).add("n_private", "long").add("private_kinds", "string"))
