"""String checks and pattern spans as column expressions.

Patterns carry ``(?U)`` so that word, space and digit classes and ``\\b`` are
Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(expression: str, ignore_case: bool = False) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + expression


def found(text: Column, expression: str) -> Column:
    """All matches of the pattern, without their places."""
    return F.regexp_extract_all(text, F.lit(expression), F.lit(0))


def between(text: Column, expression: str) -> Column:
    """What stands between the matches, one more than there are matches."""
    return F.split(text, expression, -1)


def starts(matches: Column, gaps: Column, i: Column) -> Column:
    """Place (from 0) of the ``i``-th match: the lengths of the gaps up to it and of the matches before."""
    length = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + F.length(s))
    return length(F.slice(gaps, F.lit(1), i + 1)) + length(F.slice(matches, F.lit(1), i))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def luhn_ok(text: Column) -> Column:
    d = digits(text)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def iban_ok(text: Column) -> Column:
    """15 to 34 characters without spaces whose number form leaves 1 when divided by 97."""
    s = F.upper(F.regexp_replace(text, r"(?U)\s+", ""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    number = F.aggregate(F.split(turned, ""), F.lit(""), lambda out, c: F.concat(out, F.when((c >= "A") & (c <= "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)))
    rest = F.aggregate(F.split(number, ""), F.lit(0), lambda n, c: F.when(c.rlike("^[0-9]$"), (n * 10 + c.try_cast("int")) % 97).otherwise(n))
    return F.coalesce(F.length(s).between(15, 34) & s.rlike("^[A-Z0-9]+$") & (rest == 1), F.lit(False))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(text, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda n, c: n + share(c) * F.log2(share(c)))


def date_ok(text: Column) -> Column:
    """Three numbers that make a day of 1900 to 2100, the year first or last."""
    p = F.split(text, r"(?U)[/\-.\s]")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    day = lambda y, m, d: n(y).between(1900, 2100) & F.try_to_date(F.concat_ws("-", n(y).cast("string"), F.lpad(n(m).cast("string"), 2, "0"), F.lpad(n(d).cast("string"), 2, "0")), "yyyy-MM-dd").isNotNull()
    return F.coalesce(F.size(p) == 3, F.lit(False)) & (F.coalesce(day(0, 1, 2), F.lit(False)) | F.coalesce(day(2, 1, 0), F.lit(False)) | F.coalesce(day(2, 0, 1), F.lit(False)))


def hmac64(text: Column, key: bytes) -> Column:
    """First 16 hex digits of HMAC-SHA256; null for null and empty text."""
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))
    return F.when(F.length(text) > 0, F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 16))
