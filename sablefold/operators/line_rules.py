"""Rules that look at one line alone, all in one pass over the lines.

Each rule is a pattern with a cheap gate, a check of the match and a rank.  A
line's matches of all rules go into one array, which is exploded once, so the
lines are scanned once however many rules a policy selects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import between, date_ok, digits, entropy, found, iban_ok, luhn_ok, pattern, starts
from ..schema import HIGH, MEDIUM
from .common import finish

Check = Callable[[Column, Column, Column], Column]  # match, line, place of the match


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    category: str
    pattern: str
    gate: Callable[[Column], Column]
    keep: Check = lambda m, line, at: F.lit(True)
    rank: Check = lambda m, line, at: F.lit(HIGH)


# The patterns that the rules stand for.
EMAIL = pattern(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}\b")
PHONE = pattern(r"(?<![\d/])(?:(\+?\d{1,3})[\s\-.]?)?(?:\(?\d{3}\)?[\s\-.]?)\d{3}[\s\-.]?\d{4}(?!\d)")
NOT_PHONE = pattern(r"\b(version|v\.?\d|port|pid)\b", True)
CARD = pattern(r"(?<!\d)(?:\d[ \-]?){13,19}(?!\d)")
IBAN = pattern(r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b")
MASKED = pattern(r"(?:[\*X•·●](?:\s|[\-]){0,2}){2,}(?:\d(?:\s|[\-])?){2,}|(?:\d(?:\s|[\-])?){2,}(?:[\*X•·●](?:\s|[\-]){0,2}){2,}(?:\d(?:\s|[\-])?){2,}")
ICD10 = pattern(r"\b[A-TV-Z][0-9]{2}(?:\.[0-9A-TV-Z]{1,4})?\b")
PRESCRIPTION = pattern(r"\b(Rx|Prescription|Sig)\b.*", True)
SECRET = pattern(r"\b[A-Za-z0-9_\-]{20,}\b")
SECRET_WORD = pattern(r"token|secret|key|bearer|authorization", True)
CLOUD_KEY = pattern(r"\bAKIA[0-9A-Z]{16}\b|\bASIA[0-9A-Z]{16}\b|\bAIza[0-9A-Za-z\-_]{35}\b|\bsk-[A-Za-z0-9]{20,}\b|\bsk_live_[A-Za-z0-9]{16,}\b|\bghp_[A-Za-z0-9]{36}\b")
GPS = pattern(r"(?<![\d.])(-?(?:[1-8]?\d(?:\.\d+)?|90(?:\.0+)?))\s*(°)?\s*([NS])?\s*[, ]\s*(-?(?:1[0-7]\d(?:\.\d+)?|180(?:\.0+)?|\d{1,2}(?:\.\d+)?))\s*(°)?\s*([EW])?(?![\d.])")
DAY_FIRST = pattern(r"\b(?:0?[1-9]|[12]\d|3[01])[\/\-.\s](?:0?[1-9]|1[0-2])[\/\-.\s](?:19|20)\d{2}\b")
YEAR_FIRST = pattern(r"\b(?:19|20)\d{2}[\/\-.\s](?:0?[1-9]|1[0-2])[\/\-.\s](?:0?[1-9]|[12]\d|3[01])\b")

YEAR = r"(19|20)\p{Nd}{2}"


def _phone(m: Column, line: Column, at: Column) -> Column:
    start = F.greatest(at - 16, F.lit(0))
    around = F.substring(line, start + 1, at + F.length(m) + 16 - start)
    return ~around.rlike(NOT_PHONE) & F.length(digits(m)).between(10, 15)


def _secret(m: Column, line: Column, at: Column) -> Column:
    """Enough entropy, and neither one word of letters, nor short hex, nor a version."""
    plain = m.rlike("^[a-z]+$") | m.rlike("^[A-Z]+$") | m.rlike("^[A-Z][a-z]+$")
    short_hex = m.rlike("^[0-9A-Fa-f]+$") & (F.length(m) < 32)
    version = m.rlike(r"^[vV]?\d+([_\-.]\d+)*$")
    return ~plain & ~short_hex & ~version & (entropy(m) >= 3.5)


def _gps(m: Column, line: Column, at: Column) -> Column:
    g = lambda i: F.regexp_extract(m, GPS, i)
    marked = reduce(lambda a, b: a | b, [g(i) != "" for i in (2, 3, 5, 6)])
    return F.coalesce(g(1).try_cast("double").between(-90, 90) & g(4).try_cast("double").between(-180, 180), F.lit(False)) & marked


_digit = lambda n: lambda text: text.rlike(f"[0-9](?:[^0-9]{{0,2}}[0-9]){{{n - 1}}}") | text.rlike(r"(?U)[^\x00-\x7f]")

RULES = {
    r.rule_id: r
    for r in (
        LineRule("CO-001", "CONTACT", EMAIL, lambda t: t.contains("@")),
        LineRule("CO-002", "CONTACT", PHONE, _digit(10), _phone, lambda m, line, at: F.when(F.regexp_extract(m, PHONE, 1).startswith("+"), HIGH).otherwise(MEDIUM)),
        LineRule("FI-001", "FINANCIAL", CARD, _digit(13), lambda m, line, at: luhn_ok(m)),
        LineRule("FI-002", "FINANCIAL", IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), lambda m, line, at: iban_ok(m)),
        LineRule("FI-005", "FINANCIAL", MASKED, lambda t: t.rlike(r"[\*X•·●]") & t.rlike(r"(?U)\d")),
        LineRule("HE-002", "HEALTH", ICD10, lambda t: t.rlike("[A-TV-Z][0-9]{2}"), rank=lambda m, line, at: F.lit(MEDIUM)),
        LineRule("HE-003", "HEALTH", PRESCRIPTION, lambda t: t.rlike("(?i)rx|prescription|sig"), rank=lambda m, line, at: F.lit(MEDIUM)),
        LineRule("CR-001", "CREDENTIALS", SECRET, lambda t: t.rlike(r"[A-Za-z0-9_\-]{20}"), _secret, lambda m, line, at: F.when((entropy(m) >= 4.0) | line.rlike(SECRET_WORD), HIGH).otherwise(MEDIUM)),
        LineRule("CR-003", "CREDENTIALS", CLOUD_KEY, lambda t: t.rlike("AKIA|ASIA|AIza|sk-|sk_live_|ghp_")),
        LineRule("LO-001", "LOCATION", GPS, lambda t: t.rlike(r"(?U)\d") & t.rlike("[°NSEW]"), _gps),
    )
}


def custom_rule(category: str, expression: str, rank: int) -> LineRule:
    """CU-001 as a line rule."""
    return LineRule("CU-001", category, pattern(expression), lambda t: t.rlike(pattern(expression)), rank=lambda m, line, at: F.lit(rank))


def gate(rules: list[LineRule]) -> Column:
    """Lines that a rule may find something in."""
    return reduce(lambda a, b: a | b, [r.gate(F.col("line_text")) for r in rules])


def line_findings(lines: DataFrame, rules: list[LineRule]) -> DataFrame:
    """Findings of all ``rules`` over ``lines``, in one scan."""
    text = F.col("line_text")
    hits, gaps = (lambda i: f"_m{i}"), (lambda i: f"_g{i}")
    columns = []
    for i, r in enumerate(rules):
        gate = r.gate(text)
        columns += [F.when(gate, found(text, r.pattern)).alias(hits(i)), F.when(gate, between(text, r.pattern)).alias(gaps(i))]
    some = reduce(lambda a, b: a | b, [F.size(F.coalesce(F.col(hits(i)), F.array())) > 0 for i in range(len(rules))])
    marked = lines.select("*", *columns).where(some)
    nothing = F.array().cast("array<struct<rule:int,matched_text:string,char_start:int>>")

    def placed(i: int) -> Column:
        m, g = F.col(hits(i)), F.col(gaps(i))
        return F.coalesce(F.transform(m, lambda v, k: F.struct(F.lit(i).alias("rule"), v.alias("matched_text"), starts(m, g, k).alias("char_start"))), nothing)

    spans = [placed(i) for i in range(len(rules))]
    keep = [c for c in lines.columns]
    rows = marked.select(*keep, F.explode(F.concat(*spans)).alias("span")).select(*keep, "span.*")
    m, at = F.col("matched_text"), F.col("char_start")
    pick = lambda value: reduce(lambda rest, ir: F.when(F.col("rule") == ir[0], value(ir[1])).otherwise(rest), enumerate(rules), F.lit(None))
    rows = rows.where(pick(lambda r: r.keep(m, text, at)))
    return finish(rows.select(*keep, "matched_text", "char_start", pick(lambda r: F.lit(r.rule_id)).alias("rule_id"), pick(lambda r: F.lit(r.category)).alias("category"), pick(lambda r: r.rank(m, text, at)).alias("rank")))


def dates(lines: DataFrame) -> DataFrame:
    """Line columns with one row per valid date: matched_text, char_start."""
    text = F.col("line_text")
    out = None
    for p in (DAY_FIRST, YEAR_FIRST):
        hit = lines.where(text.rlike(YEAR)).select("*", found(text, p).alias("_m"), between(text, p).alias("_g")).where(F.size("_m") > 0)
        rows = hit.select(*lines.columns, F.explode(F.transform("_m", lambda v, k: F.struct(v.alias("matched_text"), starts(F.col("_m"), F.col("_g"), k).alias("char_start")))).alias("s")).select(*lines.columns, "s.*").where(date_ok(F.col("matched_text")))
        out = rows if out is None else out.union(rows)
    return out
