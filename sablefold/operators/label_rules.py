"""Rules that look for a value beside or below a label, in one range join.

A label's line meets its own line and the lines below it within the rule's
reach in the same block.  Both sides are cut down by a pattern first, and meet
on (document, page, block, band of pixels), so a long document doesn't pair all
its labels with all its lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import y2
from ..functions.text import between, digits, found, iban_ok, luhn_ok, pattern, starts
from ..schema import HIGH, KEYS, MEDIUM
from .common import finish
from .words import STOP

BAND = 128


@dataclass(frozen=True)
class LabelRule:
    rule_id: str
    category: str
    label: str
    value: str
    reach: int
    rank: int
    keep: Callable[[Column], Column]
    once: bool  # one finding per label, else one per label and line


def _digits(n: int) -> Callable[[Column], Column]:
    return lambda v: F.length(digits(v)) >= n


# The patterns that the rules stand for.
NUMBER = pattern(r"[\d][\d\s\-]{5,19}")
RULES = {
    r.rule_id: r
    for r in (
        LabelRule("ID-003", "IDENTITY", pattern(r"\b(SSN|Social Security|National ID|NIN|Aadhaar|PAN|Tax ID|TIN|EIN)\b", True), NUMBER, 64, HIGH, _digits(6), True),
        LabelRule("ID-004", "IDENTITY", pattern(r"\bPassport(?:\s*(?:No|Number))?\b", True), pattern(r"\b(?:[A-Z][0-9]{8}|[A-Z]{2}[0-9]{7})\b"), 64, HIGH, lambda v: F.lit(True), True),
        LabelRule("ID-005", "IDENTITY", pattern(r"\b(DL|DLN|Driver|License|Licence)\b", True), pattern(r"\b[A-Z0-9]{6,14}\b"), 64, MEDIUM, lambda v: v.rlike("[A-Z]") & v.rlike("[0-9]"), False),
        LabelRule("FI-003", "FINANCIAL", pattern(r"\b(Account|A/C|Acct(?:\s*No\.?)?)\b", True), NUMBER, 96, MEDIUM, lambda v: (F.length(digits(v)) >= 6) & ~luhn_ok(v) & ~iban_ok(v), False),
        LabelRule("HE-001", "HEALTH", pattern(r"\b(MRN|Medical Record|Patient ID|Chart No)\b", True), pattern(r"\b[A-Z0-9\-]{4,16}\b"), 96, HIGH, _digits(3), False),
    )
}
PAYMENT = pattern(r"\b(?:Paid\s+to|Pay\s+to|Payee|Beneficiary|Recipient|Receiver|Sender|Sent\s+to|Transferred\s+to|Account\s+(?:Holder|Name))\b", True)
DIGIT, TWO_NAMES = r"(?U)\d", r"(^| )[A-Z][A-Za-z'\-]+ [A-Z][A-Za-z'\-]+( |$)"
NAME_WORD, PAYMENT_REACH, NAME_WORDS = r"^[A-Z][A-Za-z'\-]+$", 96, 5


def label_end(text: Column, label: str) -> Column:
    """Where the first label ends, from 0; null without one."""
    at = F.regexp_instr(text, F.lit(label))
    return F.when(at > 0, at - 1 + F.length(F.regexp_extract(text, label, 0)))


def meet(labels: DataFrame, values: DataFrame, reach: Column) -> DataFrame:
    """``labels`` (KEYS, label_line, label_box, ...) with ``values`` (line columns) on their line or within ``reach`` below."""
    below = y2(F.col("label_box"))
    span = F.sequence(F.floor(F.col("label_box.y") / BAND), F.floor((below + reach) / BAND))
    left = labels.withColumn("band", F.explode(span))
    right = values.withColumn("band", F.floor(F.col("bbox.y") / BAND))
    same = F.col("line_no") == F.col("label_line")
    near = (F.col("bbox.y") >= below) & (F.col("bbox.y") - below <= reach)
    return left.join(right, [*KEYS, "band"]).where(same | near).drop("band")


def gate(rules: list[LabelRule]) -> Column:
    """Lines that hold a label of ``rules`` or may hold a value."""
    text = F.col("line_text")
    return reduce(lambda a, b: a | b, [text.rlike(r.label) for r in rules]) | text.rlike(DIGIT)


def payment_gate() -> Column:
    return F.col("line_text").rlike(PAYMENT) | F.col("line_text").rlike(TWO_NAMES)


def label_findings(lines: DataFrame, rules: list[LabelRule]) -> DataFrame:
    """Findings of all label rules of ``rules``, through one join."""
    text = F.col("line_text")
    choose = lambda value, by: reduce(lambda rest, ir: F.when(by == ir[0], value(ir[1])).otherwise(rest), enumerate(rules), F.lit(None))
    marks = F.array(*[F.struct(F.lit(i).alias("rule"), label_end(text, r.label).alias("label_end"), F.lit(r.reach).alias("reach")) for i, r in enumerate(rules)])
    labels = lines.where(reduce(lambda a, b: a | b, [text.rlike(r.label) for r in rules]))
    labels = labels.select(*KEYS, F.col("line_no").alias("label_line"), F.col("bbox").alias("label_box"), F.explode(F.filter(marks, lambda m: m["label_end"].isNotNull())).alias("mark")).select(*KEYS, "label_line", "label_box", "mark.*")
    values = lines.where(text.rlike(DIGIT))
    pairs = meet(labels, values, F.col("reach"))
    # A search that starts behind the label still sees whether a word ends there: a stand-in that no value contains.
    own = F.col("line_no") == F.col("label_line")
    from_ = F.when(own, F.col("label_end") - 1).otherwise(F.lit(0))
    stand_in = F.when(F.substring(text, F.col("label_end"), F.lit(1)).rlike(r"(?U)\w"), "ä").otherwise("|")
    rest = F.when(own, F.concat(stand_in, F.substring(text, F.col("label_end") + 1, F.length(text)))).otherwise(text)
    rule = F.col("rule")
    found_ = pairs.select("*", from_.alias("from_"), rest.alias("rest")).select("*", choose(lambda r: found(F.col("rest"), r.value), rule).alias("_m"), choose(lambda r: between(F.col("rest"), r.value), rule).alias("_g")).where(F.size("_m") > 0)
    spans = F.transform("_m", lambda v, k: F.struct(v.alias("matched_text"), (starts(F.col("_m"), F.col("_g"), k) + F.col("from_")).alias("char_start")))
    good = F.filter(spans, lambda s: choose(lambda r: r.keep(s["matched_text"]), rule))
    rows = found_.withColumn("span", F.get(good, F.lit(0))).where("span is not null")
    hits = rows.select(*KEYS, "label_line", "rule", *[c for c in lines.columns if c not in KEYS], "span.*")
    once = choose(lambda r: F.lit(r.once), F.col("rule"))
    per_label = F.when(once, F.lit(-1)).otherwise(F.col("line_no"))
    body = F.struct("line_no", "char_start", *[c for c in lines.columns if c not in KEYS and c != "line_no"], "matched_text")
    first = hits.groupBy(*KEYS, "label_line", "rule", per_label.alias("per")).agg(F.min_by(body, F.struct("line_no", "char_start")).alias("b")).select(*KEYS, "rule", "b.*")
    keep = [c for c in lines.columns]
    return finish(first.select(*keep, "matched_text", "char_start", choose(lambda r: F.lit(r.rule_id), F.col("rule")).alias("rule_id"), choose(lambda r: F.lit(r.category), F.col("rule")).alias("category"), choose(lambda r: F.lit(r.rank), F.col("rule")).alias("rank")))


def name_run(text: Column, from_: Column, stop: list[str]) -> Column:
    """The first run of 2 to ``NAME_WORDS`` name words that start at ``from_`` or later: its words and place."""
    words = F.split(text, " ")
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.array().cast("array<string>").alias("run"), F.lit(False).alias("done"))
    listed = F.array(*map(F.lit, stop))

    def step(s: Column, w: Column) -> Column:
        nxt = s["at"] + F.length(w) + 1
        name = (s["at"] >= from_) & w.rlike(NAME_WORD) & ~F.array_contains(listed, F.lower(w))
        grown = F.concat(s["run"], F.array(w))
        state = lambda start, run, done: F.struct(nxt.alias("at"), start.alias("start"), run.alias("run"), done.alias("done"))
        fresh = state(s["start"], F.array().cast("array<string>"), F.lit(False))
        ended = state(s["start"], s["run"], F.lit(True))
        more = state(F.when(F.size(s["run"]) == 0, s["at"]).otherwise(s["start"]), grown, F.size(grown) >= NAME_WORDS)
        return F.when(s["done"], ended).when(name, more).when(F.size(s["run"]) >= 2, ended).otherwise(fresh)

    return F.aggregate(words, empty, step)


def payment_names(lines: DataFrame, stop: list[str] = STOP) -> DataFrame:
    """ID-008: the name beside or below a payment label, one per label."""
    text = F.col("line_text")
    labels = lines.select(*KEYS, F.col("line_no").alias("label_line"), F.col("bbox").alias("label_box"), label_end(text, PAYMENT).alias("label_end")).where("label_end is not null")
    values = lines.where(text.rlike(TWO_NAMES))
    pairs = meet(labels, values, F.lit(PAYMENT_REACH))
    # On the label's line, words that end within the label are no names.
    own = F.col("line_no") == F.col("label_line")
    tail = F.substring(text, F.col("label_end") + 1, F.length(text))
    inner = F.when(tail.startswith(" ") | (tail == ""), F.col("label_end")).otherwise(F.col("label_end") - F.length(F.substring_index(F.substring(text, F.lit(1), F.col("label_end")), " ", -1)))
    hits = pairs.withColumn("run", name_run(text, F.when(own, inner).otherwise(F.lit(0)), stop)).where(F.size("run.run") >= 2)
    hits = hits.select(*KEYS, "label_line", *[c for c in lines.columns if c not in KEYS], F.array_join("run.run", " ").alias("matched_text"), F.col("run.start").alias("char_start"))
    body = F.struct("line_no", "char_start", *[c for c in lines.columns if c not in KEYS and c != "line_no"], "matched_text")
    first = hits.groupBy(*KEYS, "label_line").agg(F.min_by(body, "line_no").alias("b")).select(*KEYS, "b.*")
    return finish(first.select(*lines.columns, "matched_text", "char_start", F.lit("ID-008").alias("rule_id"), F.lit("IDENTITY").alias("category"), F.lit(HIGH).alias("rank")))
