"""Rules that need neighbouring lines or words of a block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import gap, union_of, y2
from ..functions.text import between, found, pattern, starts
from ..schema import HIGH, KEYS, MEDIUM, floor_rank
from .common import finish, shaped
from .line_rules import YEAR, dates
from .words import COUNTRIES, FAMILY, GIVEN, HONORIFICS, STOP

# The patterns that the rules stand for.
BIRTH = pattern(r"\b(?:DOB|Date of Birth|D\.O\.B\.|Born)\b", True)
STREET = pattern(r"^\d{1,5}[A-Za-z]?\s+[A-Z][\w'.\-]+(\s+[A-Z][\w'.\-]+){0,3}\s+(St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Ln|Lane|Dr|Drive|Way|Ct|Court|Pl|Place|Sq|Square)\b", True)
CITY = pattern(r"^[A-Z][\w'.\- ]+,?\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?\b")
ADDRESS = pattern(r"\b(Address|Addr|Mailing)\b", True)
EXPIRY = pattern(r"\b(0[1-9]|1[0-2])[\/\-](\d{2}|\d{4})\b")
CVV, CVV_WORD = pattern(r"\b\d{3,4}\b"), pattern(r"\b(CVV|CVC|Sec(?:urity)?\s*Code)\b", True)
KEY_BEGIN, KEY_END = r"-----BEGIN (OPENSSH|RSA|DSA|EC|PGP) PRIVATE KEY-----", r"-----END (OPENSSH|RSA|DSA|EC|PGP) PRIVATE KEY-----"
TITLE, MIDDLE, PUNCTUATION = r"^[A-Z][a-zA-Z'\-]+$", r"^[A-Z]\.?$", ".,;:!?\"'()[]{}"
BIRTH_REACH, CARD_REACH = 32, 200


def birth_gate() -> Column:
    return F.col("line_text").rlike(YEAR) | F.col("line_text").rlike(BIRTH)


def _country(countries: list[str]) -> Column:
    return F.lower(F.rtrim(F.trim("line_text"), F.lit(",."))).isin(countries)


def address_gate(countries: list[str] = COUNTRIES) -> Column:
    text = F.col("line_text")
    return text.rlike(STREET) | text.rlike(CITY) | text.rlike(ADDRESS) | _country(countries)


def card_gate() -> Column:
    return F.col("line_text").rlike(EXPIRY) | F.col("line_text").rlike(CVV_WORD)


def key_gate() -> Column:
    return F.col("line_text").rlike(KEY_BEGIN) | F.col("line_text").rlike(KEY_END)


def whole_page(rule_ids: set[str]) -> Column | None:
    """Lines whose whole document the rules want, also lines that pass no gate; None if there are no such rules."""
    wanted = {"CO-003": ADDRESS, "CR-002": KEY_BEGIN}
    some = [F.col("line_text").rlike(p) for i, p in wanted.items() if i in rule_ids]
    return reduce(lambda a, b: a | b, some) if some else None


def name_gate(given: list[str] = GIVEN, family: list[str] = FAMILY) -> Column:
    return _names_listed(F.transform(F.split("line_text", " "), bare), given, family)


def _names_listed(words: Column, given: list[str], family: list[str]) -> Column:
    return F.exists(words, lambda w: w.rlike(TITLE) & F.lower(w).isin(list({*given, *family})))


def birth_dates(lines: DataFrame) -> DataFrame:
    """ID-002: dates; high where a birth word stands on the line or on one that ends up to 32 pixels above."""
    rows = dates(lines).withColumn("own", F.col("line_text").rlike(BIRTH))
    words = lines.where(F.col("line_text").rlike(BIRTH)).select(*KEYS, F.col("bbox").alias("above"))
    band = lambda y: F.floor(y / 64)
    words = words.withColumn("band", F.explode(F.sequence(band(y2(F.col("above"))), band(y2(F.col("above")) + BIRTH_REACH))))
    near = rows.select(*KEYS, "line_no", "bbox", band(F.col("bbox.y")).alias("band")).distinct().join(words, [*KEYS, "band"])
    gap_ = F.col("bbox.y") - y2(F.col("above"))
    near = near.where(gap_.between(0, BIRTH_REACH)).select(*KEYS, "line_no").distinct().withColumn("near", F.lit(True))
    rows = rows.join(near, [*KEYS, "line_no"], "left").withColumn("rank", F.when(F.col("own") | F.col("near"), HIGH).otherwise(MEDIUM))
    return finish(rows.select(*lines.columns, "matched_text", "char_start", "rank", F.lit("ID-002").alias("rule_id"), F.lit("IDENTITY").alias("category")))


def addresses(lines: DataFrame, countries: list[str] = COUNTRIES) -> DataFrame:
    """CO-003: a street line, or one below an address label, with a city or country line after it."""
    text = F.col("line_text")
    order = [*KEYS, "reading_order"]
    place = F.col("reading_order")
    next_ = lines.where(text.rlike(CITY) | _country(countries)).select(*KEYS, (place - 1).alias("reading_order"), text.alias("second"), F.col("bbox").alias("box2"), F.col("confidence").alias("conf2"))
    label = lines.where(text.rlike(ADDRESS)).select(*KEYS, (place + 1).alias("reading_order"), F.lit(True).alias("labelled"))
    street = lines.where(text.rlike(STREET)).select(*order)
    # Few lines are any of these, and the candidates are put together before the lines are read for their text.
    wanted = street.withColumn("street", F.lit(True)).join(label, order, "full").join(next_, order, "left")
    wanted = wanted.where("second is not null or (street and labelled)")
    rows = lines.join(wanted, order)
    both = F.col("second").isNotNull()
    box = F.when(both, union_of(F.array("bbox", F.coalesce("box2", "bbox")))).otherwise(F.col("bbox"))
    least = F.least("confidence", "conf2")
    rank = F.least(F.when(both, HIGH).otherwise(MEDIUM).cast("tinyint"), floor_rank(least))
    matched = F.when(both, F.concat_ws(" | ", text, "second")).otherwise(text)
    return shaped(rows.select("doc_id", "page_index", "block_id", "line_no", F.lit("CO-003").alias("rule_id"), F.lit("CONTACT").alias("category"), box.alias("bbox"), rank.alias("conf_rank"), matched.alias("matched_text"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"), F.array().cast("array<string>").alias("merged_from")))


def card_details(lines: DataFrame, cards: DataFrame) -> DataFrame:
    """FI-004: expiry dates, and codes on lines that name them, within 200 pixels of a card (``cards``: FI-001 findings)."""
    text = F.col("line_text")
    band = lambda y: F.floor(y / 256)
    near = cards.select(*KEYS, F.col("bbox").alias("card"))
    near = near.withColumn("band", F.explode(F.sequence(band(F.col("card.y") - CARD_REACH), band(y2(F.col("card")) + CARD_REACH))))
    some = lines.where(card_gate()).withColumn("band", F.explode(F.sequence(band(F.col("bbox.y")), band(y2(F.col("bbox"))))))
    keep = some.join(near, [*KEYS, "band"]).where(gap(F.col("bbox"), F.col("card")) <= CARD_REACH).select(*KEYS, "line_no").distinct()
    close = lines.where(card_gate()).join(keep, [*KEYS, "line_no"], "left_semi")
    out = None
    for p, on in ((EXPIRY, F.lit(True)), (CVV, text.rlike(CVV_WORD))):
        hit = close.where(on).select("*", found(text, p).alias("_m"), between(text, p).alias("_g"))
        rows = hit.select(*lines.columns, F.explode(F.transform("_m", lambda v, k: F.struct(v.alias("matched_text"), starts(F.col("_m"), F.col("_g"), k).alias("char_start")))).alias("s")).select(*lines.columns, "s.*")
        out = rows if out is None else out.union(rows)
    return finish(out.select("*", F.lit("FI-004").alias("rule_id"), F.lit("FINANCIAL").alias("category"), F.lit(HIGH).alias("rank")))


def key_blocks(lines: DataFrame) -> DataFrame:
    """CR-002: from a private key's first line to its last one, or to the end of the page."""
    text = F.col("line_text")
    page = ["doc_id", "page_index"]
    begin = lines.where(text.rlike(KEY_BEGIN)).select(*page, F.col("reading_order").alias("first"), "line_no", "block_id", F.regexp_extract(text, KEY_BEGIN, 1).alias("kind"))
    end = lines.where(text.rlike(KEY_END)).select(*page, F.col("reading_order").alias("end"), F.regexp_extract(text, KEY_END, 1).alias("kind"))
    spans = begin.join(end, [*page, "kind"], "left").groupBy(*page, "first", "line_no", "block_id").agg(F.min(F.when(F.col("end") >= F.col("first"), F.col("end"))).alias("end"))
    body = lines.join(spans.select(*page).distinct(), page, "left_semi")
    rows = spans.withColumnsRenamed({"line_no": "begin_line", "block_id": "begin_block"}).join(body, page).where("reading_order >= first and (end is null or reading_order <= end)")
    group = rows.groupBy(*page, "first", "end", F.col("begin_block").alias("block_id"), F.col("begin_line").alias("line_no")).agg(
        F.min("bbox.x").alias("x"), F.min("bbox.y").alias("y"), F.max(F.col("bbox.x") + F.col("bbox.w")).alias("r"), F.max(y2(F.col("bbox"))).alias("b"),
        F.min("confidence").alias("least"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "line_text"))), lambda t: t["line_text"]), "\n").alias("matched_text"),
    )
    box = F.struct("x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))
    rank = F.least(F.lit(HIGH).cast("tinyint"), floor_rank(F.col("least")))
    return shaped(group.select(*page, "block_id", "line_no", F.lit("CR-002").alias("rule_id"), F.lit("CREDENTIALS").alias("category"), box.alias("bbox"), rank.alias("conf_rank"), "matched_text", F.lit(0).alias("char_start"), F.length("matched_text").alias("char_end"), F.array().cast("array<string>").alias("merged_from")))


def bare(word: Column) -> Column:
    """A word without the punctuation around it."""
    return F.trim(word, F.lit(PUNCTUATION))


def full_names(lines: DataFrame, given: list[str] = GIVEN, family: list[str] = FAMILY, stop: list[str] = STOP) -> DataFrame:
    """ID-001: two or three capitalised words of which the first is a given name or the last a family name.

    A line's words are walked from the left: an honorific is skipped, three
    words (with an initial between) are tried before two, and what matched is
    left behind.
    """
    text = F.col("line_text")
    lists = (given, family, stop, HONORIFICS)
    # Few lines hold a capitalised listed name, and only these are walked.  Each list stands in the plan once:
    # ``_k`` holds, for each list, whether it has the words.
    rows = lines.select("*", F.split(text, " ").alias("_w")).select("*", F.transform("_w", bare).alias("_b"))
    rows = rows.where(_names_listed(F.col("_b"), given, family))
    listed = lambda names: F.transform("_b", lambda w: F.lower(w).isin(names))
    rows = rows.select("*", F.array(*[listed(names) for names in lists]).alias("_k"))
    known = lambda i, at: F.coalesce(F.get(F.col("_k")[i], at), F.lit(False))
    word = lambda i: F.coalesce(F.get("_b", i), F.lit(""))
    title = lambda i: word(i).rlike(TITLE) & ~known(2, i)
    hits = "array<struct<i:int,n:int,both:boolean>>"
    begin = F.struct(F.lit(0).alias("next"), F.array().cast(hits).alias("hits"))

    def step(s: Column, i: Column) -> Column:
        first = title(i)
        hit = lambda last: known(0, i) | known(1, last)
        three = first & word(i + 1).rlike(MIDDLE) & title(i + 2) & hit(i + 2)
        two = first & title(i + 1) & hit(i + 1)
        free = (s["next"] <= i) & ~known(3, i)
        add = lambda n, last: F.struct((i + n).alias("next"), F.concat(s["hits"], F.array(F.struct(i.alias("i"), F.lit(n).alias("n"), (known(0, i) & known(1, last)).alias("both")))).alias("hits"))
        return F.when(free & three, add(3, i + 2)).when(free & two, add(2, i + 1)).otherwise(s)

    # Only places with a capitalised word can start a name.
    places = F.filter(F.sequence(F.lit(0), F.size("_b") - 1), lambda i: F.get("_b", i).rlike(TITLE))
    walked = rows.select("*", F.aggregate(places, begin, step)["hits"].alias("_hits"))
    # Outer, so that no filter on the result moves below it and walks every line again.
    out = walked.select("*", F.explode_outer("_hits").alias("_h")).where("_h is not null")
    matched = F.array_join(F.slice("_w", F.col("_h.i") + 1, F.col("_h.n")), " ")
    start = F.length(F.array_join(F.slice("_w", F.lit(1), F.col("_h.i")), " ")) + F.when(F.col("_h.i") > 0, 1).otherwise(0)
    return finish(out.select(*lines.columns, matched.alias("matched_text"), start.alias("char_start"), F.when(F.col("_h.both"), HIGH).otherwise(MEDIUM).alias("rank"), F.lit("ID-001").alias("rule_id"), F.lit("IDENTITY").alias("category")))
