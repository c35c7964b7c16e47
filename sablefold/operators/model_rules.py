"""Rules backed by a model that a caller brings: names, entities and faces.

A model is made by a function once per task and called with lines; it returns
``(start, end, label, score)`` for each entity.  No model is part of this
package.  A model that can't be made fails the whole plan.  A failing call is a
finding of the category ``FAILED`` with the error as its text, and the rest goes
on; ``failures`` takes these apart, so that no document passes for clean because
a model never looked at it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ScanError
from ..functions.text import starts
from ..runtime import ship
from ..schema import FINDINGS, HIGH, LOW, MEDIUM
from .common import finish, shaped

Entity = tuple[int, int, str, float]
Model = Callable[[str], list[Entity]]
FAILED = "!"

# What labels mean here.
ENTITY_LABELS = {
    "person": "IDENTITY", "first name": "IDENTITY", "last name": "IDENTITY", "date of birth": "IDENTITY", "passport number": "IDENTITY", "driver license": "IDENTITY", "national id": "IDENTITY",
    "social security number": "IDENTITY", "username": "IDENTITY", "email": "CONTACT", "phone number": "CONTACT", "address": "CONTACT", "credit card": "FINANCIAL", "bank account": "FINANCIAL",
    "iban": "FINANCIAL", "medical record number": "HEALTH", "medical condition": "HEALTH", "password": "CREDENTIALS", "api key": "CREDENTIALS",
}
# What the labels of ML-002 mean, by category.
CLINICAL_LABELS = {
    name: category
    for category, names in {
        "IDENTITY": "first_name last_name middle_name full_name date_of_birth date time age ssn social_security_number passport_number driver_license national_id id_number occupation username",
        "CONTACT": "email email_address phone phone_number address street_address zip_code",
        "FINANCIAL": "credit_card credit_card_number bank_account iban cvv",
        "HEALTH": "medical_record_number mrn health_insurance_number",
        "CREDENTIALS": "api_key password secret",
        "LOCATION": "gps_coordinates city state country",
    }.items()
    for name in names.split()
}
LABELS = {"ML-001": ENTITY_LABELS, "ML-002": CLINICAL_LABELS}
IMAGE_RULES = ("ID-007",)
SHORTEST, SEPARATORS = 5, ("-", "_", ".", "")


def entities(lines: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """Line columns with one row per entity: matched_text, char_start, label, score."""
    ship(lines.sparkSession)
    key = ["doc_id", "page_index", "block_id", "line_no"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    out += [(*r[:4], r.line_text[s:e], s, label, float(score)) for s, e, label, score in model(r.line_text)]
                except Exception as error:  # one bad line doesn't end the job
                    out.append((*r[:4], f"{type(error).__name__}: {error}", 0, FAILED, 0.0))
            yield pd.DataFrame(out, columns=[*key, "matched_text", "char_start", "label", "score"])

    text = lines.where(F.trim("line_text") != "").select(*key, "line_text")
    return lines.join(text.mapInPandas(run, "doc_id long, page_index int, block_id string, line_no int, matched_text string, char_start int, label string, score double"), key)


def score_rank(score: Column) -> Column:
    return F.when(score >= 0.85, HIGH).when(score >= 0.65, MEDIUM).otherwise(LOW)


def entity_findings(lines: DataFrame, rule_id: str, make: Callable[[], Model], labels: dict[str, str] | None = None, least: float = 0.5) -> DataFrame:
    """ML-001 and ML-002: entities whose label has a category and whose score reaches ``least``, and calls that failed."""
    labels = LABELS[rule_id] if labels is None else labels
    if not 0.0 <= least <= 1.0 or not labels:
        raise ScanError("E_POLICY", f"{rule_id}: a score threshold from 0 to 1 and some labels are needed")
    category = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    found = entities(lines, make)
    rows = found.where((F.col("label") != FAILED) & (F.col("score") >= least))
    rows = rows.withColumn("category", F.try_element_at(category, F.lower("label"))).where("category is not null")
    good = finish(rows.select(*lines.columns, "matched_text", "char_start", "category", F.lit(rule_id).alias("rule_id"), score_rank(F.col("score")).alias("rank")))
    return good.unionByName(_failed_calls(found, rule_id))


def _failed_calls(found: DataFrame, rule_id: str) -> DataFrame:
    """The failed calls among ``entities``, shaped as findings."""
    own = {"rule_id": F.lit(rule_id), "category": F.lit(FAILED), "conf_rank": F.lit(LOW), "char_end": F.lit(0), "merged_from": F.array().cast("array<string>")}
    return shaped(found.where(F.col("label") == FAILED).withColumns(own))


def failures(findings: DataFrame, text_rules: int, image_rules: int = 0) -> DataFrame:
    """doc_id, fatal, message of the documents for which rules failed.

    Fatal is a document for which all of ``text_rules`` rules over text failed,
    or all of ``image_rules`` rules over pixels.
    """
    of_image = F.col("rule_id").isin(list(IMAGE_RULES))
    bad = findings.where(F.col("category") == FAILED).groupBy("doc_id", of_image.alias("of_image"), "rule_id").agg(F.min("matched_text").alias("message"))
    bad = bad.groupBy("doc_id", "of_image").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(": ", "rule_id", "message"))).alias("said"))
    all_ = F.col("n") >= F.when(F.col("of_image"), image_rules).otherwise(text_rules)
    return bad.groupBy("doc_id").agg(F.max(all_).alias("fatal"), F.array_join(F.array_sort(F.flatten(F.collect_list("said"))), "; ").alias("message"))


def variants(name: Column) -> Column:
    """Spellings of a name as a handle: its parts, the parts joined, and an initial with the last part."""
    parts = F.filter(F.split(F.lower(name), r"(?U)[\s'\-_.]+"), lambda p: p != "")
    first, last = F.substring(F.get(parts, F.lit(0)), 1, 1), F.element_at(parts, -1)
    joined = F.array(*[F.array_join(parts, s) for s in SEPARATORS])
    initials = F.array(*[F.concat_ws(s, a, b) for s, (a, b) in product(SEPARATORS, ((first, last), (last, first)))])
    some = F.when(F.size(parts) >= 2, F.concat(parts, joined, initials)).when(F.size(parts) == 1, F.concat(parts, joined)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(some, lambda v: F.length(v) >= SHORTEST))


def person_names(lines: DataFrame, make: Callable[[], Model], label: str = "PERSON") -> DataFrame:
    """ID-006: persons that the model finds, and their handles anywhere in the same document.

    Handles are matched longest first between characters other than ASCII
    letters and digits, whatever the case; a document's pattern is built from
    its own names, so it travels with its lines and with no others.
    """
    called = entities(lines, make)
    people = called.where(F.col("label") == label)
    found = finish(people.select(*lines.columns, "matched_text", "char_start", F.lit("ID-006").alias("rule_id"), F.lit("IDENTITY").alias("category"), F.when(F.col("matched_text").rlike(r"\S \S"), HIGH).otherwise(MEDIUM).alias("rank")))
    listed = people.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(variants(F.col("matched_text"))))).alias("v")).where(F.size("v") > 0)
    ordered = F.reverse(F.array_sort(F.transform("v", lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    quoted = F.transform(ordered, lambda s: F.regexp_replace(s["v"], r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"))
    patterns = listed.select("doc_id", F.concat(F.lit("(?iU)(?<![A-Za-z0-9])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])")).alias("_p"))
    rows = lines.join(patterns, "doc_id").select("*", F.regexp_extract_all("line_text", F.col("_p"), F.lit(0)).alias("_m"), F.expr("split(line_text, _p, -1)").alias("_g")).where(F.size("_m") > 0)
    spans = rows.select(*lines.columns, F.explode(F.transform("_m", lambda v, k: F.struct(v.alias("matched_text"), starts(F.col("_m"), F.col("_g"), k).alias("char_start")))).alias("s")).select(*lines.columns, "s.*")
    handles = finish(spans.select("*", F.lit("ID-006").alias("rule_id"), F.lit("IDENTITY").alias("category"), F.lit(MEDIUM).alias("rank")))
    return found.unionByName(handles).unionByName(_failed_calls(called, "ID-006"))


def faces(images: DataFrame, make: Callable[[], Callable[[bytes], list[tuple[int, int, int, int]]]], scale_factor: float = 1.1, min_neighbors: int = 5, min_size_fraction: float = 0.05) -> DataFrame:
    """ID-007: boxes that a face detector finds in ``images(doc_id, content)``, in input pixels."""
    if scale_factor <= 1 or min_neighbors < 0 or not 0 < min_size_fraction <= 1:
        raise ScanError("E_POLICY", "ID-007: scale_factor > 1, min_neighbors >= 0 and 0 < min_size_fraction <= 1 are needed")
    ship(images.sparkSession)
    names = [f.split(" ", 1)[0] for f in FINDINGS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = make()
        for b in batches:
            out = []
            for doc_id, content in zip(b["doc_id"], b["content"]):
                try:
                    boxes = detect(bytes(content))
                except Exception as error:  # the text rules go on
                    out.append((doc_id, 0, None, None, "ID-007", FAILED, None, LOW, f"{type(error).__name__}: {error}", None, None, []))
                    continue
                out += [(doc_id, 0, None, None, "ID-007", "IDENTITY", {"x": x, "y": y, "w": w, "h": h}, MEDIUM, "", None, None, []) for x, y, w, h in boxes]
            yield pd.DataFrame(out, columns=names)

    return images.select("doc_id", "content").mapInPandas(run, FINDINGS)
