"""From lines and a policy to findings, warnings, masked text and manifests.

Candidate lines, raw findings and guarded findings are written to the shared
folder on the way; the results are lazy plans over these tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import inverse, project
from ..operators import block_rules, label_rules, line_rules, model_rules
from ..operators.common import none
from ..operators.merge import merge
from ..operators.redact import effective_style, hex_colour, mask_images, masked_documents
from ..operators.report import apply_thresholds, guard_oversized, manifest, warnings
from ..operators.words import FAMILY, GIVEN
from ..sources import images as source
from ..sources import ocr
from ..sources.text import text_lines
from ..tables import written
from .policy import Policy, custom, default_policy
from .registry import REGISTERED, TextRule


@dataclass
class Models:
    """What a caller brings for the rules that need a model; a rule without one finds nothing."""

    person: Callable | None = None
    entities: dict[str, Callable] = field(default_factory=dict)
    faces: Callable | None = None
    given: list[str] = field(default_factory=lambda: GIVEN)
    family: list[str] = field(default_factory=lambda: FAMILY)
    rules: dict[str, TextRule] = field(default_factory=dict)


@dataclass
class Result:
    findings: DataFrame
    warnings: DataFrame
    manifest: DataFrame
    masked: DataFrame


@dataclass(frozen=True)
class Looked:
    """What the rules read: all lines, and those that pass a gate of a rule over text.

    ``some`` also holds all lines of the documents in which a rule wants to see
    lines that pass no gate.  It is written down, so the texts are read twice,
    each rule's own filter runs over these few lines, and its plan is short.
    """

    lines: DataFrame
    some: DataFrame


def _look(lines: DataFrame, gates: list[Column], rule_ids: set[str]) -> Looked:
    if not gates:
        return Looked(lines, lines)
    passed = written(lines.where(reduce(lambda a, b: a | b, gates)))
    more = block_rules.whole_page(rule_ids)
    if more is None:
        return Looked(lines, passed)
    pages = passed.where(more).select("doc_id").distinct()
    if pages.isEmpty():
        return Looked(lines, passed)
    pages = written(pages)
    return Looked(lines, written(passed.join(pages, "doc_id", "left_anti").unionByName(lines.join(pages, "doc_id", "left_semi"))))


def raw_findings(lines: DataFrame, policy: Policy, models: Models | None = None, images: DataFrame | None = None) -> DataFrame:
    """The union of what the policy's enabled rules find; other rules have no part in the plan.

    Calls of models that failed are rows of the category ``FAILED``.
    """
    models = models or Models()
    refs = {r.id: r for r in policy.enabled()}
    single = [r for i, r in line_rules.RULES.items() if i in refs]
    if "CU-001" in refs:
        category, expression, rank = custom(refs["CU-001"], lines.sparkSession)
        single.append(line_rules.custom_rule(category, expression, rank))
    labelled = [r for i, r in label_rules.RULES.items() if i in refs]
    card = [line_rules.RULES["FI-001"]]
    # Rules over the lines that pass a gate: the gate, and the rule.
    gated = {
        "ID-001": (block_rules.name_gate(models.given, models.family), lambda some: block_rules.full_names(some, models.given, models.family)),
        "ID-002": (block_rules.birth_gate(), block_rules.birth_dates),
        "ID-008": (label_rules.payment_gate(), label_rules.payment_names),
        "CO-003": (block_rules.address_gate(), block_rules.addresses),
        "CR-002": (block_rules.key_gate(), block_rules.key_blocks),
        "FI-004": (block_rules.card_gate() | line_rules.gate(card), lambda some: block_rules.card_details(some, line_rules.line_findings(some, card))),
    }
    runs = [(gate, run) for i, (gate, run) in gated.items() if i in refs]
    if labelled:
        runs.append((label_rules.gate(labelled), lambda some: label_rules.label_findings(some, labelled)))
    if single and not runs:
        return _union(lines, [line_rules.line_findings(lines, single), *_by_models(lines, refs, models, images, policy)])
    if single:
        runs.append((line_rules.gate(single), lambda some: line_rules.line_findings(some, single)))
    looked = _look(lines, [gate for gate, _ in runs], set(refs))
    return _union(lines, [*(run(looked.some) for _, run in runs), *_by_models(lines, refs, models, images, policy)])


def _by_models(lines: DataFrame, refs: dict, models: Models, images: DataFrame | None, policy: Policy) -> list[DataFrame]:
    """Rules that look at all lines or at pixels."""
    parts = [rule(lines, policy) for i, rule in {**REGISTERED, **models.rules}.items() if i in refs]
    if "ID-006" in refs and models.person:
        parts.append(model_rules.person_names(lines, models.person))
    if "ID-007" in refs and models.faces and images is not None:
        parts.append(model_rules.faces(images, models.faces, **refs["ID-007"].overrides))
    return parts + [model_rules.entity_findings(lines, i, models.entities[i]) for i in model_rules.LABELS if i in refs and i in models.entities]


def _union(lines: DataFrame, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else none(lines)


def kept_findings(lines: DataFrame, pages: DataFrame | None, policy: Policy, models: Models | None = None, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged and guarded findings, and those of them that reach the policy's thresholds."""
    return _kept(written(raw_findings(lines, policy, models, images)), pages, policy)


def _kept(raw: DataFrame, pages: DataFrame | None, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Findings are few beside the text they come from and are used several times from here on, so they are written down."""
    guarded = written(guard_oversized(merge(raw.where(F.col("category") != model_rules.FAILED)), pages))
    return guarded, apply_thresholds(guarded, policy.ranks())


def scan(docs: DataFrame, policy: Policy | None = None, key: bytes = b"", models: Models | None = None, confidence: float = 0.95) -> Result:
    """Everything about ``docs(doc_id, text)``; a doc_id names one document.  ``key`` is the secret of the hashes of matched text.

    A document for which all rules failed has a null text and a warning
    ``E_DETECTOR``; one for which some failed has a warning.  Texts aren't
    guarded by area, and apart from their findings they come back as they were.
    """
    policy = policy or default_policy()
    lines = text_lines(docs, confidence=confidence)
    raw = written(raw_findings(lines, policy, models))
    guarded, kept = _kept(raw, None, policy)
    kind, downgraded = effective_style(policy.redaction_style["kind"])
    asked = models or Models()
    idle = {"ID-007"} | ({"ID-006"} if not asked.person else set()) | {i for i in model_rules.LABELS if i not in asked.entities}
    failed = model_rules.failures(raw, len({r.id for r in policy.enabled()} - idle))
    notes = warnings(docs, lines, guarded, kept, policy.verbose_report, downgraded, failed)
    shut = failed.where("fatal").select("doc_id").withColumn("shut", F.lit(True))
    masked = masked_documents(docs, lines, kept, kind).join(shut, "doc_id", "left").select("doc_id", F.when(F.col("shut").isNull(), F.col("redacted")).alias("redacted"))
    hashes = docs.select("doc_id", F.sha2("text", 256).alias("input_hash")).join(masked.select("doc_id", F.sha2("redacted", 256).alias("output_hash")), "doc_id", "left")
    return Result(kept, notes, manifest(hashes, kept, notes, policy.id, policy.version, key, policy.verbose_report), masked)


def scan_images(images: DataFrame, engine: Callable[[], ocr.Engine], policy: Policy | None = None, key: bytes = b"", models: Models | None = None) -> Result:
    """Everything about ``images(doc_id, content, mime_type)``, read by an OCR engine that is made once per task.

    Images pass the intake checks, small ones are enlarged to be read, words
    become lines, and findings are guarded by their page, kept by threshold and
    taken back to the image's own pixels, where they are masked.  ``masked`` has
    doc_id, content, width, height and error; an image that can't be taken in,
    read, looked at by any rule or masked has an error and no content.
    """
    policy = policy or default_policy()
    asked = models or Models()
    taken = written(source.ingest(images).select(F.col("doc_id").cast("long").alias("doc_id"), "content", "mime_type", "output_format", "error"))
    pages = written(source.pages(taken.where("error is null")))
    good = pages.where("error is null")
    words = written(ocr.recognise(good.select("doc_id", F.col("page").alias("content")), engine))
    lines = written(ocr.compose(words.where("conf <> 'E_OCR'")))
    raw = written(raw_findings(lines, policy, models, good.select("doc_id", "content")))
    of_image = F.col("rule_id").isin(list(model_rules.IMAGE_RULES))
    sizes = good.select("doc_id", F.lit(0).alias("page_index"), F.col("page_width").alias("width"), F.col("page_height").alias("height"))
    # Boxes of pixel rules are the image's own; the page is as much larger as they are taken to be here.
    forth = source.page_transform(F.col("w"), F.col("h"))
    own = good.select("doc_id", F.col("width").alias("w"), F.col("height").alias("h"))
    on_page = raw.join(own, "doc_id").withColumn("bbox", F.when(of_image, project(forth, F.col("bbox"))).otherwise(F.col("bbox"))).drop("w", "h")
    guarded, kept = _kept(written(on_page), sizes, policy)
    back = inverse(source.page_transform(F.col("w"), F.col("h")))
    idle = {"ID-006"} if not asked.person else set()
    idle |= {i for i in model_rules.LABELS if i not in asked.entities} | set(model_rules.IMAGE_RULES)
    failed = model_rules.failures(raw, len({r.id for r in policy.enabled()} - idle), 1)
    said = lambda df, message: df.select("doc_id", message.alias("why"))
    shut = said(taken.where("error is not null"), F.col("error")).union(said(pages.where("error is not null"), F.col("error"))).union(said(ocr.failures(words), F.concat(F.lit("E_OCR: "), "message"))).union(said(failed.where("fatal"), F.concat(F.lit("E_DETECTOR: "), "message")))
    shut = written(shut.groupBy("doc_id").agg(F.min("why").alias("why")))
    kept = written(kept.join(own, "doc_id").withColumn("bbox", project(back, F.col("bbox"))).drop("w", "h").join(shut, "doc_id", "left_anti"))
    style = policy.redaction_style
    kind, downgraded = effective_style(style["kind"])
    notes = warnings(taken, lines, guarded, kept, policy.verbose_report, downgraded, failed)
    options = {"colour": hex_colour(style["color"])} if "color" in style else {}
    options |= {"text_colour": hex_colour(style["text_color"])} if "text_color" in style else {}
    options |= {"padding": style["padding"]} if "padding" in style else {}
    open_ = taken.where("error is null").join(shut, "doc_id", "left_anti")
    drawn = written(mask_images(open_, kept.select("doc_id", "bbox", "category"), kind, **options))
    none_ = shut.select("doc_id", F.lit(None).cast("binary").alias("content"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.col("why").alias("error"))
    masked = drawn.unionByName(none_)
    hashes = taken.select("doc_id", F.sha2("content", 256).alias("input_hash")).join(masked.select("doc_id", F.sha2("content", 256).alias("output_hash")), "doc_id", "left")
    return Result(kept, notes, manifest(hashes, kept, notes, policy.id, policy.version, key, policy.verbose_report, engine=engine().engine_id()), masked)
