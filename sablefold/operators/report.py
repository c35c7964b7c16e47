"""Guards, thresholds, warnings and the manifest of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area
from ..functions.text import hmac64
from ..schema import LOW, name_of
from .merge import merged_ids

OVERSIZE, LOW_TOKEN = 0.20, 0.60
WARNING = "doc_id long, code string, message string, source string"


def guard_oversized(findings: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Findings with ``oversized``; those above a fifth of their page become low.  Unknown pages leave them alone.

    Text on the grid has no page: its boxes are as exact as its characters, and a
    secret that fills a short text is no artefact.
    """
    if pages is None:
        return findings.withColumn("oversized", F.lit(False))
    size = pages.select("doc_id", "page_index", (F.col("width").cast("long") * F.col("height")).alias("_page"))
    big = F.coalesce(area(F.col("bbox")) > F.lit(OVERSIZE) * F.col("_page"), F.lit(False))
    rows = findings.join(size, ["doc_id", "page_index"], "left").withColumn("oversized", big).drop("_page")
    return rows.withColumn("conf_rank", F.when(F.col("oversized"), LOW).otherwise(F.col("conf_rank")).cast("tinyint"))


def thresholds(ranks: dict[str, int], rule_id: Column, merged_from: Column) -> Column:
    """The least rank that any of a finding's rules asks for; rules that the policy doesn't enable ask for low."""
    table = F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv]) if ranks else F.create_map().cast("map<string,int>")
    return F.array_min(F.transform(merged_ids(rule_id, merged_from), lambda r: F.coalesce(F.try_element_at(table, r), F.lit(LOW))))


def apply_thresholds(findings: DataFrame, ranks: dict[str, int]) -> DataFrame:
    return findings.where(F.col("conf_rank") >= thresholds(ranks, F.col("rule_id"), F.col("merged_from")))


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with ``finding_id``: f-<rule>-<number from 0> in the order of page, y and x."""
    order = Window.partitionBy("doc_id", "rule_id").orderBy("page_index", "bbox.y", "bbox.x", "bbox.w", "bbox.h", "category", "matched_text", "char_start", F.array_join("merged_from", ","))
    return findings.withColumn("finding_id", F.concat(F.lit("f-"), "rule_id", F.lit("-"), (F.row_number().over(order) - 1).cast("string")))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def by_category_and_rule(findings: DataFrame) -> DataFrame:
    """Counts of all documents with subtotals; null stands for all."""
    return findings.rollup("category", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def warnings(docs: DataFrame, lines: DataFrame, guarded: DataFrame, kept: DataFrame, verbose: bool = False, style_downgraded: bool = False, failed: DataFrame | None = None) -> DataFrame:
    """All warnings, one row per document and code.  ``failed``: doc_id, fatal, message."""
    row = lambda df, code, message, source: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(code).alias("code"), message.alias("message"), F.lit(source).alias("source"))
    read = "tokens" in lines.columns
    least = F.array_min(F.transform("tokens", lambda t: t["confidence"])) if read else F.col("confidence")
    unsure = lines.where(least < LOW_TOKEN).select("doc_id").distinct()
    big = guarded.where("oversized").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ", ").alias("ids"))
    out = row(unsure, "W_LOW_CONFIDENCE_TOKEN", F.lit("a word was read with little confidence"), "ocr")
    out = out.union(row(big, "W_OVERSIZED_FINDING", F.concat(F.lit("findings larger than a fifth of the page were set to low: "), "ids"), "detect"))
    out = out.union(row(docs.select("doc_id").distinct().join(kept.select("doc_id").distinct(), "doc_id", "left_anti"), "W_NO_FINDINGS", F.lit("nothing was found"), "detect"))
    if failed is not None:
        out = out.union(row(failed.where("not fatal"), "W_DETECTOR_PARTIAL_FAILURE", F.concat(F.lit("some rules failed and others ran: "), "message"), "detect"))
        out = out.union(row(failed.where("fatal"), "E_DETECTOR", F.concat(F.lit("no rule ran, and nothing is put out: "), "message"), "detect"))
    if verbose:
        out = out.union(row(docs.select("doc_id").distinct(), "W_VERBOSE_REPORT_ENABLED", F.lit("the report holds the matched text"), "report"))
    if style_downgraded:
        out = out.union(row(docs.select("doc_id").distinct(), "W_STYLE_DOWNGRADED_TO_BLOCK", F.lit("blur can be undone; blocks are drawn instead"), "redact"))
    return out


def manifest(docs: DataFrame, findings: DataFrame, warning_rows: DataFrame, policy_id: str, policy_version: str, key: bytes, verbose: bool = False, created_at: Column | None = None, engine: str = "text-layout", version: str = "0.1.0") -> DataFrame:
    """One row per document of ``docs(doc_id, input_hash, output_hash)``, and all of it as ``json``.

    A document's findings are gathered in its row, as its manifest lists them.
    """
    hash_ = hmac64(F.col("matched_text"), key)
    text = F.col("matched_text") if verbose else F.lit(None).cast("string")
    item = F.struct("page_index", F.col("bbox.y").alias("y"), F.col("bbox.x").alias("x"), "rule_id", F.struct(F.col("finding_id").alias("id"), "rule_id", "category", "bbox", name_of(F.col("conf_rank")).alias("confidence"), text.alias("matched_text"), hash_.alias("matched_text_hash")).alias("f"))
    listed = numbered(findings).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["f"]).alias("findings"))
    counts = by_category(findings).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"), F.sum("n").alias("redactions_total"))
    notes = warning_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("code", "message", "source"))).alias("warnings"))
    rows = docs.join(listed, "doc_id", "left").join(counts, "doc_id", "left").join(notes, "doc_id", "left")
    stamp = created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    none = F.array().cast("array<struct<code:string,message:string,source:string>>")
    empty = F.from_json(F.lit("[]"), listed.schema["findings"].dataType)
    rows = rows.select(
        "doc_id", F.lit("1").alias("schema_version"), F.lit(policy_id).alias("policy_id"), F.lit(policy_version).alias("policy_version"), F.lit(version).alias("runtime_version"),
        F.lit(engine).alias("ocr_engine"), "input_hash", "output_hash", stamp.alias("created_at"),
        F.struct(F.coalesce("redactions_total", F.lit(0).cast("long")).alias("redactions_total"), F.coalesce("by_category", F.create_map().cast("map<string,bigint>")).alias("by_category")).alias("stats"),
        F.coalesce("findings", empty).alias("findings"), F.coalesce("warnings", none).alias("warnings"),
    )
    return rows.withColumn("json", F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"])))


def header(json: Column) -> Column:
    """A manifest's JSON as URL-safe base64, for a message header."""
    return F.translate(F.base64(F.encode(json, "UTF-8")), "+/\r\n", "-_")
