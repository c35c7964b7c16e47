"""Fixed schemas, ranks and warning codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BBOX = "struct<x:int,y:int,w:int,h:int>"
TOKENS = f"array<struct<text:string,bbox:{BBOX},confidence:double,char_start:int,char_end:int>>"
LINES = f"doc_id long, page_index int, block_id string, line_no int, reading_order int, line_text string, bbox {BBOX}, confidence double, tokens {TOKENS}"
FINDINGS = f"doc_id long, page_index int, block_id string, line_no int, rule_id string, category string, bbox {BBOX}, conf_rank tinyint, matched_text string, char_start int, char_end int, merged_from array<string>"

CATEGORIES = ("IDENTITY", "CONTACT", "FINANCIAL", "HEALTH", "CREDENTIALS", "LOCATION", "CUSTOM")
CONFIDENCE = ("low", "medium", "high")
RANK = {name: i for i, name in enumerate(CONFIDENCE)}
LOW, MEDIUM, HIGH = range(3)
KEYS = ["doc_id", "page_index", "block_id"]


def rank_of(name: Column) -> Column:
    return F.when(name == "high", HIGH).when(name == "medium", MEDIUM).otherwise(LOW).cast("tinyint")


def name_of(rank: Column) -> Column:
    return F.when(rank == HIGH, "high").when(rank == MEDIUM, "medium").otherwise("low")


def floor_rank(confidence: Column) -> Column:
    """What a smallest token confidence allows at most; nothing covered allows low."""
    return F.when(confidence >= 0.85, HIGH).when(confidence >= 0.60, MEDIUM).otherwise(LOW).cast("tinyint")
