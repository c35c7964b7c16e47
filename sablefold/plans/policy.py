"""Policies: which rules run, what confidence they need, how findings are masked."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import ScanError
from ..schema import CATEGORIES, CONFIDENCE, RANK

RULE_ID = re.compile(r"^[A-Z]{2}-[0-9]{3}$")
# All rules, those that the default policy leaves out or off, and those that need medium.
RULE_IDS = "ID-001 ID-002 ID-003 ID-004 ID-005 ID-006 ID-007 ID-008 CO-001 CO-002 CO-003 FI-001 FI-002 FI-003 FI-004 FI-005 HE-001 HE-002 HE-003 CR-001 CR-002 CR-003 LO-001 CU-001 ML-001 ML-002".split()
OFF = ("HE-002", "HE-003", "ML-001", "ML-002")
NEED_MEDIUM = ("ID-005", "ID-007", "CO-003", "FI-003", "CR-001")
STYLE_FIELDS = {"block": {"color", "padding"}, "blur": {"radius", "padding"}, "pixelate": {"block_size", "padding"}, "label": {"color", "text_color", "padding"}}


def _bad(message: str) -> ScanError:
    return ScanError("E_POLICY", message)


@dataclass(frozen=True)
class RuleRef:
    id: str
    enabled: bool = True
    threshold: str = "low"
    overrides: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not isinstance(self.id, str) or not RULE_ID.match(self.id):
            raise _bad(f"{self.id!r} is no rule id")
        if self.threshold not in CONFIDENCE or not isinstance(self.enabled, bool) or not isinstance(self.overrides, dict):
            raise _bad(f"{self.id}: a threshold of {CONFIDENCE}, enabled true or false, and a mapping of overrides are needed")


@dataclass(frozen=True)
class Policy:
    id: str
    version: str = "1"
    description: str = ""
    posture: str = "strict"
    verbose_report: bool = False
    redaction_style: dict[str, Any] = field(default_factory=lambda: {"kind": "block"})
    detectors: tuple[RuleRef, ...] = ()

    def __post_init__(self) -> None:
        if not self.id or len(self.description) > 240 or self.posture not in ("strict", "lenient"):
            raise _bad("a policy has an id, a description of at most 240 characters, and is strict or lenient")
        ids = [d.id for d in self.detectors]
        if len(ids) != len(set(ids)):
            raise _bad("a rule is named twice")
        style = dict(self.redaction_style)
        kind = style.pop("kind", None)
        if kind not in STYLE_FIELDS or set(style) - STYLE_FIELDS[kind]:
            raise _bad(f"redaction_style {self.redaction_style!r} isn't known")

    def enabled(self) -> list[RuleRef]:
        unknown = [d.id for d in self.detectors if d.enabled and d.id not in RULE_IDS]
        if unknown:
            raise _bad(f"no rule {unknown[0]}")
        return [d for d in self.detectors if d.enabled]

    def ranks(self) -> dict[str, int]:
        """The least rank that counts, by enabled rule; a lenient policy asks for a step more."""
        up = self.posture == "lenient"
        return {d.id: min(2, RANK[d.threshold] + up) for d in self.enabled()}

    def with_rules(self, *refs: RuleRef) -> Policy:
        """The same policy with rules added or replaced."""
        new = {r.id: r for r in refs}
        kept = [new.pop(d.id, d) for d in self.detectors]
        return replace(self, detectors=(*kept, *new.values()))


def default_policy() -> Policy:
    refs = (RuleRef(r, r not in OFF, "medium" if r in NEED_MEDIUM else "low") for r in RULE_IDS if r != "CU-001")
    return Policy("default", "0.1", "Identity, contact, financial, health, credential and location data.", detectors=tuple(refs))


def parse(text: str) -> Policy:
    """A policy from JSON, or from YAML where a YAML reader is installed."""
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise _bad("this installation reads policies in JSON only") from e
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise _bad(f"the policy can't be read: {e}") from e
    if not isinstance(data, dict):
        raise _bad("a policy is a mapping")
    try:
        refs = tuple(RuleRef(**d) for d in data.pop("detectors", ()))
        data["version"] = str(data.get("version", "1"))
        return Policy(**data, detectors=refs)
    except TypeError as e:
        raise _bad(str(e)) from e


def load(path: str) -> Policy:
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise _bad(f"{path} can't be read") from e


def frame(spark: SparkSession, policy: Policy) -> DataFrame:
    """The policy as rows: rule_id, enabled, threshold_rank, eff_rank, overrides (values as JSON)."""
    ranks = policy.ranks()
    rows = [(d.id, d.enabled, RANK[d.threshold], ranks.get(d.id), {k: json.dumps(v) for k, v in d.overrides.items()}) for d in policy.detectors]
    return spark.createDataFrame(rows, "rule_id string, enabled boolean, threshold_rank int, eff_rank int, overrides map<string,string>")


def custom(ref: RuleRef, spark: SparkSession) -> tuple[str, str, int]:
    """Category, pattern and rank of a CU-001 reference; the pattern is compiled here, before any plan runs."""
    o = ref.overrides
    category, confidence, kind = o.get("category", "CUSTOM"), o.get("confidence", "medium"), o.get("kind", "regex")
    if category not in CATEGORIES or confidence not in CONFIDENCE or kind not in ("regex", "dictionary"):
        raise _bad("CU-001: category, confidence or kind isn't known")
    if kind == "regex":
        expression = o.get("pattern")
        if not isinstance(expression, str) or not expression:
            raise _bad("CU-001: a pattern is needed")
    else:
        words = o.get("words")
        words = [w.strip() for w in words if w.strip()] if isinstance(words, list) and all(isinstance(w, str) for w in words) else []
        if not words:
            raise _bad("CU-001: a list of words is needed")
        expression = r"\b(?:" + "|".join(reduce(lambda s, c: s.replace(c, "\\" + c), "\\.[]{}()*+?^$|-", w) for w in words) + r")\b"
    try:
        spark._jvm.java.util.regex.Pattern.compile(expression)
    except Exception as e:
        raise _bad(f"CU-001: {expression!r} is no pattern") from e
    return category, expression, RANK[confidence]
