"""Rules of a caller's own: from lines and a policy to findings."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from ..errors import ScanError
from .policy import RULE_ID, RULE_IDS, Policy


class TextRule(Protocol):
    """``lines`` as of ``sources.text``; the result has the columns of ``schema.FINDINGS``."""

    def __call__(self, lines: DataFrame, policy: Policy) -> DataFrame: ...


REGISTERED: dict[str, TextRule] = {}


def register(rule_id: str, rule: TextRule) -> None:
    """Lets policies name ``rule_id``; it runs where a policy enables it."""
    if not RULE_ID.match(rule_id):
        raise ScanError("E_POLICY", f"{rule_id!r} is no rule id")
    if rule_id in RULE_IDS and rule_id not in REGISTERED:
        raise ScanError("E_POLICY", f"{rule_id} is there already")
    REGISTERED[rule_id] = rule
    if rule_id not in RULE_IDS:
        RULE_IDS.append(rule_id)


def unregister(rule_id: str) -> None:
    if REGISTERED.pop(rule_id, None) is not None:
        RULE_IDS.remove(rule_id)
