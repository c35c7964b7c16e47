"""One JSON object per log record, without anything that a document says."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime
from typing import Any

# Names of fields that never reach a log.
SECRET = ("text", "bytes", "matched_text", "b64")


def clean(fields: dict[str, Any]) -> dict[str, Any]:
    """``fields`` without those named in ``SECRET``, at any depth."""
    inner = lambda v: clean(v) if isinstance(v, dict) else [inner(x) for x in v] if isinstance(v, list | tuple) else v
    return {k: inner(v) for k, v in fields.items() if k not in SECRET}


class Clean(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        if isinstance(getattr(record, "fields", None), dict):
            record.fields = clean(record.fields)
        return True


class Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        said = {"ts": datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds"), "level": record.levelname.lower(), "event": record.getMessage()}
        said |= {k: v for k in ("request_id", "stage", "duration_ms", "fields") if (v := getattr(record, k, None)) is not None}
        if record.exc_info:
            said["error"] = self.formatException(record.exc_info)
        return json.dumps(said, sort_keys=True, separators=(",", ":"), default=str)


def handler(stream=None) -> logging.Handler:
    """A handler that a caller adds to its logger."""
    out = logging.StreamHandler(stream)
    out.setFormatter(Json())
    out.addFilter(Clean())
    return out
