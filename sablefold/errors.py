"""Errors with a stable code; raised on the driver, before a plan runs."""

from __future__ import annotations

CODES = ("E_INPUT_FORMAT", "E_INPUT_TOO_LARGE", "E_OCR", "E_DETECTOR", "E_REDACTION", "E_POLICY")


class ScanError(Exception):
    def __init__(self, code: str, message: str):
        assert code in CODES
        super().__init__(f"{code}: {message}")
        self.code = code
