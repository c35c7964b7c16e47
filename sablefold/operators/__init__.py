"""Detection rules, merging, guards, reports and redaction as DataFrame operators."""
