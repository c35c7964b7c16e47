"""Readers that turn text, OCR words and images into lines."""
