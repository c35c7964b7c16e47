"""sablefold: sensitive-data discovery and redaction as Spark DataFrame plans."""

__version__ = "0.1.0"
