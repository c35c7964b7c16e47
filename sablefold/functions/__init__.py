"""Column functions: text spans, checks and geometry."""
