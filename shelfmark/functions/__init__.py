"""Column-level functions: text, labels, enrichment, timestamps."""
