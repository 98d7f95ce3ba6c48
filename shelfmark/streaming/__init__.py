"""Structured Streaming form of the catalog change replay."""
