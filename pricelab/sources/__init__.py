"""Readers and writers (given tables, derived fixtures, CSV/JSON/JSONL)."""
