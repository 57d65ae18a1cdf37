"""Operators for preparing large text corpora: deduplication, search, tokens, mixing, scoring and scans."""
