"""Operators for preparing training corpora: filters, near duplicates, tokens, scoring, search, mixing."""
