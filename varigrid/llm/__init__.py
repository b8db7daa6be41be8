"""Operators for large training corpora: filtering, deduplication, tokens, archives, mixing."""
