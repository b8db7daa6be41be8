"""Operators on variant frames, metrics, lineage and the run ledger."""
