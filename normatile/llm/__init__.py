"""Operators for preparing training text: deduplication, decontamination, redaction, rules, mixing, formatting."""
