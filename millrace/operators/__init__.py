"""Operators: movement and rewrites, audits, schema metadata, ledgers, step debugging."""
