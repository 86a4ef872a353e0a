"""Registered queries: each module has QUERIES (name to function) and ORACLES (name to SQL)."""
