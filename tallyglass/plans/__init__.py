"""Registered queries by family."""

from tallyglass.plans import control, detail, ledger, live, seeded, stores, streams, text, trust

MODULES = [ledger, text, trust, live, detail, control, seeded, streams, stores]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
