"""All queries of the engine by name, and their SQL."""

from clauseloom.plans import reports, rules, structured, tables, texts

_MODULES = [texts, structured, rules, tables, reports]

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
