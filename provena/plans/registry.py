"""All registered queries of the library and their SQL twins."""

from provena.plans import evidence, imports, lists, more, publishing, reports, screening, sourcing

MODULES = (screening, evidence, imports, more, sourcing, publishing, reports, lists)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
