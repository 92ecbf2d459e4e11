"""All registered queries and their SQL, by name."""

from quillspark.plans import adapted, audit, drivers, extra, guided, manuscript, progress, projects

MODULES = (audit, manuscript, projects, adapted, extra, guided, drivers, progress)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
