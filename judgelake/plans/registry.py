"""All queries outside the llm subpackage, with their SQL."""

from judgelake.plans import bank, graded, judged, logs, pipelines, shredded

_MODULES = (graded, judged, bank, pipelines, logs, shredded)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in _MODULES for name, q in m.ORACLE.items()}
