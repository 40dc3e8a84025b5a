"""All queries outside the llm subpackage, with their SQL counterparts."""

from __future__ import annotations

from folioscope.plans import display, extraction, layout, records

_PARTS = (extraction, layout, display, records)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
