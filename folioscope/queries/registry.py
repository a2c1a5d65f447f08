"""All registered queries by name."""

from __future__ import annotations

from folioscope.queries import catalogue, ingest, parsing, retrieval, streams

_MODULES = (retrieval, ingest, catalogue, parsing, streams)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
