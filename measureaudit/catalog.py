"""All queries of the library by name, and the SQL that each must agree with."""

from __future__ import annotations

from .plans import cells, census, conflicts, corpus, entities, evaluation, models, network

_PARTS = (conflicts, census, entities, network, evaluation, cells, corpus, models)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
