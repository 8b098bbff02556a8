"""All queries of the search and its post-processing."""

from __future__ import annotations

from duotrace.plans import allocation, catalog, origin, samples, scans, search, sensitivity

MODULES = (search, sensitivity, catalog, origin, samples, scans, allocation)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
#: With the caps of a whole search.
FULL_QUERIES, FULL_ORACLES = search.FULL_QUERIES, search.FULL_ORACLES
