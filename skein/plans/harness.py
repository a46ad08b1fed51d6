"""All queries over the harness tables, by the inventory's ids, with their DuckDB twins."""

from __future__ import annotations

from skein.plans import aggregates, domain, duties, flagship, kernels, landing, live, matching, measurement, more, relations, reports, resolver, streams
from skein.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "flagship_nearest_view"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "aggregates", "domain", "duties", "flagship", "kernels", "landing", "live", "matching", "measurement", "more", "relations", "reports", "resolver", "streams"]
