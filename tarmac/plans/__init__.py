"""Registered queries, each beside the SQL that checks it."""

from tarmac.plans import registry
from tarmac.plans import (  # noqa: F401  (importing registers the queries)
    arriving,
    files,
    flights,
    ids,
    models,
    polygons,
    projections,
    reports,
    series,
    weather,
)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
