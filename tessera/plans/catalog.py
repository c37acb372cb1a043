"""All registered queries and their SQL."""

from tessera.plans import graphs, grids, lookups, retention, series, shapes, sketching  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
