"""All registered queries."""

from gaugework.queries import filtering, grouping, learning, outputs, profiling, shapes  # noqa: F401
from gaugework.queries.registry import ORACLES, QUERIES  # noqa: F401
