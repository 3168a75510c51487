"""Query plans: domain views over the driver tables and the registered queries."""
from .registry import ORACLES, QUERIES  # noqa: F401
from . import q_metrics, q_collections, q_registry, q_lifecycle, q_etl, q_streaming, q_state  # noqa: F401,E401  (register queries)
