"""Factor catalogues and the registered queries with their check SQL."""

from tessera.plans import q_windows, q_indicators, q_tables, q_factors, q_trading, q_catalogue  # noqa: F401, I001
from tessera.plans.registry import ORACLE, QUERIES  # noqa: F401
