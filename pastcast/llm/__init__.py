"""Training-data pipeline operators.

``QUERIES`` and ``ORACLES`` hold the ``opN_<name>`` queries and, where DuckDB can
say the same, their SQL. Nothing else in the library imports this subpackage.
"""
from .queries import ORACLES, QUERIES  # noqa: F401
