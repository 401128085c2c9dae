"""All registered queries. Importing a module registers what it defines."""

from stratalake.registry import anomalies, gold, layers, platform, quality  # noqa: F401
from stratalake.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
