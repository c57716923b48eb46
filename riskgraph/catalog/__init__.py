"""Every operator applied to the driver tables, with the SQL that must give the same rows."""

from riskgraph.catalog.base import QUERIES, SQL
from riskgraph.catalog import (  # noqa: F401  (each module registers its queries)
    audits, facts, graphs, knowledge, memories, metrics, scoring, sources, survey, temporal,
)

__all__ = ["QUERIES", "SQL"]
