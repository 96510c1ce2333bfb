"""All queries over the ledger's operators, and the same in SQL."""

from sealstone.plans import analytics, bindings, office, relational, streams  # noqa: F401  they register their queries
from sealstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
