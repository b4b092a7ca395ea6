"""Every query of the library by name, and the SQL that gives the same rows."""

from cladewise.plans import assignment, lineage_queries, more_queries, selection_queries, sequence_queries, tree_queries  # noqa: F401
from cladewise.plans.registry import ORACLES, QUERIES  # noqa: F401
