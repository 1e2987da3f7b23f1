"""All registered queries, grouped by operator family."""

from gridspark.registry import base
from gridspark.registry import (  # noqa: F401  (registration side effects)
    q_filter, q_project, q_aggregate, q_pivot, q_rank, q_join, q_clean, q_derive,
    q_analysis, q_profile, q_search, q_plans,
)

QUERIES = base.QUERIES
ORACLE = base.ORACLE
