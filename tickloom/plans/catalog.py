"""All registered queries (importing a module registers its queries)."""

from tickloom.plans import context_queries, evaluation_queries, feature_queries, label_queries, model_queries, recursive_queries, source_queries, stream_queries  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES  # noqa: F401
