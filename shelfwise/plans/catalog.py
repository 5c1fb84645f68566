"""All registered queries. Importing a module registers its queries."""

from __future__ import annotations

from shelfwise.plans import (  # noqa: F401
    action_queries,
    core,
    history_queries,
    metric_queries,
    stream_queries,
    text_queries,
)
from shelfwise.plans import registry

# Streams, model fits and kept tables take longest; whoever runs all queries gets the others first.
_LAST = [
    "metric_rollup_deltas", "sink_z_ordered", "snapshot_versions", "status_transition_in_place", "bm25_postings",
    "bm25_topk", "fulltext_postings", "recovery_model", "recovery_model_errors",
]
_late = [n for n in registry.QUERIES if n.startswith("stream_")] + _LAST
QUERIES = {n: q for n, q in registry.QUERIES.items() if n not in _late} | {n: registry.QUERIES[n] for n in _late}

__all__ = ["QUERIES"]
