"""All registered queries, by area."""

from . import (  # noqa: F401  (importing registers the queries)
    queries_charts,
    queries_clean,
    queries_findings,
    queries_models,
    queries_profile,
    queries_series,
    queries_stats,
    queries_text,
)

FLAGSHIP = "profile_lineitem"
