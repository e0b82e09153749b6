"""All registered queries and their SQL."""

from __future__ import annotations

from tidewell.plans import feature_queries, file_queries, harmonic_queries, inference_queries, model_queries, queries, rhythm_queries, score_queries, window_queries  # noqa: F401  (registers its queries)

QUERIES, ORACLE_SQL, days = queries.QUERIES, queries.ORACLE_SQL, queries.days
