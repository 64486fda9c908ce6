"""All core queries by name, with their SQL."""

from __future__ import annotations

from chronoward.plans import (
    anchors_features, data_quality, episodes_labels, evaluation_stats, intervals_cohort, signal_features, streams, tables_models, validation,
)

FLAGSHIP = "sustained_episodes"

_MODULES = [
    data_quality, episodes_labels, intervals_cohort, anchors_features, evaluation_stats, signal_features, streams, tables_models, validation,
]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
