"""All queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_tree, decontamination, line_runs, mixing, quality_rules, sharding, simhash, token_files, toxicity, url_filters

_MODULES = (
    toxicity, decontamination, mixing, token_files, url_filters, sharding, quality_rules, simhash, chat_tree, line_runs,
)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
