"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import answer_queries, dialogue_queries, graph_queries, retrieval_queries, rule_queries, state_queries, text_queries

_ALL = {}
for _m in (text_queries, retrieval_queries, graph_queries, dialogue_queries, state_queries, rule_queries, answer_queries):
    _ALL |= _m.Q

QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items() if s}
