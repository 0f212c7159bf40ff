"""All queries of the core and their SQL."""

from __future__ import annotations

from codelode.plans import analysis_queries, code_facts_queries, doc_queries, graph_queries, orphan_queries, table_queries

_MODULES = [orphan_queries, graph_queries, analysis_queries, table_queries, code_facts_queries, doc_queries]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
