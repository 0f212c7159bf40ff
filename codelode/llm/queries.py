"""All queries of the subpackage and their SQL."""

from codelode.llm import code_queries, leakage_queries, mix_queries, neardup_queries, provenance_queries, subject_queries

_MODULES = [code_queries, neardup_queries, provenance_queries, leakage_queries, mix_queries, subject_queries]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
