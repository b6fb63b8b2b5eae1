"""All queries of the library but those of the training-data subpackage."""

from talkloom.plans import curation_queries, dialogue_queries, extra_queries, probe_queries, reply_queries, score_queries, text_queries, view_queries

_MODULES = [text_queries, score_queries, dialogue_queries, curation_queries, extra_queries, reply_queries, probe_queries, view_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
