"""All registered queries of the engine's own operators."""

from tessera.plans import io_queries, part_queries, table_queries, text_queries

_ALL = (table_queries, text_queries, io_queries, part_queries)
QUERIES = {k: v for m in _ALL for k, v in m.query.queries.items()}
ORACLE = {k: v for m in _ALL for k, v in m.query.oracle.items()}
