"""Every registered query of the memory engine, with its DuckDB SQL."""

from memspark.plans import queries, queries_exchange, queries_ranked

FLAGSHIP = queries_ranked.hybrid_read.__name__
#: queries_exchange imports the other modules, which all register with queries.
QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.ORACLE_SQL)
