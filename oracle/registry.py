"""All registered queries of the session operators, and their SQL."""

from oracle import logs, queries, sql

QUERIES = queries.QUERIES | logs.QUERIES
ORACLES = sql.ORACLES | logs.ORACLES
