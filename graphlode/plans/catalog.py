"""The registered core queries and the SQL that checks them."""

from __future__ import annotations

from graphlode.plans import cypher_queries, graph_queries, skew, stream_queries, value_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (graph_queries, value_queries, cypher_queries, stream_queries, skew):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
