"""The registered queries and the DuckDB SQL they are checked against."""

from tripwise.catalog.oracles import oracle_sql
from tripwise.catalog.queries import QUERIES

__all__ = ["QUERIES", "oracle_sql"]
