"""Queries for each operator of the dialect and the DataFrame API, with DuckDB SQL that gives the same rows."""

from . import api, relational

QUERIES = {**relational.QUERIES, **api.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **api.ORACLE_SQL}
