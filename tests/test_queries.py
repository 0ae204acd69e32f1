"""Every registered query of the relational part against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from quernlight import queries as Q

DATA = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "decimal(18,2)": "DECIMAL(18,2)"}


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        made.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return made


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(x, 6) + 0.0 if isinstance(x, float) else x if isinstance(x, (int, bool, str)) else str(x)

    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_as_duckdb(spark, duck, name):
    df, relation = Q.QUERIES[name](spark, DATA), duck.sql(Q.ORACLE_SQL[name])
    assert {c: TYPES[k] for c, k in df.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())
