"""Seeded queries that walk a graph of tables with joins of all kinds: same as DuckDB, whatever strategy Spark takes."""

import random

import duckdb
import pytest

TABLES = {
    "C": ("ID int, NAME varchar, REGION varchar", [(1, "ann", "north"), (2, "bob", "south"), (3, "cal", "north"), (4, "dee", None), (5, "eve", "south")]),
    "O": ("ID int, CUST int, AMOUNT int, SHIPPER int", [(10, 1, 100, 1), (11, 1, 250, 2), (12, 2, 75, None), (13, 3, None, 1), (14, 9, 400, 3), (15, None, 50, 2), (16, 2, 250, 1)]),
    "S": ("ID int, CARRIER varchar", [(1, "air"), (2, "sea"), (4, "rail")]),
    "R": ("NAME varchar, ZONE varchar", [("north", "A"), ("south", "B"), ("west", "C")]),
    "T": ("ORDER_ID int, REASON varchar", [(11, "damaged"), (14, "late"), (11, "again")]),
}
EDGES = [("C", "O", "C.ID = O.CUST"), ("O", "S", "O.SHIPPER = S.ID"), ("C", "R", "C.REGION = R.NAME"), ("O", "T", "O.ID = T.ORDER_ID")]
FILTERS = ["O.AMOUNT > 80", "C.REGION IS NOT NULL", "S.CARRIER <> 'sea'", "O.SHIPPER IS NULL", "T.REASON IS NULL", "R.ZONE = 'A' OR O.AMOUNT < 300"]
STRATEGIES = [{}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.join.preferSortMergeJoin": "false", "spark.sql.shuffle.partitions": "7"}, {"spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.EliminateOuterJoin,org.apache.spark.sql.catalyst.optimizer.PushPredicateThroughJoin", "spark.sql.shuffle.partitions": "1"}]


def query(seed: int) -> str:
    r = random.Random(seed)
    used, text = [r.choice("COSRT")], ""
    text = used[0]
    while len(used) < r.randint(2, 5):
        near = [(a, b, on) for a, b, on in EDGES if (a in used) != (b in used)]
        a, b, on = r.choice(near)
        new = b if a in used else a
        extra = f" AND {new}.{'NAME' if new in 'CR' else 'ORDER_ID' if new == 'T' else 'ID'} IS NOT NULL" if r.random() < 0.3 else ""
        text += f" {r.choice(['JOIN', 'LEFT JOIN', 'RIGHT JOIN', 'FULL JOIN'])} {new} ON {on}{extra}"
        used.append(new)
    columns = ", ".join(f"{t}.{c.split()[0]} AS {t}{i}" for t in used for i, c in enumerate(TABLES[t][0].split(", ")))
    allowed = [f for f in FILTERS if all(t not in f or t in used for t in ("C.", "O.", "S.", "R.", "T.")) and all(f"{t}." not in f or t in used for t in "COSRT")]
    where = f" WHERE {r.choice(allowed)}" if allowed and r.random() < 0.6 else ""
    return f"SELECT {columns} FROM {text}{where}"


@pytest.fixture(scope="module")
def both(spark):
    from quernlight.engine import Engine

    engine, duck = Engine(spark), duckdb.connect()
    for name, (columns, rows) in TABLES.items():
        names = [c.split()[0] for c in columns.split(", ")]
        engine.register_table(name, [dict(zip(names, r)) for r in rows])
        duck.execute(f"create table {name} ({columns})")
        duck.executemany(f"insert into {name} values ({', '.join('?' * len(names))})", [list(r) for r in rows])
    return engine, duck


@pytest.mark.parametrize("seed", range(24))
def test_same_as_duckdb(spark, both, seed):
    engine, duck = both
    text = query(seed)
    expected = sorted(map(repr, duck.execute(text).fetchall()))
    strategy = STRATEGIES[seed % len(STRATEGIES)]
    before = {k: spark.conf.get(k, None) for k in strategy}
    for k, v in strategy.items():
        spark.conf.set(k, v)
    try:
        assert sorted(repr(tuple(r.values())) for r in engine.run(text).rows) == expected, text
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
