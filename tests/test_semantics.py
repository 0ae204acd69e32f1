"""Answers worked out by hand on tiny tables, and DuckDB on the same rows."""

import datetime

import duckdb
import pytest

from quernlight.plans.syntax import DialectError

EMP = [(1, "alice", 10, 100, None), (2, "bob", 10, 200, 1), (3, "carol", 20, 300, 1), (4, "dave", 20, None, 2), (5, "eve", None, 500, 2)]
DEPT = [(10, "sales"), (20, "eng"), (30, "hr")]
T = [("a", 1), ("a", 2), ("b", 3), ("b", 3), ("c", None), (None, 5)]
W = [(1, 10), (2, 20), (2, 25), (4, 40), (7, 70)]
TABLES = {"EMP": (["ID", "NAME", "DEPT", "SAL", "MGR"], EMP), "DEPT": (["DEPT", "DNAME"], DEPT), "T": (["K", "V"], T), "W": (["A", "B"], W)}


@pytest.fixture(scope="module")
def corpus(spark):
    from quernlight.engine import Engine

    engine, duck = Engine(spark), duckdb.connect()
    for name, (columns, rows) in TABLES.items():
        engine.register_table(name, [dict(zip(columns, r)) for r in rows])
        kinds = ["varchar" if any(isinstance(r[i], str) for r in rows) else "int" for i in range(len(columns))]
        duck.execute(f"create table {name} ({', '.join(f'{c} {k}' for c, k in zip(columns, kinds))})")
        duck.executemany(f"insert into {name} values ({', '.join('?' * len(columns))})", [list(r) for r in rows])
    return engine, duck


def values(engine, text, params=None):
    return [tuple(r.values()) for r in engine.run(text, params).rows]


SAME_AS_DUCKDB = [
    "SELECT E.NAME, D.DNAME FROM EMP E LEFT JOIN DEPT D ON E.DEPT = D.DEPT AND D.DNAME <> 'eng'",
    "SELECT E.NAME, D.DNAME FROM EMP E FULL JOIN DEPT D ON E.DEPT = D.DEPT",
    "SELECT NAME FROM EMP WHERE SAL > ALL (SELECT SAL FROM EMP X WHERE X.DEPT = EMP.DEPT AND X.ID < EMP.ID)",
    "SELECT NAME, SAL > ANY (SELECT X.SAL FROM EMP X WHERE X.ID <> EMP.ID) AS Q FROM EMP",
    "SELECT NAME, DEPT NOT IN (SELECT DEPT FROM DEPT WHERE DEPT > 10) AS Q FROM EMP",
    "SELECT NAME FROM EMP WHERE DEPT NOT IN (SELECT DEPT FROM EMP)",
    "SELECT NAME FROM EMP WHERE NOT (ID = 1 OR DEPT IN (SELECT DEPT FROM EMP))",
    "SELECT DNAME, (SELECT COUNT(*) FROM EMP WHERE EMP.DEPT = DEPT.DEPT) AS N, (SELECT MAX(SAL) FROM EMP WHERE EMP.DEPT = DEPT.DEPT) AS M FROM DEPT",
    "SELECT K, SUM(V) AS S, COUNT(DISTINCT V) AS C FROM T GROUP BY K HAVING COUNT(*) > 0",
    "SELECT A, SUM(B) OVER (ORDER BY A GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS S, COUNT(*) OVER (ORDER BY A DESC RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS C FROM W",
    "SELECT A, MAX(B) OVER (PARTITION BY A % 2 ORDER BY B ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS M FROM W",
    "SELECT K FROM T INTERSECT ALL SELECT 'b' UNION ALL SELECT K FROM T EXCEPT ALL SELECT 'a'",
    "WITH X(P) AS (SELECT V FROM T WHERE V > 1) SELECT P, COUNT(*) AS N FROM X GROUP BY P",
    "SELECT M.NAME, COUNT(E.ID) AS N FROM EMP M LEFT JOIN EMP E ON E.MGR = M.ID GROUP BY M.NAME",
    "SELECT K, CASE WHEN V > 2 THEN 'big' WHEN V IS NULL THEN NULL ELSE 'small' END AS S, V BETWEEN 2 AND NULL AS B FROM T",
]


@pytest.mark.parametrize("text", SAME_AS_DUCKDB)
def test_same_as_duckdb(corpus, text):
    engine, duck = corpus
    assert sorted(map(repr, values(engine, text))) == sorted(map(repr, duck.execute(text).fetchall()))


def test_nulls_come_last_ascending_and_first_descending(corpus):
    engine, _ = corpus
    assert [v for (v,) in values(engine, "SELECT DISTINCT V FROM T ORDER BY V")] == [1, 2, 3, 5, None]
    assert [v for (v,) in values(engine, "SELECT DISTINCT V FROM T ORDER BY V DESC")] == [None, 5, 3, 2, 1]


def test_nothing_raises_for_bad_arithmetic_or_casts(corpus):
    engine, _ = corpus
    assert values(engine, "SELECT 1 / 0, 1 % 0, CAST('x' AS INT), CAST('' AS DOUBLE), CAST('1.9' AS INT), 7 / 2, -7 % 3") == [(None, None, None, None, 1, 3.5, -1)]


def test_whole_numbers_widen_and_halves_round_up(corpus):
    engine, _ = corpus
    assert values(engine, "SELECT 2147483647 + 1, 2147483647 * 2147483647, ROUND(-2.5), ROUND(2.5), ROUND(-2.25, 1)") == [(2147483648, 4611686014132420609, -2.0, 3.0, -2.2)]


def test_dates(corpus):
    engine, _ = corpus
    d = datetime.date
    assert values(engine, "SELECT DATE '2020-01-31' + INTERVAL '1' MONTH, DATE '2020-03-01' - DATE '2020-02-01', DATE '2020-01-31' + 1, TIMESTAMP '2020-01-01 00:00:30' - INTERVAL '1' MINUTE") == [(d(2020, 2, 29), 29, d(2020, 2, 1), datetime.datetime(2019, 12, 31, 23, 59, 30))]
    with pytest.raises(DialectError):
        engine.run("SELECT DATE '2020-01-31' + INTERVAL '1' HOUR")


def test_names_of_unnamed_columns_and_repeats(corpus):
    engine, _ = corpus
    made = engine.run("SELECT V, V, V + 1, SUM(V) OVER (), UPPER(K) FROM T LIMIT 1")
    assert made.columns == ["V", "V", "col2", "col3", "upper"] and made.row_keys == ["V", "V_2", "col2", "col3", "upper"]
    assert engine.run("SELECT COUNT(*), SUM(V) FROM T").columns == ["count_star", "sum"]


def test_an_alias_hides_a_column_in_group_by(corpus):
    engine, _ = corpus
    assert sorted(values(engine, "SELECT V % 2 AS V, COUNT(*) FROM T WHERE V IS NOT NULL GROUP BY V")) == [(0, 1), (1, 4)]


def test_a_scalar_subquery_of_more_rows_gives_one(corpus):
    engine, _ = corpus
    assert values(engine, "SELECT (SELECT V FROM T WHERE K = 'b') AS X, (SELECT V FROM T WHERE V > 2 ORDER BY V DESC) AS Y") == [(3, 5)]


def test_outer_columns_inside_aggregates(corpus):
    engine, _ = corpus
    text = "SELECT D.DNAME, (SELECT SUM(E.SAL + D.DEPT) FROM EMP E WHERE E.DEPT = D.DEPT) AS S FROM DEPT D"
    assert sorted(values(engine, text), key=repr) == [("eng", 320), ("hr", None), ("sales", 320)]


def test_subqueries_over_groups(corpus):
    engine, _ = corpus
    by_dept = "SELECT E.DEPT, (SELECT D.DNAME FROM DEPT D WHERE D.DEPT = E.DEPT) AS N, COUNT(*) AS C FROM EMP E GROUP BY E.DEPT"
    plain = "SELECT E.DEPT, MAX(D.DNAME) AS N, COUNT(*) AS C FROM EMP E LEFT JOIN DEPT D ON D.DEPT = E.DEPT GROUP BY E.DEPT"
    assert sorted(values(engine, by_dept), key=repr) == sorted(values(engine, plain), key=repr)
    assert sorted(values(engine, "SELECT K FROM T GROUP BY K HAVING COUNT(*) >= ALL (SELECT COUNT(*) FROM T GROUP BY K)"), key=repr) == sorted(values(engine, "SELECT K FROM T GROUP BY K HAVING COUNT(*) = (SELECT MAX(N) FROM (SELECT COUNT(*) AS N FROM T GROUP BY K) X)"), key=repr)
    assert values(engine, "SELECT COUNT(*) > ANY (SELECT V FROM T), SUM(V) + 1 FROM T HAVING EXISTS (SELECT 1 FROM W WHERE A < COUNT(*))") == [(True, values(engine, "SELECT SUM(V) + 1 FROM T")[0][0])]
    ordered = "SELECT DEPT FROM EMP GROUP BY DEPT ORDER BY (SELECT DNAME FROM DEPT WHERE DEPT.DEPT = EMP.DEPT) DESC, DEPT"
    assert values(engine, ordered) == values(engine, "SELECT DEPT FROM (SELECT E.DEPT AS DEPT, MAX(DNAME) AS N FROM EMP E LEFT JOIN DEPT D ON D.DEPT = E.DEPT GROUP BY E.DEPT) X ORDER BY N DESC, DEPT")
    assert values(engine, "SELECT K, RANK() OVER (ORDER BY COUNT(*) DESC, K) AS R, (SELECT MAX(V) FROM T U WHERE U.K = T.K) AS M FROM T GROUP BY K HAVING K = 'b'") == [("b", 1, values(engine, "SELECT MAX(V) FROM T WHERE K = 'b'")[0][0])]


def test_subqueries_in_on(corpus):
    engine, _ = corpus
    text = "SELECT E.ID FROM EMP E JOIN DEPT D ON D.DEPT = E.DEPT AND E.SAL >= ALL (SELECT SAL FROM EMP X WHERE X.DEPT = D.DEPT) ORDER BY ID"
    assert values(engine, text) == values(engine, "SELECT E.ID FROM EMP E JOIN DEPT D ON D.DEPT = E.DEPT WHERE E.SAL >= ALL (SELECT SAL FROM EMP X WHERE X.DEPT = D.DEPT) ORDER BY ID")


def test_parameters(corpus):
    engine, _ = corpus
    assert values(engine, "SELECT K FROM T WHERE V = $1 OR K = :2 ORDER BY K LIMIT $3", [5, "c", 1]) == [("c",)]
    assert values(engine, "SELECT $1 AS X", ["a'\\b"]) == [("a'\\b",)]
    with pytest.raises(DialectError):
        engine.run("SELECT $2", [1])


def test_windows_in_order_by_and_groups_over_aggregates(corpus):
    engine, _ = corpus
    assert values(engine, "SELECT A FROM W ORDER BY ROW_NUMBER() OVER (ORDER BY B DESC)") == [(7,), (4,), (2,), (2,), (1,)]
    assert sorted(values(engine, "SELECT K, SUM(COUNT(*)) OVER (ORDER BY K GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS N FROM T GROUP BY K"), key=repr) == [("a", 2), ("b", 4), ("c", 3), (None, 2)]


def test_both_copies_of_shared_names(corpus):
    engine, _ = corpus
    assert engine.run("SELECT * FROM EMP NATURAL JOIN DEPT").columns == ["ID", "NAME", "DEPT", "SAL", "MGR", "DEPT", "DNAME"]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT X FROM T",
        "SELECT V FROM NOWHERE",
        "SELECT DEPT FROM EMP, DEPT",
        "SELECT NAME, COUNT(*) FROM EMP GROUP BY DEPT",
        "SELECT SUM(NAME) FROM EMP",
        "SELECT * FROM EMP WHERE NAME = SAL",
        "SELECT * FROM EMP WHERE SAL > 'abc'",
        "SELECT * FROM EMP WHERE SAL",
        "SELECT NTILE(2) OVER (ORDER BY V) FROM T",
        "SELECT COUNT(DISTINCT V) OVER () FROM T",
        "SELECT FROBNICATE(V) FROM T",
        "SELECT UPPER(K, K) FROM T",
        "SELECT K FROM T UNION SELECT K, V FROM T",
        "SELECT K FROM T UNION SELECT V FROM T",
        "SELECT V FROM T ORDER BY 2",
        "SELECT DISTINCT K FROM T ORDER BY V",
        "SELECT SUM(V) OVER (GROUPS 1 PRECEDING) FROM T",
        "SELECT SUM(V) OVER (ORDER BY K, V RANGE 1 PRECEDING) FROM T",
        "SELECT SUM(V) OVER (ORDER BY V ROWS BETWEEN UNBOUNDED FOLLOWING AND CURRENT ROW) FROM T",
        "SELECT SUM(COUNT(*)) FROM T",
        "SELECT K, (SELECT MAX(A) FROM W WHERE A = V) FROM T GROUP BY K",
        "SELECT K FROM T GROUP BY K HAVING EXISTS (SELECT 1 FROM W WHERE SUM(A) > 1)",
        "SELECT E.ID FROM EMP E LEFT JOIN DEPT D ON D.DEPT = E.DEPT AND E.SAL > ANY (SELECT SAL FROM EMP X WHERE X.DEPT = D.DEPT)",
        "SELECT K FROM T WHERE COUNT(*) > 1",
        "SELECT V FROM T LIMIT K",
        "SELECT N FROM (SELECT (SELECT (SELECT T.V FROM W) FROM W) AS N FROM T) X",
        "WITH C AS (SELECT V FROM W WHERE A = T.V) SELECT 1 FROM T WHERE EXISTS (SELECT 1 FROM C)",
    ],
)
def test_errors_before_anything_runs(corpus, text):
    with pytest.raises(DialectError):
        corpus[0].sql(text)


def test_ranks_without_an_order(corpus):
    engine, _ = corpus
    assert sorted(values(engine, "SELECT ROW_NUMBER() OVER () AS N, RANK() OVER (PARTITION BY K) AS R FROM T")) == [(i, 1) for i in range(1, 7)]


def test_tables_named_as_columns(corpus):
    engine, _ = corpus
    engine.register_table("K", [{"K": 1, "D": {"x": 1}}])
    assert values(engine, "SELECT K.K FROM K WHERE K.K = 1 AND EXISTS (SELECT 1 FROM T K2 WHERE K2.V = K.K)") == [(1,)]
