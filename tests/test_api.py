import pytest

from quernlight import functions as Q
from quernlight.engine import Cancel
from quernlight.plans.syntax import DialectError
from quernlight.sources import loaders
from quernlight.streaming import ingest

DATA = [
    {"id": 1, "city": "Oslo", "age": 51, "spend": 12},
    {"id": 2, "city": "Oslo", "age": 16, "spend": 7},
    {"id": 3, "city": "Lima", "age": 33, "spend": 90},
    {"id": 4, "city": "Lima", "age": 28, "spend": 41},
    {"id": 5, "city": "Bern", "age": 64, "spend": 5},
]


@pytest.fixture
def df(engine):
    return engine.create_dataframe(DATA)


def ids(frame):
    return [r["id"] for r in frame.collect()]


def test_steps(df):
    assert df.select("id", Q.col("age").alias("years")).collect()[0] == {"id": 1, "years": 51}
    assert ids(df.filter(Q.col("age") >= 18).select("id").order_by("id")) == [1, 3, 4, 5]
    assert ids(df.where("city = 'Oslo' AND age > 18")) == [1]
    assert df.with_column("AGE", Q.col("age").add(1)).columns() == ["id", "city", "AGE", "spend"]
    assert df.drop("SPEND", "age").columns() == ["id", "city"]
    assert ids(df.order_by("age").order_by(Q.col("age").desc()).limit(2)) == [5, 1]
    assert ids(df.order_by("id").limit(2, 1)) == [2, 3]
    assert df.count() == 5 and "Oslo" in df.show(2)
    with pytest.raises(DialectError):
        df.drop("nothing")
    with pytest.raises(TypeError):
        df.filter(Q.col("age").add(1))


def test_group_and_aggregate(df):
    made = df.group_by("city").agg(Q.sum("spend").alias("total"), Q.count_star(), Q.avg("age"), Q.min("age"), Q.max("age"), Q.count("id", distinct=True).alias("n")).order_by("city")
    names = ("city", "total", "count_star", "avg", "min", "max", "n")
    assert made.collect() == [dict(zip(names, r)) for r in (("Bern", 5, 1, 64.0, 64, 64, 1), ("Lima", 131, 2, 30.5, 28, 33, 2), ("Oslo", 19, 2, 33.5, 16, 51, 2))]
    assert df.group_by().agg(Q.sum("spend").alias("s")).collect() == [{"s": 155}]


def test_union_is_a_set_and_checks_types(df, engine):
    assert df.union(df).count() == 5 and df.union_all(df).count() == 10
    with pytest.raises(TypeError):
        df.select("id").union(df.select("city"))
    with pytest.raises(TypeError):
        df.union(df.select("id"))


def test_join_keeps_keys_from_either_side(engine):
    a = engine.create_dataframe([{"k": 1, "v": "a"}, {"k": 2, "v": "b"}, {"k": None, "v": "n"}])
    b = engine.create_dataframe([{"K": 2, "v": "x"}, {"K": 3, "v": "y"}])
    assert sorted(map(repr, a.join(b, "k", "full").collect())) == sorted(map(repr, [{"k": 1, "v": "a", "v_1": None}, {"k": 2, "v": "b", "v_1": "x"}, {"k": None, "v": "n", "v_1": None}, {"k": 3, "v": None, "v_1": "y"}]))
    assert a.join(b, ["k"], "right").order_by("k").collect() == [{"k": 2, "v": "b", "v_1": "x"}, {"k": 3, "v": None, "v_1": "y"}]
    assert a.join(b, "k", "semi").collect() == [{"k": 2, "v": "b"}]


def test_self_sql_and_frames_of_sql(df, engine):
    assert df.filter("age > 18").sql("SELECT COUNT(*) AS n FROM self").collect() == [{"n": 4}]


def test_chunks_and_stream(df, engine):
    engine.register_table("people", DATA)
    assert [len(c) for c in engine.stream("SELECT id FROM people", size=3)] == [3, 2]
    assert next(iter(engine.stream("SELECT id FROM people", size=1))) and [len(c) for c in df.chunks(2)] == [2, 2, 1]


def test_types_from_values(engine):
    columns = engine.register_table("mixed", [{"a": 1, "b": 1, "c": True, "d": None}, {"a": 2**40, "b": 1.5, "c": "x", "d": None, "e": 1}])
    assert [(c.name, c.type) for c in columns] == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "string"), ("e", "int")]
    columns = engine.register_table("declared", [{"p": 10.505, "t": "2020-01-31"}], [("p", "DECIMAL(9,4)"), ("t", "DATE")])
    assert [c.type for c in columns] == ["decimal", "date"]


def test_statements(engine):
    engine.register_table("t", [{"k": 1}, {"k": 2}])
    engine.run("CREATE TABLE copy AS SELECT k, k + 1 AS n FROM t")
    assert engine.run("SELECT SUM(n) AS s FROM copy").rows == [{"s": 5}]
    with pytest.raises(DialectError):
        engine.run("CREATE TABLE copy (a INT)")
    with pytest.raises(DialectError):
        engine.run("CREATE TABLE twice AS SELECT k, k FROM t")
    engine.run("CREATE TABLE empty_ AS SELECT k FROM t WHERE k > 5")
    assert engine.run("SELECT * FROM empty_").columns == ["k"]
    version = engine.catalog.version
    engine.run("DROP TABLE copy")
    assert engine.catalog.version > version and "copy" not in engine.catalog
    with pytest.raises(DialectError):
        engine.run("DROP TABLE copy")


def test_explain(engine):
    engine.register_table("t", [{"k": 1}, {"k": 2}])
    assert "Physical Plan" in engine.run("EXPLAIN SELECT * FROM t").rows[0]["EXPLAIN_PLAN"]
    assert "Rows Returned: 2" in engine.run("EXPLAIN ANALYZE SELECT * FROM t").rows[0]["EXPLAIN_ANALYZE"]


def test_functions_and_cancelling(engine):
    engine.register_table("t", [{"k": 1}, {"k": None}])
    engine.register_function("PLUS", lambda a, b: None if a is None else a + b, "BIGINT", 2)
    assert [r["n"] for r in engine.run("SELECT PLUS(k, 2) AS n FROM t ORDER BY n").rows] == [3, None]
    with pytest.raises(DialectError):
        engine.run("SELECT PLUS(k) FROM t")
    cancel = Cancel()
    cancel.cancel()
    with pytest.raises(DialectError):
        engine.run("SELECT 1", signal=cancel)


def test_files(engine, tmp_path):
    (tmp_path / "people.csv").write_text('id,name,score,ok,day\n1,"a, b",1.5,true,2020-01-01\n2,,x,false,\n,c,3,,\n')
    (tmp_path / "items.json").write_text('[{"a": 1, "b": "x"}, {"a": null, "c": 2.5}]')
    (tmp_path / "more.txt").write_text("x")
    assert engine.load(str(tmp_path / "people.csv")) == "people"
    rows = engine.run("SELECT * FROM people ORDER BY id").rows
    assert rows[0] == {"id": 1, "name": "a, b", "score": "1.5", "ok": True, "day": "2020-01-01"} and rows[2]["id"] is None
    engine.load(str(tmp_path / "items.json"))
    assert engine.run("SELECT a, b, c FROM items ORDER BY a").rows == [{"a": 1, "b": "x", "c": None}, {"a": None, "b": None, "c": 2.5}]
    with pytest.raises(ValueError):
        engine.load(str(tmp_path / "more.txt"))
    engine.load(str(tmp_path / "people.csv"), "odd", partition=(1, 2))
    assert [r["id"] for r in engine.run("SELECT id FROM odd").rows] == [2]


def test_csv_parts_and_line_breaks(engine, spark, tmp_path):
    (tmp_path / "rows").mkdir()
    for k in range(3):
        (tmp_path / "rows" / f"part{k}.csv").write_text("n,t\n" + "".join(f"{100 * k + i},x\n" for i in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        parts = [[r["n"] for r in loaders.csv(spark, str(tmp_path / "rows"), partition=(i, 3)).collect()] for i in range(3)]
        whole = [r["n"] for r in loaders.csv(spark, str(tmp_path / "rows")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = [100 * k + i for k in range(3) for i in range(40)]
    assert sorted(whole) == order and [sorted(p) for p in parts] == [order[i::3] for i in range(3)]
    (tmp_path / "broken.csv").write_text('a,b\n1,"two\nlines"\n2,"a ""quoted"" word"\n3,plain\n')
    engine.load(str(tmp_path / "broken.csv"))
    assert [r["b"] for r in engine.run("SELECT b FROM broken ORDER BY a").rows] == ["two\nlines", 'a "quoted" word', "plain"]


def test_batches_are_written_out(engine, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_HELD", 3)
    batches = ([{"k": i, "v": i if i < 6 else i + 0.5}] for i in range(10))
    engine.register_batches("b", iter([*batches, [], [{"k": 2**40, "w": "late"}]]))
    rows = engine.run("SELECT k, v, w FROM b ORDER BY k").rows
    assert [r["k"] for r in rows] == [*range(10), 2**40] and [r["v"] for r in rows] == [*map(float, range(6)), 6.5, 7.5, 8.5, 9.5, None] and [r["w"] for r in rows] == [None] * 10 + ["late"]


def test_batches_of_files(spark, tmp_path):
    from quernlight.streaming.ingest import on_files

    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    on_files(spark, str(tmp_path / "in"), "id long", lambda df, n: seen.append(df.count()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sum(seen) == 10


def test_prompt(engine, tmp_path, capsys):
    from quernlight.cli import main

    (tmp_path / "t.csv").write_text("k,v\n1,a\n2,\n")
    assert main([str(tmp_path / "t.csv")], engine, iter(["SELECT k, v", "FROM t ORDER BY k;", ".tables", ".exit", "SELECT x;"])) == 0
    assert "k | v\n- | ----\n1 | a\n2 | NULL\n(2 rows)" in capsys.readouterr().out
    assert main(["-e", "SELECT nothing FROM t"], engine) == 1
    assert main(["-e", "EXPLAIN SELECT 1 AS x"], engine) == 0 and "Physical Plan" in capsys.readouterr().out
