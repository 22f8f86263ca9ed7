"""Operators on small literal frames: nulls, ties, empty input, duplicates."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.encoding import delta_decode, delta_encode, dictionary_encode, rle_decode, rle_encode
from tessera.functions.expressions import int_div
from tessera.functions.stats import column_stats, distinct_sketch, equi_depth_exact, selectivity
from tessera.functions.vectors import cosine, dot
from tessera.functions.visibility import ReadView, visible
from tessera.operators import joins, products
from tessera.operators import relational as rel
from tessera.plans.catalogue import QUERIES
from tessera.plans.logictest import parse, run
from tessera.plans.sql import SqlEngine
from tessera.sources.snapshots import SnapshotTable
from tessera.sources.tables import employees, read
from tessera.streaming import windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_division(spark):
    df = spark.createDataFrame([(7, 0), (-7, 2), (7, 2), (None, 0), (7, None)], "a bigint, b bigint")
    assert [r[0] for r in df.select(int_div(F.col("a"), F.col("b"))).collect()] == [0, -3, 3, 0, None]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 5), ("a", 9), ("b", -4), ("b", -2), (None, None)], "g string, v int")
    got = rel.aggregate(df, ["g"], {"mi": ("min", "v"), "ma": ("max", "v"), "n": ("count", "v"), "rows": ("count", "*")})
    assert rows(got) == [("a", 5, 9, 2, 2), ("b", -4, -2, 2, 2), (None, None, None, 0, 1)]
    none = rel.aggregate(df.where("false"), [], {"n": ("count", "*"), "s": ("sum", "v"), "av": ("avg", "v")})
    assert rows(none) == [(0, None, None)]
    assert rel.aggregate(df.where("false"), ["g"], {"n": ("count", "*")}).count() == 0
    with pytest.raises(ValueError):
        rel.aggregate(df, [], {"x": ("median", "v")})


def test_outer_joins(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "s")], "y int, v string")
    on = F.col("x") == F.col("y")
    for strategy in (None, "hash", "merge", "broadcast"):
        assert joins.join(a, b, on, "inner", strategy).count() == 4
        assert joins.join(a, b, on, "left", strategy).count() == 6
        assert joins.join(a, b, on, "right", strategy).count() == 6
        assert joins.join(a, b, on, "full", strategy).count() == 8
    assert joins.join(a, b, on, "inner", "nested_loop").count() == 4
    assert rows(joins.keep_in(a, "x", b, "y")) == [(1,), (1,)]


def test_window_ties(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (1, 20)], "p int, o int")
    assert sorted(r.r for r in rel.windowed(df, ["p"], ["o"], {"r": F.rank()}).collect()) == [1, 1, 3]


def test_rle(spark):
    df = spark.createDataFrame(list(enumerate([5, 5, 5, 7, 7, 5, None, None])), "i int, v int")
    runs = rle_encode(df, "v", "i")
    assert rows(runs) == [(0, 5, 3), (3, 7, 2), (5, 5, 1), (6, None, 2)]
    back = [r.val for r in rle_decode(runs).orderBy("run_start", "place").collect()]
    assert back == [5, 5, 5, 7, 7, 5, None, None]
    assert rle_encode(df.where("false"), "v", "i").count() == 0
    assert rle_encode(df.withColumn("g", F.lit(1)), "v", "i", ["g"]).count() == 4


def test_long_runs_are_decoded_in_chunks(spark, monkeypatch):
    from tessera.functions import encoding

    monkeypatch.setattr(encoding, "CHUNK", 7)
    runs = spark.createDataFrame([(0, "a", 20), (20, "b", 7), (27, None, 1), (28, "x", 0)], "run_start bigint, val string, cnt bigint")
    back = rows(rle_decode(runs).select((F.col("run_start") + F.col("place")).alias("n"), "val"))
    assert sorted(back) == [(n, "a" if n < 20 else "b" if n < 27 else None) for n in range(28)]


def test_delta(spark):
    df = spark.createDataFrame(list(enumerate([5, 5, 5, 7, 7, 5])), "i int, v int")
    out = delta_encode(df, "v", "i")
    assert [r.delta for r in out.orderBy("i").collect()] == [5, 0, 0, 2, 0, -2]
    seg = delta_encode(df.withColumn("g", F.lit(1)), "v", "i", ["g"])
    assert [r.value for r in delta_decode(seg, "delta", "i", ["g"]).orderBy("i").collect()] == [5, 5, 5, 7, 7, 5]
    assert delta_encode(df.where("false"), "v", "i").count() == 0


def test_order_over_many_ranges(spark):
    """More rows than the range bounds' sample looks at, extra columns and ties."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("i"), (F.col("id") * 7919 % 20_000 % 13).alias("v"), F.lit("x").alias("extra"))
    out = delta_encode(df, "v", "i")
    assert out.where("delta NOT IN (0, 1, -12)").count() == 0 and out.count() == 20_000
    assert rle_encode(df.withColumn("v", F.expr("i DIV 100")), "v", "i").where("cnt <> 100 OR run_start % 100 <> 0").count() == 0
    codes = dictionary_encode(df, "i")
    assert codes.where("code <> i").count() == 0


def test_broadcast_is_checked(spark, monkeypatch):
    a, b = spark.range(5).toDF("x"), spark.range(5).toDF("y")
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert "strategy=broadcast" not in joins.join(a, b, F.col("x") == F.col("y"), "inner", "broadcast")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1 << 20)
    assert "strategy=broadcast" in joins.join(a, b, F.col("x") == F.col("y"), "inner", "broadcast")._jdf.queryExecution().optimizedPlan().toString()


def test_dictionary(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None)], "i int, v string")
    assert rows(dictionary_encode(df, "v", "i").select("i", "code")) == [(0, 0), (1, 1), (2, 0), (3, None)]
    assert rows(dictionary_encode(df, "v").select("i", "code")) == [(0, 1), (1, 0), (2, 1), (3, None)]


def test_against(spark, monkeypatch):
    a, b = spark.range(50).select(F.col("id").alias("x")), spark.range(30).select(F.col("id").alias("y"))
    for limit in (0, 1 << 20):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
        assert rows(joins.against(a, b, block=7)) == rows(a.crossJoin(b))
        assert joins.against(a, b.where("false")).count() == 0


def test_above(spark, monkeypatch):
    """NULLs, NaN, signed zeros, ties, repeated rows and a hot key, as the plain join; pairs tell the number of tasks, not bytes."""
    nan = float("nan")
    odd = [None, nan, -0.0, 0.0, 1.5, 1.5, float("inf")]
    a = spark.createDataFrame([(i, None if i % 11 == 0 else max(0, i % 20 - 12), odd[i % 7] if i % 3 else i % 23 * 1.0) for i in [*range(300), 5, 5]], "x long, k int, v double")
    b = spark.createDataFrame([(i, None if i % 13 == 0 else max(0, i % 20 - 13), odd[i % 7] if i % 2 else i % 19 * 1.0) for i in [*range(200), 7, 7]], "y long, j long, w double")
    want = str(rows(a.join(b, (F.col("k") == F.col("j")) & (F.col("v") > F.col("w")))))  # NaN equals none
    for pairs, wide, keys in ((1 << 24, 1 << 16, 1 << 16), (1000, 1 << 16, 0), (300, 20, 0)):
        monkeypatch.setattr(joins, "PAIRS", pairs)
        monkeypatch.setattr(joins, "WIDE", wide)
        monkeypatch.setattr(joins, "KEYS", keys)
        got = joins.above(a, b, ("k", "j"), ("v", "w"), block=7)
        assert str(rows(got)) == want and got.count() > 3000
    assert got.rdd.getNumPartitions() > 10
    assert joins.above(a, b.where("false"), ("k", "j"), ("v", "w")).count() == 0
    monkeypatch.setattr(joins, "PAIRS", 100)
    assert QUERIES["join_residual"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_dots(spark, monkeypatch):
    """NULLs, other lengths, NaN, infinity and signed zeros, to the last bit as the expression; pairs tell the number of tasks."""
    def vector(i):
        if i % 9 == 8:
            return [None, [], [1.0, None, 2.0], [1.0, 2.0], [float("nan")] * 3, [float("inf"), 1.0, 0.0], [-0.0, 0.0, -0.0], [1e30, 1.0, -1e30]][i // 9 % 8]
        return [((i * k * 7919) % 1000 - 500) / 300 for k in (1, 2, 3)]

    a = spark.createDataFrame([(i, vector(i)) for i in [*range(300), 5, 5]] + [(None, vector(1))], "x long, v array<float>").repartition(3)
    b = spark.createDataFrame([(i, vector(i)) for i in [*range(120), 7, 7]], "y long, w array<float>")
    for left, right in ((a, b), (a.where("x % 9 < 8"), b.where("y % 9 < 8"))):
        want = rows(left.crossJoin(right).select("x", "y", dot(F.col("v"), F.col("w"))))
        for block, pairs, slab in ((2048, 1 << 22, 1 << 15), (16, 500, 64), (64, 4000, 7)):
            for name, n in (("BLOCK", block), ("PAIRS", pairs), ("SLAB", slab)):
                monkeypatch.setattr(products, name, n)
            got = products.dots(left, right)
            assert str(rows(got.select("b_id", "a_id", "dot"))) == str(want)  # NaN equals none
    assert products.dots(a, b.where("false")).count() == products.dots(a.where("false"), b).count() == 0
    monkeypatch.setattr(products, "PAIRS", 100)
    assert QUERIES["vector_dot"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_stats(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).alias("v"))
    s = column_stats(df, "v", exact=True).first()
    assert (s.rows, s.null_count, s.ndv, s.mi, s.ma) == (100, 0, 10, 0, 9)
    hist = [r.asDict() for r in equi_depth_exact(df, "v", "k", 7).orderBy("bucket").collect()]
    assert [b["cnt"] for b in hist] == [15, 15, 14, 14, 14, 14, 14]
    assert 0 < selectivity(hist, "=", 3) < 0.2 and selectivity(hist, "<", -1) == 0 and selectivity(hist, ">", 100) == 0
    assert 80 < distinct_sketch(df, "k").select(F.hll_sketch_estimate("sketch")).first()[0] < 120


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 5.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(dot(F.col("a"), F.col("b"))).collect()] == [2.0, 0.0, None]
    assert [None if r[0] is None else round(r[0], 4) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.3714, None, None]


def test_visibility(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, False), (2, 9, 0, False), (3, 5, 0, False), (4, 5, 7, True), (5, 0, 6, True), (6, 10, 0, False), (7, 10, 10, True), (8, 0, None, None)],
        "k int, _ins_txn int, _del_txn int, _deleted boolean",
    )
    # transaction 10; 7 and 9 were active
    seen = df.where(visible(ReadView(10, 10, {7, 9}))).select("k")
    assert rows(seen) == [(1,), (3,), (4,), (6,), (8,)]


def test_snapshots(spark, tmp_path):
    t = SnapshotTable.create(spark, f"{tmp_path}/users", spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, None)], "id int, name string"))
    assert t.update(F.col("id") == 2, {"name": "Rob"}) == 1
    assert t.delete(F.col("name") == "Alice") == 1
    assert t.insert(spark.createDataFrame([(4, "Dan")], "a int, b string")) == 1
    assert rows(t.read()) == [(2, "Rob"), (3, None), (4, "Dan")]
    assert rows(t.read(1)) == [(1, "Alice"), (2, "Bob"), (3, None)]
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(4,)], "a int"))
    with pytest.raises(ValueError):
        t.update(F.lit(True), {"nope": 1})
    assert t.vacuum() == [1, 2, 3] and t.versions() == [4]


def test_two_writers(spark, tmp_path):
    """Both read version 1; one publishes, the other fails whole and can try again."""
    table = SnapshotTable.create(spark, f"{tmp_path}/t", spark.createDataFrame([(1, "a")], "id int, name string"))
    other = SnapshotTable(spark, f"{tmp_path}/t")
    late = other._manifest()
    assert table.insert(spark.createDataFrame([(2, "b")], "id int, name string")) == 1
    other._manifest = lambda version=None: late
    with pytest.raises(RuntimeError):
        other.insert(spark.createDataFrame([(3, "c")], "id int, name string"))
    del other._manifest
    assert rows(table.read()) == [(1, "a"), (2, "b")] and other.insert(spark.createDataFrame([(3, "c")], "id int, name string")) == 1
    assert rows(table.read(2)) == [(1, "a"), (2, "b")] and rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")]
    assert table.vacuum() == [1, 2] and rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_writer_that_publishes_before_the_claim_is_seen(spark, tmp_path):
    """The other writer publishes after this one has written its rows and just before it claims the version."""
    table = SnapshotTable.create(spark, f"{tmp_path}/t", spark.createDataFrame([(1, "a")], "id int, name string"))
    other, files = SnapshotTable(spark, f"{tmp_path}/t"), table._fs

    class Late:
        def __getattr__(self, name):
            return getattr(files, name)

        def createNewFile(self, path):
            other.insert(spark.createDataFrame([(2, "b")], "id int, name string"))
            return files.createNewFile(path)

    table._fs = Late()
    with pytest.raises(RuntimeError):
        table.insert(spark.createDataFrame([(3, "c")], "id int, name string"))
    table._fs = files
    assert rows(table.read()) == [(1, "a"), (2, "b")] and table.insert(spark.createDataFrame([(3, "c")], "id int, name string")) == 1
    assert rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_sorted_table(spark, tmp_path):
    """Rows stay sorted through changes, which are counted once."""
    table = SnapshotTable.create(spark, f"{tmp_path}/t", spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(0).alias("v")))
    table.sort_by("K")
    assert table.insert(spark.createDataFrame([(5, 1), (-1, 1)], "k bigint, v int")) == 2
    assert table.update(F.col("k") < 10, {"V": 2}) == 12
    assert table.delete(F.col("k") >= 500) == 500
    assert table.read().count() == 502 and table.read().where("v = 2").count() == 12
    files = table.read().select(F.input_file_name().alias("f"), "k").groupBy("f").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(files, files[1:]))
    with pytest.raises(ValueError):
        table.sort_by("nope")


def test_engine(spark, tmp_path):
    db = SqlEngine(spark, f"{tmp_path}/db")
    for statement in ("CREATE TABLE Pets (id INT, name VARCHAR)", "INSERT INTO pets VALUES (1, 'a'), (2, 'b')", "insert into PETS (NAME, id) values ('c', 3)", "INSERT INTO Pets (id) SELECT 4", "UPDATE pets SET name = 'x WHERE y' WHERE id = 1", "UPDATE pets p SET p.name = upper(p.name) WHERE p.id IN (SELECT id FROM pets WHERE id = 2)"):
        db.execute(statement)
    want = [(1, "x WHERE y"), (2, "B"), (3, "c"), (4, None)]
    assert rows(db.execute("SELECT * FROM pets;")) == want
    again = SqlEngine(spark, f"{tmp_path}/db")  # tables outlive the engine
    assert rows(again.execute("SELECT * FROM PETS")) == want
    refused = ("CREATE TABLE pets (id INT)", "INSERT INTO nope VALUES (1)", "INSERT INTO pets VALUES (1)", "INSERT INTO pets (id, nope) VALUES (1, 2)", "INSERT INTO pets (id, ID) VALUES (1, 2)", "INSERT OVERWRITE pets VALUES (1, 'x')", "TRUNCATE TABLE pets", "BEGIN", "COMMIT", "ROLLBACK", "UPDATE pets SET nope = 1", "DELETE FROM nope", "DROP TABLE nope", "CREATE INDEX i ON pets (nope)", "WITH q AS (SELECT 7 AS id, 'w' AS name) INSERT INTO pets SELECT * FROM q")
    for statement in refused:
        with pytest.raises(Exception):  # noqa: B017
            again.execute(statement)
    assert rows(again.execute("SELECT * FROM pets")) == want and again.tables["pets"].versions() == db.tables["pets"].versions()
    assert [r.cnt for r in again.execute("DELETE FROM pets WHERE name IS NULL OR id IN (2, 3)").collect()] == [3]
    assert [r.cnt for r in again.execute("DELETE FROM pets").collect()] == [1] and again.execute("SELECT * FROM pets").count() == 0
    assert [r.cnt for r in again.execute("UPDATE pets SET id = 1").collect()] == [0]
    again.execute("DROP TABLE Pets")
    assert not SqlEngine(spark, f"{tmp_path}/db").tables


LOGIC = """
# users
statement ok
CREATE TABLE users (id INT, name VARCHAR)

statement error
CREATE TABLE users (id INT)

statement ok
INSERT INTO users VALUES (1, 'Alice'), (2, 'Bob'), (3, 'Alice');

statement error
INSERT INTO users VALUES (1)

query IT rowsort
SELECT name, COUNT(*) FROM users GROUP BY name
----
Alice
2
Bob
1

query T nosort
SELECT name FROM users WHERE id IN (SELECT MAX(id) FROM users)
----
Alice

statement ok
UPDATE users SET name = 'Zed, Jr' WHERE id = 2

statement ok
DELETE FROM users WHERE id = 1

query IT nosort
SELECT * FROM users ORDER BY id
----
2
Zed, Jr
3
Alice

query IT valuesort
SELECT * FROM users
----
2
3
Alice
Zed, Jr

statement error
SELECT * FROM missing

statement error
SELECT id FROM users GROUP name

statement ok
DROP TABLE users

halt

statement error
SELECT 1
"""


def test_logic_file(spark, tmp_path):
    (tmp_path / "a.test").write_text(LOGIC)
    assert len(parse(LOGIC)) == 13
    assert run(SqlEngine(spark, f"{tmp_path}/db"), tmp_path / "a.test") == []


@pytest.mark.parametrize(
    ("predicate", "count"),
    [
        ("id = 5000", 1),
        ("age > 40 AND department_id = 5", 714),
        ("salary + bonus > 100000", 10026),
        ("salary DIV 100 + bonus DIV 50 > 1000 AND age < 30", 1843),
        ("(salary * 2) DIV (bonus + 1) > 50 AND age >= 25 AND age <= 45 AND department_id < 10", 251),
        ("role = 'Role_555'", 20),
    ],
)
def test_benchmark_predicates(spark, predicate, count):
    assert employees(spark, 20_000, with_role=True).where(predicate).count() == count


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    for fmt in ("parquet", "orc", "json", "csv"):
        df.write.format(fmt).save(f"{tmp_path}/{fmt}")
        assert rows(read(spark, f"{tmp_path}/{fmt}", fmt, "id int, v string")) == rows(df)


def test_stream(spark, tmp_path):
    table = "/root/testdata/sf0.001/events.parquet"
    batch = windowed_counts(spark.read.parquet(table))
    spark.read.parquet(table).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{tmp_path}/in")
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("counts")) == rows(batch)
    finally:
        q.stop()
