"""Named queries over the test tables, each with the SQL that an independent engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.encoding import delta_decode, delta_encode, dictionary_encode, rle_decode, rle_encode
from tessera.functions.expressions import int_div, wide
from tessera.functions.ordering import numbered
from tessera.functions.stats import column_stats, distinct_sketch, equi_depth_exact, selectivity
from tessera.functions.visibility import ReadView, visible
from tessera.operators import joins
from tessera.operators import relational as rel
from tessera.operators.products import dots
from tessera.plans.sql import SqlEngine
from tessera.sources.scratch import fresh
from tessera.sources.snapshots import delete_rows, union_all, update_rows
from tessera.sources.tables import point_lookup, range_lookup, register, scan, values
from tessera.streaming import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = " ".join(sql.split())
        return f

    return add


c = F.col


@query("SELECT * FROM nation")
def scan_seq(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "nation")


@query("SELECT c_name, c_custkey FROM customer")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return rel.project(scan(spark, d, "customer"), "c_name", "c_custkey")


@query("SELECT * FROM (VALUES (1, 'Alice'), (2, 'Bob'), (3, 'Charlie')) AS users(id, name)")
def values_inline(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, [(1, "Alice"), (2, "Bob"), (3, "Charlie")], "id int, name string")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def filter_eq_int(spark: SparkSession, d: str) -> DataFrame:
    return point_lookup(scan(spark, d, "customer"), "c_custkey", 42)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq_varchar(spark: SparkSession, d: str) -> DataFrame:
    return building(spark, d)


def building(spark: SparkSession, d: str) -> DataFrame:
    return rel.keep(scan(spark, d, "customer"), c("c_mktsegment") == "BUILDING").select("c_custkey")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity <> 10 AS INT) AS ne, CAST(l_quantity < 10 AS INT) AS lt, CAST(l_quantity > 10 AS INT) AS gt,
          CAST(l_quantity <= 10 AS INT) AS le, CAST(l_quantity >= 10 AS INT) AS ge, CAST(l_quantity = 10 AS INT) AS eq FROM lineitem""")
def filter_compare_all(spark: SparkSession, d: str) -> DataFrame:
    q = c("l_quantity")
    tests = {"ne": q != 10, "lt": q < 10, "gt": q > 10, "le": q <= 10, "ge": q >= 10, "eq": q == 10}
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[t.cast("int").alias(n) for n, t in tests.items()])


@query("SELECT p_partkey FROM part WHERE (p_size > 40 AND p_retailprice < 1500) OR p_size = 1")
def filter_and_or(spark: SparkSession, d: str) -> DataFrame:
    return rel.keep(scan(spark, d, "part"), ((c("p_size") > 40) & (c("p_retailprice") < 1500)) | (c("p_size") == 1)).select("p_partkey")


def lines(spark: SparkSession, d: str, predicate: Column) -> DataFrame:
    return rel.keep(scan(spark, d, "lineitem"), predicate).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey + l_suppkey > 1000")
def filter_arith_q3(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d, c("l_partkey") + c("l_suppkey") > 1000)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey // 100) + (l_suppkey // 50) > 10 AND l_linenumber < 3")
def filter_arith_q4(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d, (int_div(c("l_partkey"), F.lit(100)) + int_div(c("l_suppkey"), F.lit(50)) > 10) & (c("l_linenumber") < 3))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((l_partkey * 2) // (l_suppkey + 1)) > 50 AND l_quantity >= 25 AND l_quantity <= 45
          AND l_linenumber < 5""")
def filter_arith_q5(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d, (int_div(c("l_partkey") * 2, c("l_suppkey") + 1) > 50) & (c("l_quantity") >= 25) & (c("l_quantity") <= 45) & (c("l_linenumber") < 5))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey // (l_linenumber - 1) END AS q FROM lineitem")
def arith_div_zero(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", int_div(wide(c("l_partkey")), wide(c("l_linenumber")) - 1).alias("q"))


MEASURES = {"cnt": ("count", "*"), "s": ("sum", "l_linenumber"), "mi": ("min", "l_partkey"), "ma": ("max", "l_partkey"), "av": ("avg", "l_linenumber")}


@query("""SELECT COUNT(*) AS cnt, COUNT(l_tax) AS cnt_tax, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_partkey) AS mi, MAX(l_partkey) AS ma,
          AVG(l_linenumber) AS av FROM lineitem""")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    return rel.aggregate(scan(spark, d, "lineitem"), [], MEASURES | {"cnt_tax": ("count", "l_tax")})


@query("SELECT COUNT(*) AS cnt, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_partkey) AS mi FROM lineitem WHERE l_orderkey = -1")
def agg_global_empty(spark: SparkSession, d: str) -> DataFrame:
    none = rel.keep(scan(spark, d, "lineitem"), c("l_orderkey") == -1)
    return rel.aggregate(none, [], {k: MEASURES[k] for k in ("cnt", "s", "mi")})


@query("SELECT l_returnflag, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag")
def agg_group_count(spark: SparkSession, d: str) -> DataFrame:
    return rel.aggregate(scan(spark, d, "lineitem"), ["l_returnflag"], {"cnt": ("count", "*")})


@query("""SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_partkey) AS mi, MAX(l_partkey) AS ma,
          AVG(l_linenumber) AS av FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_group_multi(spark: SparkSession, d: str) -> DataFrame:
    return rel.aggregate(scan(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], MEASURES)


@query("SELECT n_regionkey, MIN(n_name) AS mi, MAX(n_name) AS ma FROM nation GROUP BY n_regionkey")
def agg_min_max_varchar(spark: SparkSession, d: str) -> DataFrame:
    return rel.aggregate(scan(spark, d, "nation"), ["n_regionkey"], {"mi": ("min", "n_name"), "ma": ("max", "n_name")})


@query("SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) = 10")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    return rel.aggregate(scan(spark, d, "orders"), ["o_custkey"], {"cnt": ("count", "*")}, having=c("cnt") == 10)


@query("SELECT o_orderpriority, COUNT(*) AS cnt FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') AS t GROUP BY o_orderpriority")
def subquery_from(spark: SparkSession, d: str) -> DataFrame:
    return rel.aggregate(rel.keep(scan(spark, d, "orders"), c("o_orderstatus") == "O"), ["o_orderpriority"], {"cnt": ("count", "*")})


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def subquery_in(spark: SparkSession, d: str) -> DataFrame:
    return joins.keep_in(scan(spark, d, "orders"), "o_custkey", building(spark, d), "c_custkey").select("o_orderkey")


@query("""WITH b AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_orderstatus = 'F')
          SELECT o_custkey, COUNT(*) AS cnt FROM o WHERE o_custkey IN (SELECT c_custkey FROM b) GROUP BY o_custkey""")
def cte_multi(spark: SparkSession, d: str) -> DataFrame:
    final = rel.keep(scan(spark, d, "orders"), c("o_orderstatus") == "F")
    return rel.aggregate(joins.keep_in(final, "o_custkey", building(spark, d), "c_custkey"), ["o_custkey"], {"cnt": ("count", "*")})


def owner() -> Column:
    return c("c_custkey") == c("o_custkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return joins.join(scan(spark, d, "orders"), scan(spark, d, "customer"), owner()).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    return joins.join(scan(spark, d, "customer"), scan(spark, d, "orders"), owner(), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    return joins.join(scan(spark, d, "orders"), scan(spark, d, "customer"), owner(), "right").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 20")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    return joins.join(scan(spark, d, "customer"), scan(spark, d, "supplier"), c("c_custkey") == c("s_suppkey") * 20, "full").select("c_custkey", "s_suppkey")


def by_strategy(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return joins.join(scan(spark, d, "orders"), scan(spark, d, "customer"), owner(), "inner", strategy).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("cnt"))


BY_SEGMENT = "SELECT c_mktsegment, COUNT(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"


@query(BY_SEGMENT)
def join_shuffle_hash(spark: SparkSession, d: str) -> DataFrame:
    return by_strategy(spark, d, "hash")


@query(BY_SEGMENT)
def join_sort_merge(spark: SparkSession, d: str) -> DataFrame:
    return by_strategy(spark, d, "merge")


@query(BY_SEGMENT)
def join_broadcast_hash(spark: SparkSession, d: str) -> DataFrame:
    return by_strategy(spark, d, "broadcast")


@query("SELECT n_name, COUNT(*) AS cnt FROM nation JOIN supplier ON s_nationkey < n_nationkey GROUP BY n_name")
def join_nested_loop(spark: SparkSession, d: str) -> DataFrame:
    on = c("s_nationkey") < c("n_nationkey")
    return joins.join(scan(spark, d, "nation"), scan(spark, d, "supplier"), on, "inner", "nested_loop").groupBy("n_name").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal")
def join_residual(spark: SparkSession, d: str) -> DataFrame:
    customers = scan(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    suppliers = scan(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return joins.above(customers, suppliers, ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal")).select("c_custkey", "s_suppkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    return joins.cross(scan(spark, d, "nation"), scan(spark, d, "region")).select("n_name", "r_name")


@query("""SELECT n_name, COUNT(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def join_multiway_dp(spark: SparkSession, d: str) -> DataFrame:
    # Small filtered relations first: each join then meets as few rows as can be.
    asia = joins.join(scan(spark, d, "nation"), rel.keep(scan(spark, d, "region"), c("r_name") == "ASIA"), c("n_regionkey") == c("r_regionkey"))
    owners = joins.join(scan(spark, d, "customer"), asia, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")
    orders = joins.join(scan(spark, d, "orders"), owners, owner()).select("o_orderkey", "n_name")
    # only the key of the line items travels, and the join's runtime filter drops those of other orders before
    items = scan(spark, d, "lineitem").select("l_orderkey")
    return joins.join(items, orders, c("l_orderkey") == c("o_orderkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("cnt"))


@query("""SELECT c_custkey, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) AS rnk,
          CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer""")
def window_rank_rownum(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    # both run on the finer order, so one sort serves them: ties share the least row number
    ranked = rel.windowed(rows, ["c_nationkey"], [c("c_acctbal").desc(), c("c_custkey")], {"rn": F.row_number()})
    tied = rel.windowed(ranked, ["c_nationkey", "c_acctbal"], [], {"rnk": F.min("rn")})
    return tied.select("c_custkey", wide(c("rnk")).alias("rnk"), wide(c("rn")).alias("rn"))


@query("""SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS cnt, MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS mi,
          MAX(o_orderkey) OVER (PARTITION BY o_custkey) AS ma FROM orders""")
def window_agg_partition(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"cnt": F.count(F.lit(1)), "mi": F.min("o_orderkey"), "ma": F.max("o_orderkey")}
    return rel.windowed(scan(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], [], wanted).drop("o_custkey")


@query("""SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS run_sum,
          AVG(o_custkey) OVER (PARTITION BY o_orderstatus) AS av FROM orders""")
def window_agg_running(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    # three states hold all rows: their averages are aggregated and joined, not windowed in three tasks
    states = rel.aggregate(rows, ["o_orderstatus"], {"av": ("avg", "o_custkey")}).withColumnRenamed("o_orderstatus", "state")
    run = rel.windowed(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"run_sum": F.sum("o_orderkey")})
    return joins.join(run, states, c("o_orderstatus").eqNullSafe(c("state")), "left").select("o_orderkey", "run_sum", "av")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority ASC, o_orderkey DESC")
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return rel.ordered(scan(spark, d, "orders").select("o_orderkey", "o_orderpriority"), [("o_orderpriority", True), ("o_orderkey", False)])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_limit(spark: SparkSession, d: str) -> DataFrame:
    return rel.top(scan(spark, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)], 10)


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey = 42 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment
          FROM customer""")
def update_customers(spark: SparkSession, d: str) -> DataFrame:
    return update_rows(scan(spark, d, "customer"), c("c_custkey") == 42, {"c_mktsegment": "UPDATED"})


@query("SELECT * FROM customer WHERE NOT (c_nationkey = 5)")
def delete_customers(spark: SparkSession, d: str) -> DataFrame:
    return delete_rows(scan(spark, d, "customer"), c("c_nationkey") == 5)


@query("SELECT c_custkey, CAST(DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS seg_id FROM customer")
def dict_encode(spark: SparkSession, d: str) -> DataFrame:
    return dictionary_encode(scan(spark, d, "customer"), "c_mktsegment").select("c_custkey", c("code").cast("int").alias("seg_id"))


@query("""SELECT MIN(o_orderkey) AS grp_start, MIN(o_orderstatus) AS val, COUNT(*) AS cnt FROM (SELECT o_orderkey, o_orderstatus,
          ROW_NUMBER() OVER (ORDER BY o_orderkey) - ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g FROM orders) t
          GROUP BY o_orderstatus, g""")
def rle_runs(spark: SparkSession, d: str) -> DataFrame:
    return rle_encode(scan(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").withColumnRenamed("run_start", "grp_start")


@query("SELECT o_orderkey, o_custkey - COALESCE(LAG(o_custkey) OVER (ORDER BY o_orderkey), 0) AS delta FROM orders")
def delta_keys(spark: SparkSession, d: str) -> DataFrame:
    return delta_encode(scan(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "delta")


@query("""SELECT COUNT(*) - COUNT(c_acctbal) AS null_count, COUNT(DISTINCT c_acctbal) AS ndv, MIN(c_acctbal) AS mi, MAX(c_acctbal) AS ma
          FROM customer""")
def stats_column(spark: SparkSession, d: str) -> DataFrame:
    return column_stats(scan(spark, d, "customer"), "c_acctbal", exact=True).drop("rows")


@query("""SELECT bucket, MIN(c_acctbal) AS mi, MAX(c_acctbal) AS ma, COUNT(*) AS cnt, COUNT(DISTINCT c_acctbal) AS ndv
          FROM (SELECT c_acctbal, NTILE(8) OVER (ORDER BY c_acctbal, c_custkey) AS bucket FROM customer) t GROUP BY bucket""")
def stats_equidepth(spark: SparkSession, d: str) -> DataFrame:
    return equi_depth_exact(scan(spark, d, "customer"), "c_acctbal", "c_custkey", 8)


@query("""SELECT a.vec_id AS a_id, b.vec_id AS b_id, ROUND(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot
          FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0""")
def vector_dot(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, d, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select("vec_id", "embedding")
    pairs = dots(rows.select("vec_id", "embedding"), queries)
    return pairs.select("a_id", "b_id", (F.rint(c("dot") * 10000) / 10000).alias("dot"))  # keeps a zero's sign


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey")
def index_range(spark: SparkSession, d: str) -> DataFrame:
    return range_lookup(scan(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n, MAX(value) AS most FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(scan(spark, d, "events"), "1 hour").withColumn("window_start", c("window_start").cast("timestamp_ntz"))


@query("SELECT * FROM orders WHERE o_orderkey = 777")
def index_point(spark: SparkSession, d: str) -> DataFrame:
    return point_lookup(scan(spark, d, "orders"), "o_orderkey", 777)


@query("SELECT COUNT(*) AS cnt FROM lineitem WHERE l_partkey + l_suppkey > 1000 AND l_quantity < 30")
def predicate_count(spark: SparkSession, d: str) -> DataFrame:
    return rel.aggregate(rel.keep(scan(spark, d, "lineitem"), (c("l_partkey") + c("l_suppkey") > 1000) & (c("l_quantity") < 30)), [], {"cnt": ("count", "*")})


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (90, 'NORTH'), (91, 'SOUTH')) v")
def insert_values(spark: SparkSession, d: str) -> DataFrame:
    return union_all([scan(spark, d, "region"), values(spark, [(90, "NORTH"), (91, "SOUTH")], "r_regionkey int, r_name string")])


@query("""WITH f AS (SELECT p_type, MIN(p_partkey) AS m FROM part GROUP BY p_type) SELECT p_partkey, code
          FROM part JOIN (SELECT p_type, ROW_NUMBER() OVER (ORDER BY m) - 1 AS code FROM f) k USING (p_type)""")
def dict_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return dictionary_encode(scan(spark, d, "part"), "p_type", "p_partkey").select("p_partkey", wide(c("code")).alias("code"))


@query("""SELECT MIN(p_partkey) AS mi, p_size FROM part GROUP BY p_size HAVING MIN(p_partkey) < 100""")
def agg_having_min(spark: SparkSession, d: str) -> DataFrame:
    return rel.aggregate(scan(spark, d, "part"), ["p_size"], {"mi": ("min", "p_partkey")}, having=c("mi") < 100)


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, o_orderkey % 12 AS i, o_custkey % 12 AS x, o_orderstatus = 'F' AS gone FROM orders) v
          WHERE (i = 10 OR i = 0 OR (i < 10 AND i NOT IN (3, 7))) AND NOT (gone AND (x = 10 OR x = 0 OR (x < 10 AND x NOT IN (3, 7))))""")
def mvcc_visible(spark: SparkSession, d: str) -> DataFrame:
    versions = scan(spark, d, "orders").select("o_orderkey", (c("o_orderkey") % 12).alias("_ins_txn"), (c("o_custkey") % 12).alias("_del_txn"), (c("o_orderstatus") == "F").alias("_deleted"))
    return rel.keep(versions, visible(ReadView(me=10, limit=10, active={3, 7}))).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def rle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Runs decoded again; a row's number is that of its run's start on."""
    rows = numbered(scan(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    back = rle_decode(rle_encode(rows.select(c("__n").alias("n"), "o_orderstatus"), "o_orderstatus", "n"))
    keys = rows.select(c("__n").alias("n"), "o_orderkey")
    return joins.join(back, keys, c("run_start") + c("place") == c("n")).select("o_orderkey", c("val").alias("o_orderstatus"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def delta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    deltas = delta_encode(scan(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "delta")
    return delta_decode(deltas, "delta", "o_orderkey").select("o_orderkey", c("value").alias("o_custkey"))


@query("SELECT COUNT(DISTINCT l_partkey) AS ndv, TRUE AS close FROM lineitem")
def stats_hll(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's estimate lies within 5 %, three standard errors, of the count."""
    rows = scan(spark, d, "lineitem")
    exact = rows.agg(F.count_distinct("l_partkey").alias("ndv"))
    estimate = distinct_sketch(rows, "l_partkey").select(F.hll_sketch_estimate("sketch").alias("estimate"))
    return joins.cross(exact, estimate).select("ndv", (F.abs(c("estimate") - c("ndv")) <= 0.05 * c("ndv")).alias("close"))


@query("SELECT op, TRUE AS close FROM (VALUES ('<'), ('='), ('>')) t(op)")
def stats_selectivity(spark: SparkSession, d: str) -> DataFrame:
    """Shares estimated from 16 buckets lie within one bucket of the true ones."""
    rows = scan(spark, d, "customer")
    buckets = [r.asDict() for r in equi_depth_exact(rows, "c_acctbal", "c_custkey", 16).collect()]
    value, x = 2500.0, c("c_acctbal")
    true = {"<": x < value, "=": x == value, ">": x > value}
    near = [F.struct(F.lit(op).alias("op"), (F.abs(F.avg(t.cast("int")) - selectivity(buckets, op, value)) <= 1 / 16).alias("close")) for op, t in true.items()]
    return rows.agg(F.array(*near).alias("r")).select(F.inline("r"))


def engine(spark: SparkSession, d: str) -> SqlEngine:
    """An engine of its own in the shared folder, which sees the tables as views."""
    register(spark, d)
    return SqlEngine(spark, fresh(spark, "sql"))


@query("""SELECT c_mktsegment, COUNT(*) AS cnt, MAX(o_totalprice) AS most FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
          WHERE o_orderstatus = 'F' AND c_acctbal > 0 GROUP BY c_mktsegment HAVING COUNT(*) > 1""")
def sql_select(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).execute(ORACLE["sql_select"])


SPECIMEN = "CREATE TABLE sql_customer (k BIGINT, segment VARCHAR, nation INT)", "INSERT INTO SQL_CUSTOMER (Segment, K, nation) SELECT c_mktsegment, c_custkey, c_nationkey FROM customer"


def after(spark: SparkSession, d: str, *statements: str) -> DataFrame:
    """The table of SPECIMEN after the statements."""
    db = engine(spark, d)
    for statement in (*SPECIMEN, *statements):
        db.execute(statement)
    return db.execute("SELECT * FROM sql_customer")


@query("SELECT c_custkey AS k, c_mktsegment AS segment, c_nationkey AS nation FROM customer UNION ALL SELECT * FROM (VALUES (-1, 'a, (b)', NULL), (-2, NULL, 3)) v")
def sql_insert_select(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d, "INSERT INTO sql_customer VALUES (-1, 'a, (b)', NULL)", "insert into sql_customer (nation, k) values (3, -2)")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'a WHERE b' ELSE c_mktsegment END AS segment,
          c_nationkey AS nation FROM customer""")
def sql_update(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d, "UPDATE sql_customer u SET segment = 'a WHERE b' WHERE u.k IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")


@query("SELECT c_custkey AS k, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE NOT (c_nationkey < 9 OR c_mktsegment = 'BUILDING')")
def sql_delete(spark: SparkSession, d: str) -> DataFrame:
    return after(spark, d, "DELETE FROM sql_customer WHERE nation < 9 OR segment = 'BUILDING'")


@query("SELECT c_custkey AS k, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_custkey = 42")
def sql_index_point(spark: SparkSession, d: str) -> DataFrame:
    """Rows sorted on write: the lookup's predicate skips all files and row groups but one range."""
    return point_lookup(after(spark, d, "CREATE INDEX by_key ON sql_customer (k)"), "k", 42)


QUERIES |= {"update_rows": QUERIES.pop("update_customers"), "delete_rows": QUERIES.pop("delete_customers"), "delta_encode": QUERIES.pop("delta_keys")}
ORACLE |= {"update_rows": ORACLE.pop("update_customers"), "delete_rows": ORACLE.pop("delete_customers"), "delta_encode": ORACLE.pop("delta_keys")}


def segment_orders(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: finished orders by market segment, counted and averaged."""
    orders = rel.keep(scan(spark, d, "orders"), c("o_orderstatus") == "F").select("o_custkey", "o_totalprice")
    owned = joins.join(orders, scan(spark, d, "customer").select("c_custkey", "c_mktsegment"), owner())
    return owned.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))
