"""The registered relational queries: statements of the dialect, operators and storage, and DuckDB SQL for the same rows.

Sums of doubles are rounded to cents on both sides, as the order of a parallel sum shows in the last bits.
"""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational as ops
from millrace.plans.standard import standard_statistics
from millrace.session import Engine
from millrace.sources import files
from millrace.sources.catalog import TableInfo, columns_of
from millrace.sources.tables import Store, read_delimited, write_delimited
from millrace.streaming.load import load_continuously

# The tables' columns.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
TABLES = list(SCHEMAS)
FLAGSHIP = "group_by_join"

#: name -> statement
STATEMENTS = {
    "scan_filter_eq_str": "SELECT r.r_regionkey, r.r_name FROM region AS r WHERE (r.r_name = 'EUROPE')",
    "scan_filter_lt": "SELECT s.s_suppkey, s.s_name FROM supplier AS s WHERE (s.s_suppkey < 10)",
    "scan_filter_str_range": "SELECT n.n_nationkey, n.n_name FROM nation AS n WHERE (n.n_regionkey = 3) AND (n.n_nationkey > 10) AND (n.n_name > 'NATION_15')",
    "scan_filter_conj": "SELECT c.c_custkey, c.c_acctbal FROM customer AS c WHERE (c.c_nationkey = 23) AND (c.c_mktsegment = 'FURNITURE') AND (c.c_acctbal > 1000.0) AND (c.c_acctbal < 9000.0)",
    "scan_filter_or": "SELECT l.l_orderkey, l.l_linenumber FROM lineitem AS l WHERE (l.l_returnflag = 'R' OR l.l_discount < 0.03) AND (l.l_quantity < 3.0)",
    "scan_filter_literal_left": "SELECT s.s_suppkey FROM supplier AS s WHERE (10 > s.s_suppkey)",
    "scan_filter_att_att": "SELECT l.l_orderkey, l.l_linenumber FROM lineitem AS l WHERE (l.l_tax > l.l_discount)",
    "join_equi_2way": "SELECT s.s_name, n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey)",
    "join_string_key": "SELECT p1.p_partkey, p2.p_partkey AS p2key FROM part AS p1, part AS p2 WHERE (p1.p_name = p2.p_name) AND (p1.p_size = 1) AND (p2.p_size = 2)",
    "join_4way": "SELECT c.c_name, n.n_name, r.r_name FROM customer AS c, orders AS o, nation AS n, region AS r WHERE (c.c_custkey = o.o_custkey) AND (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey) AND (r.r_name = 'ASIA') AND (o.o_totalprice < 50000.0)",
    "join_self_alias": "SELECT n1.n_name AS a, n2.n_name AS b FROM nation AS n1, nation AS n2 WHERE (n1.n_regionkey = n2.n_regionkey) AND (n1.n_nationkey < n2.n_nationkey)",
    "join_cycle": "SELECT SUM(l.l_extendedprice * (1 - l.l_discount)) FROM customer AS c, orders AS o, lineitem AS l, supplier AS s WHERE (c.c_custkey = o.o_custkey) AND (l.l_orderkey = o.o_orderkey) AND (l.l_suppkey = s.s_suppkey) AND (c.c_nationkey = s.s_nationkey)",
    "join_residual_or": "SELECT s.s_name, n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey) AND (s.s_acctbal > 5000.0 OR n.n_name = 'NATION_3')",
    "join_theta": "SELECT s.s_suppkey, n.n_nationkey FROM supplier AS s, nation AS n WHERE (s.s_nationkey < n.n_nationkey)",
    "join_eq_or_eq": "SELECT s.s_suppkey, n.n_nationkey FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey OR s.s_nationkey = n.n_regionkey)",
    "cross_residual_or": "SELECT r.r_name, n.n_name FROM region AS r, nation AS n WHERE (r.r_name = 'ASIA' OR n.n_nationkey = 7)",
    "sum_double": "SELECT SUM(l.l_extendedprice * l.l_discount) FROM lineitem AS l WHERE (l.l_quantity < 24.0)",
    "sum_int": "SELECT SUM(l.l_linenumber) FROM lineitem AS l WHERE (l.l_quantity < 24.0)",
    "sum_int_div": "SELECT SUM(n.n_nationkey / 2) FROM nation AS n WHERE (n.n_nationkey > 3)",
    "sum_unary_minus": "SELECT SUM(-(s.s_acctbal)) FROM supplier AS s WHERE (s.s_suppkey > 3)",
    "sum_empty_zero": "SELECT SUM(s.s_acctbal) FROM supplier AS s WHERE (s.s_suppkey < 0)",
    "sum_distinct": "SELECT SUM DISTINCT (l.l_quantity) FROM lineitem AS l WHERE (l.l_orderkey > 100)",
    "group_by_1": "SELECT SUM(l.l_quantity), l.l_returnflag FROM lineitem AS l WHERE (l.l_quantity > 0.0) GROUP BY l.l_returnflag",
    "group_by_2": "SELECT SUM(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)), l.l_returnflag, l.l_linestatus FROM lineitem AS l WHERE (l.l_shipdate < '1998-09-02') GROUP BY l.l_returnflag, l.l_linestatus",
    "group_by_hidden_key": "SELECT SUM(o.o_totalprice) FROM orders AS o WHERE (o.o_totalprice > 0.0) GROUP BY o.o_orderstatus",
    "group_by_join": "SELECT SUM(l.l_extendedprice * (1 - l.l_discount)), n.n_name FROM lineitem AS l, supplier AS s, nation AS n WHERE (l.l_suppkey = s.s_suppkey) AND (s.s_nationkey = n.n_nationkey) GROUP BY n.n_name",
    "group_by_sum_distinct": "SELECT SUM DISTINCT (l.l_quantity), l.l_returnflag FROM lineitem AS l WHERE (l.l_orderkey < 200) GROUP BY l.l_returnflag",
    "distinct_1": "SELECT DISTINCT c.c_mktsegment FROM customer AS c WHERE (c.c_custkey > 0)",
    "distinct_2": "SELECT DISTINCT l.l_returnflag, l.l_linestatus FROM lineitem AS l WHERE (l.l_orderkey > 0)",
    "distinct_join": "SELECT DISTINCT r.r_name, p.p_brand FROM region AS r, nation AS n, supplier AS s, lineitem AS l, part AS p WHERE (r.r_regionkey = n.n_regionkey) AND (n.n_nationkey = s.s_nationkey) AND (s.s_suppkey = l.l_suppkey) AND (l.l_partkey = p.p_partkey) AND (p.p_size < 3)",
    "sum_double_div": "SELECT SUM(l.l_extendedprice / l.l_quantity) FROM lineitem AS l WHERE (l.l_quantity > 0.0)",
    "no_where": "SELECT r.r_regionkey, r.r_name FROM region AS r",
    "cross_product": "SELECT r.r_name, n.n_name FROM region AS r, nation AS n",
    "join_empty_input": "SELECT s.s_name, n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey) AND (n.n_nationkey > 1000)",
    "point_lookup": "SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus FROM orders AS o WHERE (o.o_orderkey = 77)",
}

#: What DuckDB needs in place of the statement's own head: sums named, typed and rounded.
HEADS = {
    "join_cycle": 'SELECT ROUND(COALESCE(SUM(l.l_extendedprice * (1 - l.l_discount)), 0.0), 2) AS "sum"',
    "sum_double": 'SELECT ROUND(COALESCE(SUM(l.l_extendedprice * l.l_discount), 0.0), 2) AS "sum"',
    "sum_int": 'SELECT CAST(COALESCE(SUM(l.l_linenumber), 0) AS BIGINT) AS "sum"',
    "sum_int_div": 'SELECT CAST(COALESCE(SUM(n.n_nationkey // 2), 0) AS BIGINT) AS "sum"',
    "sum_double_div": 'SELECT ROUND(COALESCE(SUM(l.l_extendedprice / l.l_quantity), 0.0), 2) AS "sum"',
    "sum_unary_minus": 'SELECT ROUND(COALESCE(SUM(-(s.s_acctbal)), 0.0), 2) AS "sum"',
    "sum_empty_zero": 'SELECT ROUND(COALESCE(SUM(s.s_acctbal), 0.0), 2) AS "sum"',
    "sum_distinct": 'SELECT ROUND(COALESCE(SUM(DISTINCT l.l_quantity), 0.0), 2) AS "sum"',
    "group_by_1": 'SELECT ROUND(SUM(l.l_quantity), 2) AS "sum", l.l_returnflag',
    "group_by_2": 'SELECT ROUND(SUM(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)), 2) AS "sum", l.l_returnflag, l.l_linestatus',
    "group_by_hidden_key": 'SELECT ROUND(SUM(o.o_totalprice), 2) AS "sum"',
    "group_by_join": 'SELECT ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS "sum", n.n_name',
    "group_by_sum_distinct": 'SELECT ROUND(SUM(DISTINCT l.l_quantity), 2) AS "sum", l.l_returnflag',
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a suite query over the tables of sf_dir."""
    engine = Engine(spark)
    text = STATEMENTS[name]
    engine.register_folder(sf_dir, [t for t in TABLES if f" {t} AS " in text], SCHEMAS)
    frame = engine.sql(text)
    if frame.columns[0] == "sum" and dict(frame.dtypes)["sum"] == "double":
        frame = frame.withColumn("sum", F.round("sum", 2))
    return frame


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sort_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, by price and key, largest first."""
    return ops.project(ops.sort(_frame(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], ascending=False), ["o_orderkey", "o_totalprice"])


def project_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.project(_frame(spark, sf_dir, "lineitem"), ["l_linestatus", "l_returnflag"])


def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as bar-delimited text and read back."""
    folder, customers = _scratch(spark, "delimited"), _frame(spark, sf_dir, "customer")
    write_delimited(customers, folder)
    return read_delimited(spark, folder, customers.schema)


def heap_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers loaded into a heap from text, twice, and scanned."""
    folder, suppliers, store = _scratch(spark, "heap"), _frame(spark, sf_dir, "supplier"), Store(spark)
    write_delimited(suppliers, f"{folder}/text")
    heap = TableInfo("supplier", columns_of(suppliers.schema), f"{folder}/heap.parquet")
    store.create(heap)
    store.load(heap, f"{folder}/text")
    store.load(heap, f"{folder}/text")
    return ops.select_pipe(store.scan(heap), "(s_nationkey < 12)")


def sorted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts merged into a table sorted on size and brand, and those of one size found by its key."""
    folder, parts, store = _scratch(spark, "sorted"), _frame(spark, sf_dir, "part"), Store(spark)
    table = TableInfo("part", columns_of(parts.schema), f"{folder}/part.parquet", ("p_size", "p_brand"))
    store.create(table)
    store.append(table, parts.where("p_partkey % 2 = 0"))
    store.append(table, parts.where("p_partkey % 2 = 1"))
    return ops.select_pipe(store.scan(table), "(p_size = 7)").select("p_partkey", "p_name", "p_brand")


def _numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place."""
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id())


def heap_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in the order in which a folder of three files and then a file came into a heap."""
    folder, nations, store = _scratch(spark, "heap-order"), _frame(spark, sf_dir, "nation"), Store(spark)
    for k in range(3):
        write_delimited(nations.where(f"n_regionkey = {k}").coalesce(1).sortWithinPartitions(F.desc("n_nationkey")), f"{folder}/text/{k}")
    write_delimited(nations.where("n_regionkey > 2").coalesce(1).sortWithinPartitions("n_nationkey"), f"{folder}/more")
    heap = TableInfo("nation", columns_of(nations.schema), f"{folder}/heap.parquet")
    store.create(heap)
    store.load(heap, f"{folder}/text/*")
    store.load(heap, f"{folder}/more")
    return _numbered(store.scan(heap, ordered=True)).select("place", "n_nationkey")


def sorted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in the order of the keys of a sorted table, loaded three times and then compacted."""
    folder, suppliers, store = _scratch(spark, "sorted-scan"), _frame(spark, sf_dir, "supplier"), Store(spark)
    table = TableInfo("supplier", columns_of(suppliers.schema), f"{folder}/supplier.parquet", ("s_nationkey", "s_suppkey"))
    store.create(table)
    for k in range(3):
        store.append(table, suppliers.where(f"s_suppkey % 3 = {k}"))
    merged = replace(table, path=store.compacted(table))
    return _numbered(store.scan(merged, ordered=True)).select("place", "s_nationkey", "s_suppkey")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made, filled from text and dropped by statements, and a SELECT over those that are left."""
    folder, engine = _scratch(spark, "statements"), None
    for name in ("region", "nation"):
        write_delimited(_frame(spark, sf_dir, name), f"{folder}/{name}.tbl")
    engine = Engine(spark, f"{folder}/db", out=io.StringIO())
    for text in (
        "CREATE TABLE r (k INTEGER, name STRING) AS HEAP;",
        "CREATE TABLE n (k INTEGER, name STRING, r INTEGER) AS SORTED ON r, k;",
        "CREATE TABLE gone (k INTEGER) AS HEAP;",
        f"INSERT '{folder}/region.tbl' INTO r;",
        f"INSERT '{folder}/nation.tbl' INTO n;",
        f"INSERT '{folder}/nation.tbl' INTO n;",
        "DROP TABLE gone;",
        "SET OUTPUT NONE;",
    ):
        engine.run(text)
    again = Engine(spark, f"{folder}/db")
    assert sorted(again.catalog.tables) == ["n", "r"]
    return again.sql("SELECT SUM(n.k), r.name FROM n AS n, r AS r WHERE (n.r = r.k) GROUP BY r.name")


def output_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SET OUTPUT leaves in a file that two SELECTs wrote: the rows of the second."""
    folder, engine = _scratch(spark, "output"), Engine(spark, out=io.StringIO())
    engine.register_folder(sf_dir, ["region", "nation"], SCHEMAS)
    for text in (f"SET OUTPUT '{folder}';", "SELECT n.n_name FROM nation AS n", "SELECT r.r_regionkey, r.r_name FROM region AS r WHERE (r.r_regionkey > 1)"):
        engine.run(text)
    return spark.read.text(folder)


def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that arrive as text files, loaded into a heap as a stream, and one batch of them tried again."""
    folder, parts = _scratch(spark, "stream"), _frame(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    engine = Engine(spark, f"{folder}/db", out=io.StringIO())
    engine.run("CREATE TABLE p (p_partkey INTEGER, p_name STRING, p_retailprice DOUBLE) AS HEAP;")
    for k in range(2):
        write_delimited(parts.where(f"p_partkey % 2 = {k}"), f"{folder}/in/{k}")
        load_continuously(engine, f"{folder}/in/*", "p", f"{folder}/checkpoint", once=True).awaitTermination()
    files.delete(spark, f"{folder}/checkpoint/commits/1")
    load_continuously(engine, f"{folder}/in/*", "p", f"{folder}/checkpoint", once=True).awaitTermination()
    return engine.table("p")


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinalities that the estimator gives for the standard tables, applied step by step."""
    rows = []
    for name, steps in ESTIMATES.items():
        known = standard_statistics()
        for cnf, rels in steps[:-1]:
            known.apply(cnf, rels)
        rows.append((name, round(known.estimate(*steps[-1]))))
    return spark.createDataFrame(rows, "name string, rows long")


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows as the text output writes them."""
    folder = _scratch(spark, "lines")
    ops.write_out(_frame(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), folder)
    return spark.read.text(folder)


def reordered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four-way join in the order that estimates choose."""
    engine = Engine(spark, joins="collected")
    engine.register_folder(sf_dir, ["customer", "orders", "nation", "region"], SCHEMAS)
    return engine.sql(STATEMENTS["join_4way"])


#: name -> (predicate, relations) of each step; all but the last are applied, the last one is estimated.
ESTIMATES = {
    "orders_customer_nation": [("(c_custkey = o_custkey)", ["orders", "customer"]), ("(c_nationkey = n_nationkey)", ["orders", "customer", "nation"])],
    "partsupp_supplier_nation": [("(s_suppkey = ps_suppkey)", ["partsupp", "supplier"]), ("(s_nationkey = n_nationkey) AND (n_name = 'AMERICA')", ["partsupp", "supplier", "nation"])],
    "part_partsupp_or": [("(p_partkey = ps_partkey) AND (p_size = 3 OR p_size = 6 OR p_size = 19)", ["part", "partsupp"])],
    "orders_lineitem_range": [("(l_receiptdate > '1995-02-01') AND (l_orderkey = o_orderkey)", ["orders", "lineitem"])],
}

#: name -> (query, DuckDB SQL)
OPERATORS = {
    "sort_descending": (sort_descending, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC"),
    "project_with_duplicates": (project_with_duplicates, "SELECT l_linestatus, l_returnflag FROM lineitem"),
    "delimited_round_trip": (delimited_round_trip, "SELECT * FROM customer"),
    "heap_load": (heap_load, "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM (FROM supplier UNION ALL FROM supplier) WHERE s_nationkey < 12"),
    "sorted_lookup": (sorted_lookup, "SELECT p_partkey, p_name, p_brand FROM part WHERE p_size = 7"),
    "heap_scan_order": (
        heap_scan_order,
        "SELECT row_number() OVER (ORDER BY least(n_regionkey, 3), CASE WHEN n_regionkey < 3 THEN -n_nationkey ELSE n_nationkey END) - 1 AS place, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation",
    ),
    "sorted_scan": (sorted_scan, "SELECT row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS place, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_suppkey FROM supplier"),
    "statements": (statements, 'SELECT CAST(2 * SUM(n_nationkey) AS BIGINT) AS "sum", r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name'),
    "output_file": (output_file, "SELECT 'r_regionkey: [' || r_regionkey || '], r_name: [' || r_name || ']' AS value FROM region WHERE r_regionkey > 1"),
    "stream_load": (stream_load, "SELECT p_partkey, p_name, p_retailprice FROM part"),
    # Cardinalities by hand from the standard counts: rows multiplied, divided by the larger distinct count of each equality.
    "estimates": (estimates, "SELECT * FROM (VALUES ('orders_customer_nation', 1500000::BIGINT), ('partsupp_supplier_nation', 32000), ('part_partsupp_or', 48000), ('orders_lineitem_range', 2000405)) AS t(name, rows)"),
    "written_lines": (written_lines, "SELECT 's_suppkey: [' || s_suppkey || '], s_name: [' || s_name || '], s_acctbal: [' || printf('%.6f', s_acctbal) || ']' AS value FROM supplier"),
    "reordered_join": (reordered_join, STATEMENTS["join_4way"]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in STATEMENTS} | {name: query for name, (query, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    statements = {name: f"{HEADS[name]} {text[text.index('FROM') :]}" if name in HEADS else text for name, text in STATEMENTS.items()}
    return statements | {name: sql for name, (_, sql) in OPERATORS.items()}
