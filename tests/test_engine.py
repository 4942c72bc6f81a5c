"""Statements end to end, the operators, storage, output, and what must not come back."""

import io

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from millrace import suite
from millrace.errors import QueryError
from millrace.operators import relational as ops
from millrace.cli import repl, statements
from millrace.session import Engine
from millrace.sources.catalog import Catalog, parse_catalog, whole_order
from millrace.sources.tables import as_lines, read_delimited, write_delimited


@pytest.fixture
def engine(spark):
    out = Engine(spark, out=io.StringIO())
    out.register("t", spark.createDataFrame([(1, "a", 1.5), (2, "a", 2.5), (3, "b", 4.0), (3, "b", 4.0)], "k int, s string, d double"))
    out.register("u", spark.createDataFrame([("a", 10, 1), ("b", 20, 3), ("a", 30, 9)], "s string, v long, k int"))
    out.register("e", spark.createDataFrame([], "k int, s string, d double"))
    out.register("w", spark.createDataFrame([(1, "x"), (2, "y")], "k int, z string"))
    return out


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_grouped_sum_adds_all_rows(engine):
    assert rows(engine.sql("SELECT SUM(t.d), t.s FROM t AS t WHERE (t.k > 0) GROUP BY t.s")) == [(4.0, "a"), (8.0, "b")]


def test_sum_types_and_precision(engine):
    found = engine.sql("SELECT SUM(t.k * 1000000000) FROM t AS t")
    assert found.dtypes == [("sum", "bigint")] and rows(found) == [(9000000000,)]
    assert rows(engine.sql("SELECT SUM(t.d * 1234567.125) FROM t AS t")) == [(12.0 * 1234567.125,)]
    assert engine.sql("SELECT SUM(t.k * 1.0) FROM t AS t").dtypes == [("sum", "double")]


def test_sums_of_nothing(engine):
    assert rows(engine.sql("SELECT SUM(e.d) FROM e AS e")) == [(0.0,)]
    assert rows(engine.sql("SELECT SUM(e.k) FROM e AS e")) == [(0,)]
    assert rows(engine.sql("SELECT SUM(e.k), e.s FROM e AS e GROUP BY e.s")) == []


def test_sum_distinct(engine):
    assert rows(engine.sql("SELECT SUM DISTINCT (t.d) FROM t AS t")) == [(8.0,)]
    assert rows(engine.sql("SELECT SUM DISTINCT (t.d), t.s FROM t AS t GROUP BY t.s")) == [(4.0, "a"), (4.0, "b")]


def test_integer_division_truncates(engine):
    assert rows(engine.sql("SELECT SUM((0 - t.k) / 2) FROM t AS t WHERE (t.k = 3)")) == [(-2,)]
    assert rows(engine.sql("SELECT SUM(t.k / 2.0) FROM t AS t WHERE (t.k = 1)")) == [(0.5,)]


def test_written_order_of_columns(engine):
    assert engine.sql("SELECT t.d, t.k, t.s FROM t AS t").columns == ["d", "k", "s"]
    assert engine.sql("SELECT SUM(t.k), t.s, t.d FROM t AS t GROUP BY t.d, t.s").columns == ["sum", "s", "d"]
    assert engine.sql("SELECT a.s, b.s FROM t AS a, u AS b WHERE (a.s = b.s)").columns == ["a_s", "b_s"]


def test_hidden_keys_and_distinct(engine):
    assert rows(engine.sql("SELECT SUM(t.k) FROM t AS t GROUP BY t.s")) == [(3,), (6,)]
    assert rows(engine.sql("SELECT DISTINCT t.s FROM t AS t")) == [("a",), ("b",)]
    assert len(engine.sql("SELECT t.s FROM t AS t").collect()) == 4


def test_string_keys_theta_and_product(engine):
    assert len(engine.sql("SELECT t.k, u.v FROM t AS t, u AS u WHERE (t.s = u.s)").collect()) == 6
    assert rows(engine.sql("SELECT t.k, u.k FROM t AS t, u AS u WHERE (t.k > u.k) AND (t.s = 'a')")) == [(2, 1)]
    assert len(engine.sql("SELECT t.k, u.v FROM t AS t, u AS u").collect()) == 12
    assert engine.sql("SELECT t.k FROM t AS t, e AS e WHERE (t.k = e.k)").collect() == []


def test_conditions_over_several_tables_all_hold(engine):
    text = "SELECT t.k, u.v, w.z FROM t AS t, u AS u, w AS w WHERE (t.s = u.s OR t.k = 9) AND (u.k = w.k OR w.z = 'y') AND (t.k < w.k OR u.v = 10)"
    t, u, w = ([tuple(r) for r in engine.frames[n].collect()] for n in "tuw")
    expected = sorted((a[0], b[1], c[1]) for a in t for b in u for c in w if (a[1] == b[0] or a[0] == 9) and (b[2] == c[0] or c[1] == "y") and (a[0] < c[0] or b[1] == 10))
    assert rows(engine.sql(text)) == expected


def test_equal_or_equal_is_no_plain_equality(engine):
    t, u = ([tuple(r) for r in engine.frames[n].collect()] for n in "tu")
    expected = sorted((a[0], b[1]) for a in t for b in u if a[0] == b[2] or a[1] == b[0])
    assert rows(engine.sql("SELECT t.k, u.v FROM t AS t, u AS u WHERE (t.k = u.k OR t.s = u.s)")) == expected


def test_comparison_within_one_table_and_of_constants(engine):
    assert rows(engine.sql("SELECT t.k FROM t AS t WHERE (t.k < t.d)")) == [(1,), (2,), (3,), (3,)]
    assert rows(engine.sql("SELECT t.k FROM t AS t WHERE (1 > 2)")) == []
    assert len(engine.sql("SELECT t.k FROM t AS t, w AS w WHERE (1 < 2) AND (t.k = w.k)").collect()) == 2


@pytest.mark.parametrize(
    "text",
    [
        "SELECT t.s FROM t AS t GROUP BY t.s",
        "SELECT SUM(t.k), t.s FROM t AS t",
        "SELECT SUM(t.k), t.d FROM t AS t GROUP BY t.s",
        "SELECT t.zz FROM t AS t",
        "SELECT k FROM t AS a, u AS b",
        "SELECT t.k FROM zz AS t",
        "SELECT t.k FROM t AS t, u AS t",
        "SELECT t.k FROM t AS t WHERE (t.s = 3)",
        "SELECT SUM(t.s) FROM t AS t",
    ],
)
def test_errors_come_before_running(engine, text):
    with pytest.raises(QueryError):
        engine.sql(text)


def test_strict_types(spark, engine):
    strict = Engine(spark, strict_types=True)
    strict.frames = engine.frames
    assert len(strict.sql("SELECT t.k FROM t AS t WHERE (t.d > 2.0)").collect()) == 3
    with pytest.raises(QueryError):
        strict.sql("SELECT t.k FROM t AS t WHERE (t.d > 2)")


def test_string_order_is_by_bytes(spark):
    found = ops.select_pipe(spark.createDataFrame([("MIDDLE EAST",), ("middle",), ("ASIA",)], "n string"), "(n < 'middle east')")
    assert rows(found) == [("ASIA",), ("MIDDLE EAST",), ("middle",)]


def test_reordering_keeps_results(spark, engine):
    other = Engine(spark, joins="collected")
    other.frames = engine.frames
    for text in ("SELECT t.k, u.v, w.z FROM t AS t, u AS u, w AS w WHERE (t.s = u.s) AND (u.k = w.k)", "SELECT SUM(t.d), w.z FROM w AS w, u AS u, t AS t WHERE (t.k = w.k) AND (u.s = t.s) AND (u.v > 5) GROUP BY w.z", "SELECT t.k, w.z FROM t AS t, w AS w WHERE (t.k > w.k)"):
        assert rows(other.sql(text)) == rows(engine.sql(text))


def test_operators(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (1, "a")], "k long, s string")
    assert [r.k for r in ops.sort(df, ["k", "s"]).collect()] == [1, 1, 2, 3]
    assert [r.k for r in ops.sort(df, ["k"], ascending=False).collect()] == [3, 2, 1, 1]
    assert rows(ops.duplicate_removal(df)) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(ops.project(df, ["s"])) == [("a",), ("a",), ("b",), ("c",)]
    assert rows(ops.sum_(df, "k + 1")) == [(11,)]
    assert rows(ops.group_by(df, ["s"], "k")) == [(2, "a"), (2, "b"), (3, "c")]
    other = spark.createDataFrame([(1, "p"), (3, "q")], "j long, z string")
    assert rows(ops.join(df, other, "(k = j)")) == [(1, "a", 1, "p"), (1, "a", 1, "p"), (3, "c", 3, "q")]
    assert len(ops.join(df, other).collect()) == 8
    with pytest.raises(QueryError):
        ops.join(df, df, "(k = k)")
    assert ops.sort_keys("(s = s) AND (k = k)", df.columns) == ["s", "k"]
    assert whole_order(T.StructType.fromDDL("s string, d double, k long, j int")) == ["k", "j", "d", "s"]


def test_delimited_text(spark, tmp_path):
    (tmp_path / "x.tbl").write_text('1|2.5|a "b", c|\n|||\n7|1|z|\n')
    schema = T.StructType.fromDDL("k long, d double, s string")
    found = read_delimited(spark, str(tmp_path / "x.tbl"), schema)
    assert [tuple(r) for r in found.collect()] == [(1, 2.5, 'a "b", c'), (0, 0.0, ""), (7, 1.0, "z")]
    write_delimited(found, str(tmp_path / "y.tbl"))
    assert rows(read_delimited(spark, str(tmp_path / "y.tbl"), schema)) == rows(found)


def test_odd_lines(spark, tmp_path):
    schema = T.StructType.fromDDL("k long, s string")
    for text in ("3|c|d|\n", "3|c\n", "3|\n", "3|c||\n", "x|c|\n"):
        (tmp_path / "x.tbl").write_text("1|a|\n" + text)
        with pytest.raises(PySparkException):
            read_delimited(spark, str(tmp_path / "x.tbl"), schema).collect()
    (tmp_path / "x.tbl").write_text("1||\n\n2|b|\n")
    assert rows(read_delimited(spark, str(tmp_path / "x.tbl"), schema)) == [(1, ""), (2, "b")]
    (tmp_path / "x.tbl").write_text("|1|\n2020-01-02 03:04:05|2|\n")
    times = read_delimited(spark, str(tmp_path / "x.tbl"), T.StructType.fromDDL("t timestamp_ntz, k long"))
    assert [r.t and str(r.t) for r in times.orderBy("k").collect()] == [None, "2020-01-02 03:04:05"]


def test_nulls_and_bars_are_written_or_refused(spark, tmp_path):
    schema = "k long, d double, s string, t timestamp_ntz"
    nulls = spark.createDataFrame([(1, 2.5, "a", None), (None, None, None, None), (3, None, "c", None)], schema)
    write_delimited(nulls, str(tmp_path / "n"))
    assert rows(read_delimited(spark, str(tmp_path / "n"), nulls.schema)) == [(0, 0.0, "", None), (1, 2.5, "a", None), (3, 0.0, "c", None)]
    for bad in ("a|b", "a\nb"):
        with pytest.raises(PySparkException):
            write_delimited(spark.createDataFrame([(bad,)], "s string"), str(tmp_path / f"bad{len(bad)}{bad[1] == '|'}"))


def test_heap_keeps_order(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("".join(f"{k}|n{k}|\n" for k in (5, 3, 9, 1)))
    engine = Engine(spark, str(tmp_path / "db"), out=io.StringIO())
    engine.run("CREATE TABLE t (k INTEGER, s STRING) AS HEAP;")
    engine.run(f"INSERT '{tmp_path}/x.tbl' INTO t;")
    engine.append("t", [(7, "n7")])
    engine.run(f"INSERT '{tmp_path}/x.tbl' INTO t;")
    assert [r.k for r in engine.table("t", ordered=True).collect()] == [5, 3, 9, 1, 7, 5, 3, 9, 1]
    assert engine.sort_order("t") is None
    again = Engine(spark, str(tmp_path / "db"))
    assert rows(again.sql("SELECT SUM(t.k) FROM t AS t")) == [(43,)]
    engine.run("DROP TABLE t;")
    assert "t" not in Catalog(str(tmp_path / "db")) and not (tmp_path / "db" / "t.parquet").exists()
    with pytest.raises(QueryError):
        engine.sql("SELECT t.k FROM t AS t")


def test_sorted_table_merges(spark, tmp_path):
    import random

    engine = Engine(spark, str(tmp_path / "db"), out=io.StringIO())
    engine.run("CREATE TABLE t (s STRING, k INTEGER) AS SORTED ON k, s;")
    everything = []
    for load in range(3):
        some = [(f"s{random.randrange(50)}", random.randrange(100)) for _ in range(random.randrange(1, 60))]
        everything += some
        (tmp_path / f"{load}.tbl").write_text("".join(f"{s}|{k}|\n" for s, k in some))
        engine.run(f"INSERT '{tmp_path}/{load}.tbl' INTO t;")
        found = [(r.k, r.s) for r in engine.table("t", ordered=True).collect()]
        assert found == sorted((k, s) for s, k in everything)
    assert engine.sort_order("t") == ("k", "s")
    plan = engine.sql("SELECT t.s FROM t AS t WHERE (t.k = 7)")
    assert "EqualTo(k,7)" in plan._jdf.queryExecution().toString()
    assert rows(plan) == sorted((s,) for s, k in everything if k == 7)


def test_lookup_skips_row_groups(spark, tmp_path):
    """Of 5,000 rows in narrow key ranges, a lookup's scan gives out those of the files and row groups that may hold the key."""
    engine = Engine(spark, str(tmp_path / "db"), out=io.StringIO())
    engine.run("CREATE TABLE t (k INTEGER, s STRING) AS SORTED ON k;")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as a large load has
    for load in range(2):
        engine.append("t", spark.range(2500).selectExpr(f"2 * id + {load} AS k", "string(id) AS s"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = engine.sql("SELECT t.s FROM t AS t WHERE (t.k = 1234)")
    plan = found._jdf.queryExecution().executedPlan()
    assert rows(found) == [("617",)]
    found.collect()
    leaves, scanned = plan.collectLeaves(), []
    for k in range(leaves.size()):
        metrics = leaves.apply(k).metrics()
        if metrics.contains("numOutputRows"):
            scanned.append(metrics.apply("numOutputRows").value())
    assert scanned and 0 < sum(scanned) <= 5000 / 4


def test_compacting_and_replaced_loads(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), out=io.StringIO())
    engine.run("CREATE TABLE t (k INTEGER, s STRING) AS SORTED ON k;")
    for load in ("one", "two", "one"):
        engine.append("t", [(k, load) for k in range(3)], load)
    expected = sorted((k, load) for load in ("one", "two") for k in range(3))
    before = engine.catalog["t"].path
    assert rows(engine.table("t")) == expected
    engine.compact("t")
    assert engine.catalog["t"].path != before and rows(engine.table("t")) == expected and rows(Engine(spark, str(tmp_path / "db")).table("t")) == expected
    assert not (tmp_path / "db" / before.rpartition("/")[2]).exists()


def test_facts_stream_and_dimensions_are_built(spark):
    """The largest table of a join is no build side, whatever the order in which tables are written."""
    engine = Engine(spark)
    engine.register_folder("/root/testdata/sf0.01", ["customer", "orders", "lineitem", "supplier", "nation", "part", "region"])
    for name in ("join_cycle", "distinct_join", "join_4way", "group_by_join"):
        found = engine.plan(suite.STATEMENTS[name])
        first = next(line for line in found.root.lines() if line.startswith("  table: "))
        assert first.startswith("  table: lineitem") or name == "join_4way" and first.startswith("  table: orders")
        plan = found.frame._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan
    # Customers share a nation with many suppliers: they wait for their orders.
    tables = [line.split()[1] for line in engine.plan(suite.STATEMENTS["join_cycle"]).root.lines() if line.startswith("  table: ")]
    assert tables.index("orders") < tables.index("customer")


def test_or_of_equalities_is_a_union_of_joins(engine):
    found = engine.sql("SELECT t.k, u.v FROM t AS t, u AS u WHERE (t.k = u.k OR t.s = u.s) AND (u.v < 30)")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in text and "NestedLoop" not in text
    t, u = ([tuple(r) for r in engine.frames[n].collect()] for n in "tu")
    assert rows(found) == sorted((a[0], b[1]) for a in t for b in u if (a[0] == b[2] or a[1] == b[0]) and b[1] < 30)


@pytest.mark.parametrize("joins", ["sizes", "collected", "standard", "written"])
def test_orders_of_joins_give_the_same(spark, engine, joins):
    other = Engine(spark, joins=joins)
    other.frames = engine.frames
    text = "SELECT SUM(t.d), w.z FROM w AS w, u AS u, t AS t WHERE (t.k = w.k) AND (u.s = t.s) AND (u.v > 5) GROUP BY w.z"
    assert rows(other.sql(text)) == rows(engine.sql(text))
    with pytest.raises(QueryError):
        Engine(spark, joins="guesses")


def test_filters_and_columns_reach_the_scan(spark):
    engine = Engine(spark)
    engine.register_folder("/root/testdata/sf0.001", ["orders"])
    text = engine.sql("SELECT o.o_custkey FROM orders AS o WHERE (77 = o.o_orderkey)")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,77)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_bucketed_join_needs_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("left_b", "right_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            spark.range(100).withColumnRenamed("id", f"{name[0]}k").write.bucketBy(4, f"{name[0]}k").sortBy(f"{name[0]}k").saveAsTable(name)
        joined = ops.join(spark.table("left_b"), spark.table("right_b"), "(lk = rk)")
        assert joined.count() == 100
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_catalog_text():
    found = parse_catalog("BEGIN\na\na.tbl\nx Int\ny String\nEND\n\nBEGIN a b.tbl z Double END")
    assert found == {"a": ("a.tbl", (("x", "int"), ("y", "string")))}
    for bad in ("a", "BEGIN a a.tbl x Int", "BEGIN a a.tbl x Text END"):
        with pytest.raises(QueryError):
            parse_catalog(bad)


def test_output(spark, engine, tmp_path):
    assert [r.value for r in as_lines(engine.sql("SELECT t.k, t.s, t.d FROM t AS t WHERE (t.k = 1)")).collect()] == ["k: [1], s: [a], d: [1.500000]"]
    engine.run("SELECT t.k FROM t AS t WHERE (t.k = 2)")
    text = engine.out.getvalue()
    assert "*** Select File ***" in text and "where: (t.k = 2)" in text and "k: [2]" in text and text.endswith("# of Records 1\n")
    engine.run(f"SET OUTPUT '{tmp_path}/out';")
    engine.run("SELECT t.k FROM t AS t WHERE (t.k = 3)")
    assert rows(spark.read.text(f"{tmp_path}/out")) == [("k: [3]",), ("k: [3]",)]
    assert engine.out.getvalue().endswith("# of Records 2\n")
    engine.run("SELECT t.k FROM t AS t WHERE (t.k = 1)")
    assert rows(spark.read.text(f"{tmp_path}/out")) == [("k: [1]",)]
    console = io.StringIO()
    assert ops.print_out(spark.createDataFrame([(1, 1234567.0, "a"), (2, 0.1 + 0.2, "b")], "k long, d double, s string").coalesce(1), console) == 2
    assert console.getvalue() == "k: [1], d: [1.23457e+06], s: [a]\nk: [2], d: [0.3], s: [b]\n"
    engine.run("SET OUTPUT NONE;")
    engine.run("SELECT t.s, u.v FROM t AS t, u AS u WHERE (t.s = u.s)")
    assert engine.out.getvalue().rstrip().endswith("output: pipe 4 (s, v)")


def test_prompt(engine):
    lines = io.StringIO("SET OUTPUT\nSTDOUT;\nSELECT t.k FROM t AS t\nWHERE (t.k = 1)\n\nnonsense;\nSELECT SUM(t.d / (t.k - 1)) FROM t AS t;\nSELECT t.s FROM t AS t WHERE (t.k = 2);\nQUIT;\nSELECT t.d FROM t AS t;\n")
    repl(engine, lines)
    text = engine.out.getvalue()
    assert "k: [1]" in text and "error: expected SELECT" in text and "d: [" not in text
    assert "DIVIDE_BY_ZERO" in text and "s: [a]" in text
    assert list(statements(io.StringIO("a;\nb\nc"))) == ["a;", "b c"]
