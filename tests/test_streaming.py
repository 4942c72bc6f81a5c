"""Tables as streams."""

import io

from pyspark.sql import types as T

from millrace.operators import relational as ops
from millrace.session import Engine
from millrace.streaming.load import load_continuously, stream_delimited


def test_files_are_loaded_as_they_arrive(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), out=io.StringIO())
    engine.run("CREATE TABLE t (k INTEGER, s STRING) AS SORTED ON k;")
    (tmp_path / "in").mkdir()
    for load, text in enumerate(("3|c|\n1|a|\n", "2|b|\n||\n")):
        (tmp_path / "in" / f"{load}.tbl").write_text(text)
        load_continuously(engine, str(tmp_path / "in"), "t", str(tmp_path / "ck"), once=True).awaitTermination()
    assert [tuple(r) for r in engine.table("t", ordered=True).collect()] == [(0, ""), (1, "a"), (2, "b"), (3, "c")]


def test_stateless_operators_take_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.tbl").write_text("1|a|\n5|b|\n9|c|\n")
    rows = stream_delimited(spark, str(tmp_path / "in"), T.StructType.fromDDL("k long, s string"))
    query = ops.project(ops.select_pipe(rows, "(k > 2)"), ["s"]).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.s for r in spark.table("streamed").collect()) == ["b", "c"]
