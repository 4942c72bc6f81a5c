"""Tables as streams: delimited files loaded as they arrive.

Operators that keep no state (select_pipe, project) take the frames made here as they take any other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.session import Engine
from millrace.sources.tables import fields_of


def stream_delimited(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int | None = None) -> DataFrame:
    """Rows of the bar-delimited files that appear in folder, read as read_delimited reads one."""
    reader = spark.readStream
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return fields_of(reader.text(folder), schema)


def load_continuously(engine: Engine, folder: str, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Add each file that appears in folder to a table, one batch at a time; once stops when all there are is loaded.

    A batch is a load named by the checkpoint and its number, so one that is tried again replaces what it left.
    """
    rows = stream_delimited(engine.spark, folder, engine.catalog[table].schema)
    stream = hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: engine.append(table, batch, f"stream-{stream}-{number:012d}"))
    return (writer.trigger(availableNow=True) if once else writer).start()
