"""Reading and writing tables: delimited text, heaps and sorted tables in Parquet, and text output."""

from __future__ import annotations

import sys
import time
import uuid
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .catalog import TYPES, TableInfo, columns_of

#: Where a heap keeps the order in which its rows came: the load, its file, the place of the split there, the row.
ORDINAL = {"_load": T.StringType(), "_file": T.StringType(), "_split": T.LongType(), "_row": T.LongType()}
#: What an empty field stands for.
ZERO = {"int": 0, "double": 0.0, "string": ""}


def fields_of(lines: DataFrame, schema: T.StructType, *more: Column) -> DataFrame:
    """The columns of bar-delimited lines, and more. Each field ends in a bar; there are no quotes.

    An empty field is 0, 0.0 or '', and no time (null). Blank lines aren't rows. Lines with too few or too many
    fields, and fields that don't read as their type, are errors.
    """
    kinds, fields = dict(columns_of(schema)), F.split("value", r"\|")
    wrong = (F.size("_fields") != len(schema.fields) + 1) | (F.element_at("_fields", -1) != "")
    said = F.raise_error(F.concat(F.lit(f"not {len(schema.fields)} fields that end in a bar: "), F.col("value")))
    held = lines.where(F.trim("value") != "").select("value", fields.alias("_fields"), *more)

    def column(k: int, field: T.StructField) -> Column:
        text = F.when(wrong, said.cast("string")).otherwise(F.get("_fields", F.lit(k)))
        if isinstance(field.dataType, T.StringType):
            return text.alias(field.name)
        zero = F.lit(None) if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(ZERO[kinds[field.name]])
        return F.when(text == "", zero.cast(field.dataType)).otherwise(text.cast(field.dataType)).alias(field.name)

    names = [c for c in held.columns if c not in ("value", "_fields")]
    return held.select(*[column(k, f) for k, f in enumerate(schema.fields)], *names)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, ordered: bool = False) -> DataFrame:
    """Rows of a file, or a folder of files, as fields_of reads them.

    ordered adds the file, the split's place and the row's, which together give the order in the files.
    """
    lines = spark.read.text(path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row")]
    return fields_of(lines, schema, *(place if ordered else []))


def write_delimited(df: DataFrame, path: str) -> None:
    """The same format: every field ends in a bar. Null is written empty; a bar or a line end in a string is an error."""

    def field(name: str, kind: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        if kind == "string":
            text = F.when(text.rlike(r"[|\n\r]"), F.raise_error(F.concat(F.lit(f"{name} holds a bar or a line end: "), text)).cast("string")).otherwise(text)
        return F.concat(text, F.lit("|"))

    df.select(F.concat(*[field(c, k) for c, k in columns_of(df.schema)]).alias("value")).write.text(path)


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """df range-partitioned and sorted by keys, so that files and row groups hold narrow ranges of them."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def new_load() -> str:
    """A name for a load, later than those before it; a load under a name that is there replaces it."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


class Store:
    """Parquet folders behind tables, with one folder a load.

    Loads into a heap keep the order of their rows; those into a sorted table are files of narrow, sorted key
    ranges, and a reading in order merges the loads. Nothing that is there is written again until compacted() is
    asked for, and a load appears as a whole, when its folder is committed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _schema(self, table: TableInfo) -> T.StructType:
        more = {"_load": T.StringType()} if table.sort_columns else ORDINAL
        return T.StructType([*table.schema.fields, *(T.StructField(c, kind) for c, kind in more.items())])

    def create(self, table: TableInfo) -> None:
        first = T.StructType([f for f in self._schema(table).fields if f.name != "_load"])
        self.spark.createDataFrame([], first).write.mode("errorifexists").parquet(f"{table.path}/_load=0")

    def drop(self, table: TableInfo) -> None:
        files.delete(self.spark, table.path)

    def scan(self, table: TableInfo, ordered: bool = False) -> DataFrame:
        """A table's rows; ordered: in the order of its keys, or as they came into a heap."""
        raw = self.spark.read.schema(self._schema(table)).parquet(table.path)
        if ordered:
            raw = raw.orderBy(*(table.sort_columns or ORDINAL))
        return raw.select(*[c for c, _ in table.columns])

    def load(self, table: TableInfo, path: str, load: str | None = None) -> None:
        """Add the rows of a delimited file."""
        rows = read_delimited(self.spark, path, table.schema, ordered=not table.sort_columns)
        self._add(table, rows, load)

    def append(self, table: TableInfo, rows: DataFrame, load: str | None = None) -> None:
        """Add the rows of a frame with the table's columns."""
        rows = rows.select(*[F.col(f"`{c}`").cast(TYPES[k]).alias(c) for c, k in table.columns])
        if not table.sort_columns:
            rows = rows.withColumns({"_file": F.lit(""), "_split": F.lit(0).cast("long"), "_row": F.monotonically_increasing_id()})
        self._add(table, rows, load)

    def _add(self, table: TableInfo, rows: DataFrame, load: str | None) -> None:
        if table.sort_columns:
            rows = ranged(rows, list(table.sort_columns))
        rows.write.mode("overwrite").parquet(f"{table.path}/_load={load or new_load()}")
        self.spark.catalog.refreshByPath(table.path)

    def compacted(self, table: TableInfo) -> str:
        """A new folder with a sorted table's loads merged into one; the catalog is to point to it, and the old one to go."""
        new = f"{table.path.rpartition('.parquet')[0] or table.path}.{uuid.uuid4().hex}.parquet"
        ranged(self.scan(table), list(table.sort_columns)).write.parquet(f"{new}/_load={new_load()}")
        return new


def _shown(name: str, kind: str) -> Column:
    form = {"int": "%d", "double": "%f", "string": "%s"}[kind]
    value = F.col(f"`{name}`").cast(TYPES[kind])
    return F.format_string(f"{name.replace('%', '%%')}: [{form}]", value)


def as_lines(df: DataFrame) -> DataFrame:
    """Each row as "name: [value], name: [value]": ints as they are, doubles with six places, strings as they are."""
    return df.select(F.concat_ws(", ", *[_shown(c, k) for c, k in columns_of(df.schema)]).alias("value"))


def write_lines(df: DataFrame, path: str) -> int:
    """Write as_lines to a folder of text, in place of what is there; gives the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    as_lines(df).observe(seen, F.count("*").alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def print_rows(df: DataFrame, out: TextIO | None = None) -> int:
    """Print rows for a console, doubles with six significant digits; gives the number of rows. Partitions come one by one."""
    kinds, count = columns_of(df.schema), 0
    for row in df.toLocalIterator():
        print(", ".join(f"{c}: [{v:g}]" if k == "double" and v is not None else f"{c}: [{v}]" for (c, k), v in zip(kinds, row, strict=True)), file=out or sys.stdout)
        count += 1
    return count
