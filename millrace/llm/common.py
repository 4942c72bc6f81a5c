"""Helpers that the operators of this subpackage share: table access, written cuts and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of a Python operator holds at a time.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder that spark.checkpoint.dir names.

    Where that is unset, a local session uses a temporary folder; on a cluster machines would not share one, so that
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("millrace.scratch.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("millrace.scratch.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: The folder behind each table that written() gave.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, label: str) -> DataFrame:
    """df cut from its lineage: written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def stands_for(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which reads nothing but a written() table: drop_written(df) deletes that one's files."""
    _folders[df] = _folders[table]
    return df


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a written() table that nothing reads any more; other frames have none."""
    if df not in _folders:
        return
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders.pop(df))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that one task of hot_join takes.
HOT_ROWS = 1 << 16


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, spread: Column, most: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """rows joined with facts, one a key, whose column n says about how many rows the key has.

    A key of more than `most` rows is split by the hash of spread over several keys of the join, and its facts go to
    each. Only the numbers of keys of such keys are broadcast: of R rows, there are R / most at most.
    """
    parts = F.ceil(F.col(n) / most).cast("int")
    hot = facts.where(F.col(n) > most).select(*keys, parts.alias("_parts"))
    if hot.isEmpty():
        return rows.join(facts, keys, how)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    each = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(each, [*keys, "_part"], how).drop("_part")


def text_of(name: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_hash(name: str) -> Column:
    """A hash of a text column that tells rows of one id apart."""
    return F.xxhash64(text_of(name))


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most `most` bytes of text each (one row at least)."""
    start, held = 0, 0
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for row, size in enumerate(sizes):
        if row > start and held + (size or 0) > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def hand_back_memory() -> None:
    """Return what a worker's allocators hold but don't use, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over blocks of bounded text: make gives the output columns of a block."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, column):
                yield pa.RecordBatch.from_arrays(make(block), names=names)
        hand_back_memory()

    return df.mapInArrow(run, schema)


class Recent:
    """What a worker remembers of distinct strings: two generations of at most half of `most` entries each.

    When the young one is full it becomes the old one, and what is asked for again moves back, so frequent strings
    stay and rare ones go. Strings of more than `longest` characters are not remembered, which bounds the memory.
    A worker goes on to another operator only with another stage, and then what the others remember is dropped.
    """

    #: All that a worker has, each with the stage that it was last used in.
    alive: weakref.WeakSet[Recent] = weakref.WeakSet()

    def __init__(self, most: int = 400_000, longest: int = 64):
        self.most, self.longest, self.young, self.old, self.stage = most, longest, {}, {}, None
        Recent.alive.add(self)

    def _use(self) -> None:
        from pyspark import TaskContext

        task = TaskContext.get()
        stage = None if task is None else task.stageId()
        if stage != self.stage:
            self.stage = stage
            for other in list(Recent.alive):
                if other.stage != stage:
                    other.young, other.old = {}, {}

    def values(self, want: list[str], make: Callable[[list[str]], Iterable]) -> list:
        """The value of each of some distinct strings; make gives those of unknown ones, in order."""
        self._use()
        out = list(map(self.young.get, want))
        missing = [k for k, value in enumerate(out) if value is None]
        if not missing:
            return out
        keys = [want[k] for k in missing]
        found = list(map(self.old.get, keys))
        new = [key for key, value in zip(keys, found) if value is None]
        if new:
            made = iter(list(make(new)))
            found = [next(made) if value is None else value for value in found]
        for k, value in zip(missing, found):
            out[k] = value
        fresh = dict(zip(keys, found))
        if max(map(len, keys)) > self.longest:
            fresh = {key: value for key, value in fresh.items() if len(key) <= self.longest}
        if self.young and len(self.young) + len(fresh) > self.most // 2:
            self.old, self.young = self.young, {}
        self.young.update(fresh)
        return out

    def resolve(self, want: set[str], make: Callable[[list[str]], Iterable]) -> dict:
        """The same for a set, by string."""
        want = list(want)
        return dict(zip(want, self.values(want, make), strict=True))
