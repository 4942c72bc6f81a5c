"""Token ids in ORC files: shards in ascending document order, integer run-length encoding, Bloom filters on ids.

Documents are range-partitioned and sorted by id, encoded, and written one file a partition. Each row holds its
shard, the ids before it in that shard, its count and its ids, so a reader finds any document's place in the whole
stream from the shards' totals alone. Row indexes and Bloom filters on doc_id let lookups skip stripes and row
groups; Spark splits large files at stripes, so they are read in parallel.

Defined results: null and empty texts hold the end id alone; repeated ids lie in one range, in no
particular order where it spans two shards; null ids come first; an empty table gives files without rows and an empty reading; other columns aren't read.
Only the id and text columns are shuffled, once; cost and files are linear in the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ended, shared_encoder
from .common import blocks, hand_back_memory, text_of

#: What the writer asks of ORC.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
}

#: Words that a worker remembers at most: about 200 MB.
WORDS = 1_000_000

_SCHEMA = "doc_id long, shard int, before long, n_tokens int, ids array<int>"
_NAMES = ["doc_id", "shard", "before", "n_tokens", "ids"]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, kind: str = "spaced", end_id: int = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs with a tokenizers file, end each with end_id, and write the ids to folder."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    keys = (F.col("doc_id"), F.xxhash64("text"))
    spread = slim.repartitionByRange(parts, *keys) if parts else slim.repartitionByRange(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, before = TaskContext.get().partitionId(), 0
        encoder = shared_encoder(tokenizer, kind, WORDS)
        for batch in batches:
            for block in blocks(batch):
                found, ends = ended(*encoder.encode(block.column("text")), end_id)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.view(np.int32)))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.full(block.num_rows, shard, np.int32)), pa.array(before + ends[:-1]), pa.array(np.diff(ends).astype(np.int32)), ids], names=_NAMES)
                before += int(ends[-1])
        hand_back_memory()

    encoded = spread.sortWithinPartitions("doc_id", "text").mapInArrow(run, _SCHEMA)
    encoded.write.options(**ORC_OPTIONS).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).orc(folder)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the files' indexes and Bloom filters."""
    return read_tokens(spark, folder).where(F.col("doc_id").isin(doc_ids))


def shard_starts(stored: DataFrame) -> DataFrame:
    """shard and the ids before it: a running sum over one row a file."""
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, from the files."""
    stored = read_tokens(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw = memoryview(ids.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)).cast("B")
            at = (ids.offsets.to_numpy() * 4).tolist()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])]
            sizes = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("before"), sizes, pa.array(crc, pa.int64())], names=["doc_id", "shard", "before", "n_tokens", "ids_crc32"])

    read = stored.select("doc_id", "shard", "before", "ids").mapInArrow(run, "doc_id long, shard int, before long, n_tokens long, ids_crc32 long")
    return read.join(shard_starts(stored), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
