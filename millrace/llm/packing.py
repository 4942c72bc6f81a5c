"""Bulk-synchronous best-fit packing of documents into sequences of bounded tokens.

A document of more tokens than a sequence holds is cut into full pieces and a last one. Pieces of more than half a
sequence open one each. Then come rounds for ever smaller pieces, the last one for all that are left (LEAST), each on
the gaps that the rounds before it made or left:

1. Pieces and gaps are sorted by falling size over range partitions, equal sizes spread by hash. Every partition
   sweeps its range: each piece takes its successor, the smallest gap that holds it, in the order of their ranks;
   gaps shrink and stay in the sweep.
2. What a range has left claims across ranges. The left pieces of a range take, by rank, from the left gaps of the
   nearest range of larger sizes that has any: the ranges' totals say which tokens of the one meet which of the
   other, so no gap is claimed twice. Pieces for which no range has a gap claim new sequences.
3. Pieces and gaps that claim each other meet in blocks of bounded tokens, whose sweeps settle the claims, largest
   pieces first, and open the sequences. Gaps are updated. What didn't fit goes to the next round; in the last one a
   block opens a sequence for it.

Both steps of a round are written in the shared folder and only slim rows are shuffled (no text, no ids). What goes
to the driver is two sums a range. A task holds the gaps of its range or block.

Defined results: null and empty texts are one piece, the end id; repeated rows are packed each; rows without an id
are packed too; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ended, shared_encoder
from .common import map_texts, text_of, written

GAP, PIECE, PLACED = 0, 1, 2
#: Shares of a sequence above which pieces are in each round, and the tokens that a block of claims holds.
LEAST, BLOCK_TOKENS = (1 / 4, 1 / 8, 0), 1 << 24

_STATE = "kind int, size int, key long, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, offset long, range int, upto long"
_NAMES = [f.split()[0] for f in _STATE.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def pieces(docs: DataFrame, tokenizer: str, kind: str = "folded", capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        ids, ends = ended(*shared_encoder(tokenizer, kind).encode(block.column("text")), end_id)
        size, raw = np.diff(ends), memoryview(ids.view(np.uint8))
        many = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(capacity, size[row] - start)
        at = (ends[row] + start) * 4
        crc = [zlib.crc32(raw[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist())]
        return [block.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]

    return map_texts(slim, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Sweep:
    """Best fit over rows of falling size: free gaps by size, and a bit mask of the sizes that have any."""

    def __init__(self, capacity: int, opens: bool):
        self.capacity, self.opens, self.free, self.mask = capacity, opens, {}, 0

    def put(self, sequence: int, size: int) -> None:
        if size > 0:
            self.free.setdefault(size, []).append(sequence)
            self.mask |= 1 << size

    def take(self, size: int, key: int) -> tuple[int, int] | None:
        """The sequence and offset for a piece; None if no gap holds it."""
        above = self.mask >> size
        if above:
            gap = size + (above & -above).bit_length() - 1
            sequences = self.free[gap]
            sequence = sequences.pop()
            if not sequences:
                self.mask ^= 1 << gap
        elif self.opens:
            gap, sequence = self.capacity, key
        else:
            return None
        self.put(sequence, gap - size)
        return sequence, self.capacity - gap

    def rows(self, batch: pa.RecordBatch) -> tuple[list[int], list[tuple]]:
        """Places of the pieces in batch, and for each its kind, sequence and offset."""
        places, found = [], []
        for k, (what, size, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "key")), strict=True)):
            if what == GAP:
                self.put(key, size)
                continue
            taken = self.take(size, key)
            places.append(k)
            found.append((PIECE, None, None) if taken is None else (PLACED, *taken))
        return places, found

    def gaps(self) -> Iterator[tuple[int, list[int]]]:
        """Sizes of gaps, falling, and at most 10,000 sequences that have one."""
        for size in sorted(self.free, reverse=True):
            sequences = self.free[size]
            for at in range(0, len(sequences), 10_000):
                yield size, sequences[at : at + 10_000]


def _pieces(batch: pa.RecordBatch, places: list[int], found: list[tuple], number: int | None, upto: list[int | None]) -> pa.RecordBatch:
    kept = batch.take(pa.array(places, pa.int64()))
    kind, sequence, offset = ([f[k] for f in found] for k in range(3))
    columns = [pa.array(kind, pa.int32()), *(kept.column(c) for c in _NAMES[1:7]), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([number] * len(kind), pa.int32()), pa.array(upto, pa.int64())], names=_NAMES)


def _gaps(size: int, sequences: list[int], number: int | None, upto: list[int | None]) -> pa.RecordBatch:
    n = len(sequences)
    columns = [pa.array([GAP] * n, pa.int32()), pa.array([size] * n, pa.int32()), pa.array(sequences, pa.int64()), *(pa.nulls(n, t) for t in _TYPES[3:9])]
    return pa.RecordBatch.from_arrays([*columns, pa.array([number] * n, pa.int32()), pa.array(upto, pa.int64())], names=_NAMES)


def _swept_ranges(rows: DataFrame, capacity: int) -> DataFrame:
    """rows (sorted by falling size, gaps first, in each partition) after a sweep of each range.

    Left pieces, and left gaps as large as the range, have their range and the tokens of their kind up to them there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, sweep, tokens, least = TaskContext.get().partitionId(), Sweep(capacity, False), 0, capacity
        for batch in batches:
            if not batch.num_rows:
                continue
            places, found = sweep.rows(batch)
            sizes, upto = batch.column("size").to_pylist(), []
            least = sizes[-1]
            for k, (kind, _, _) in zip(places, found):
                tokens += sizes[k] if kind == PIECE else 0
                upto.append(tokens if kind == PIECE else None)
            yield _pieces(batch, places, found, number, upto)
        tokens = 0
        for size, sequences in sweep.gaps():
            wide = size >= least
            yield _gaps(size, sequences, number if wide else None, [tokens + size * (k + 1) if wide else None for k in range(len(sequences))])
            tokens += size * len(sequences)

    return rows.mapInArrow(run, _STATE)


def claims(pieces: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int | None, int]]:
    """(range, first token, tokens, range of gaps or None, first token there): what the left pieces of ranges claim.

    Ranges are numbered by falling size, and the tokens of each are counted from its largest. Pieces claim from the
    nearest range before theirs, its smallest gaps first; None stands for new sequences.
    """
    out, free = [], []
    for number in sorted({*pieces, *gaps}):
        at, left = 0, pieces.get(number, 0)
        while left and free:
            other, size = free.pop()
            taken = min(left, size)
            out.append((number, at, taken, other, size - taken))
            if taken < size:
                free.append((other, size - taken))
            at, left = at + taken, left - taken
        if left:
            out.append((number, at, left, None, 0))
        if gaps.get(number):
            free.append((number, gaps[number]))
    return out


def _claiming(left: DataFrame, found: list[tuple[int, int, int, int | None, int]], block: int) -> DataFrame:
    """left with the claim and the block of it that each row belongs to; gaps that nothing claims have null."""

    def table(kind: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, (number, at, tokens, other, there) in enumerate(found):
            if kind == PIECE:
                by.setdefault(number, []).append((at, tokens, k))
            elif other is not None:
                by.setdefault(other, []).append((there, tokens, k))
        return {number: tuple(np.array(sorted(rows), np.int64).T) for number, rows in by.items()}

    tables = {PIECE: table(PIECE), GAP: table(GAP)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, number = batch.column("kind").to_numpy(), batch.column("range").to_numpy()
            at = batch.column("upto").to_numpy() - batch.column("size").to_numpy()
            claim, part = np.full(len(kind), -1, np.int64), np.zeros(len(kind), np.int64)
            for what, some in {(int(a), int(b)) for a, b in zip(kind, number)}:
                if some in tables[what]:
                    first, tokens, index = tables[what][some]
                    rows = np.flatnonzero((kind == what) & (number == some))
                    k = np.searchsorted(first, at[rows], "right") - 1
                    inside = at[rows] - first[np.maximum(k, 0)]
                    ok = (k >= 0) & (inside < tokens[k])
                    claim[rows[ok]], part[rows[ok]] = index[k[ok]], inside[ok] // block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(claim, mask=claim < 0), pa.array(part)], names=[*_NAMES, "claim", "block"])

    return left.mapInArrow(run, f"{_STATE}, claim long, block long")


def _settled(claimed: DataFrame, capacity: int, opening: Callable[[int], bool]) -> DataFrame:
    """claimed rows after a sweep of each block, where opening says whether those of a claim open sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, last = None, None

        def end() -> Iterator[pa.RecordBatch]:
            for size, sequences in sweep.gaps() if sweep else ():
                yield _gaps(size, sequences, None, [None] * len(sequences))

        for batch in batches:
            if not batch.num_rows:
                continue
            claim, block = batch.column("claim").to_numpy(), batch.column("block").to_numpy()
            new = np.flatnonzero((claim[1:] != claim[:-1]) | (block[1:] != block[:-1])) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if (claim[i], block[i]) != last:
                    yield from end()
                    last, sweep = (claim[i], block[i]), Sweep(capacity, opening(int(claim[i])))
                some = batch.slice(i, j - i)
                places, found = sweep.rows(some)
                if places:
                    yield _pieces(some, places, found, None, [None] * len(places))
        yield from end()

    by = ["claim", "block"]
    return claimed.repartition(*by).sortWithinPartitions(*by, F.col("size").desc(), "kind", "key").mapInArrow(run, _STATE)


def pack(found: DataFrame, capacity: int = 2048, block: int = BLOCK_TOKENS) -> DataFrame:
    """found (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    keyed = found.withColumn("key", F.monotonically_increasing_id())
    big = F.col("length") * 2 > capacity
    none = [F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in _STATE.split(", "))]
    first = written(
        keyed.select(
            F.when(big, PLACED).otherwise(PIECE).alias("kind"), F.col("length").cast("int").alias("size"), "key", "doc_id", "piece", "start", "ids_crc32",
            F.when(big, F.col("key")).alias("sequence_id"), F.when(big, F.lit(0).cast("long")).alias("offset"), *none[9:],
        ),
        "packing",
    )
    opened = first.where((F.col("kind") == PLACED) & (F.col("size") < capacity))
    gaps = opened.select(F.lit(GAP).alias("kind"), (F.lit(capacity) - F.col("size")).cast("int").alias("size"), "key", *none[3:])
    rest, done = first.where(F.col("kind") == PIECE), [first]
    for share in LEAST:
        here = F.col("size") > int(share * capacity)
        rows = gaps.where(here).union(rest.where(here)).repartitionByRange(F.col("size").desc(), F.xxhash64("key"))
        swept = written(_swept_ranges(rows.sortWithinPartitions(F.col("size").desc(), "kind", "key"), capacity), "packing")
        left = swept.where((F.col("kind") != PLACED) & F.col("range").isNotNull())
        sums: dict[int, dict[int, int]] = {GAP: {}, PIECE: {}}
        for row in left.groupBy("range", "kind").agg(F.max("upto").alias("upto")).collect():  # two sums a range
            sums[row.kind][row.range] = row.upto
        made = claims(sums[PIECE], sums[GAP])
        new = {k for k, claim in enumerate(made) if claim[3] is None}
        claimed = _claiming(left, made, block)
        if made:
            settled = written(_settled(claimed.where("claim IS NOT NULL"), capacity, lambda claim, new=new, last=not share: last or claim in new), "packing")
            done += [swept, settled]
            gaps = gaps.where(~here).union(swept.where((F.col("kind") == GAP) & F.col("range").isNull())).union(claimed.where("claim IS NULL").select(*_NAMES)).union(settled.where(F.col("kind") == GAP))
            rest = rest.where(~here).union(settled.where(F.col("kind") == PIECE))
        else:
            done.append(swept)
            gaps = gaps.where(~here).union(swept.where(F.col("kind") == GAP))
            rest = rest.where(~here)
    placed = done[0].where(F.col("kind") == PLACED)
    for table in done[1:]:
        placed = placed.union(table.where(F.col("kind") == PLACED))
    return placed.select("doc_id", "piece", "start", F.col("size").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "folded", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs."""
    return pack(pieces(docs, tokenizer, kind, capacity, end_id), capacity)
