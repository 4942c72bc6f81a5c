"""Byte-level BPE on padded numpy matrices.

A text is cut by the tokenizer's pattern; distinct matches are encoded once a worker. Their bytes stand in padded
matrices of rows of like length, one row a match. Each round looks up the rank of every adjacent pair in a hashed
table, every row merges its leftmost pair of minimum rank, and the rows move together over the gap; rows without
a pair left are taken out. Where the same pair stands in a row again, it merges there in the same round, unless one
of these merges makes a pair of less rank, which would come before: so a row takes at most as many rounds as the
vocabulary has merges, and matches of any length go the same way.

Defined results: null and empty texts have no tokens and decode to nothing; repeated rows are encoded one by one;
an empty table gives an empty result; only the id and text columns are read. Lone surrogates cannot occur in
Spark strings. Memory is bounded by the block, the cache of matches and the matrices of one block.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Encoder, gathered, joined
from .common import map_texts

#: Rows and cells of one matrix at most; a longer match has one for itself.
ROWS, CELLS = 16384, 1 << 18
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Open addressing from a pair of ids to the id that it merges to, which is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slots, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            free = self.keys[slots[left]] < 0
            tried, first = np.unique(slots[left][free], return_index=True)
            put = left[free][first]
            self.keys[tried], self.values[tried] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they don't merge; negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(keys.shape, NONE, np.int32)
        open_ = np.flatnonzero((right >= 0) & (left >= 0))
        want = keys[open_]
        slots = self._slot(want)
        while len(open_):
            there = self.keys[slots]
            hit = there == want
            out[open_[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            open_, want, slots = open_[on], want[on], (slots[on] + 1) & self.mask
        return out


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.table = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens, starts, sizes = joined(sorted(ranks, key=ranks.get), unit=1)
        self.starts, self.sizes = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, np.int64)
        self.starts[sorted(ranks.values())], self.sizes[sorted(ranks.values())] = starts, sizes
        self.cut = regex.compile(pattern).findall
        self.encoder = Encoder("spaced", self.merge_words, self._encode_chunks)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cuts = [self.cut(c) for c in chunks]
        words = list(set().union(*cuts))
        get = dict(zip(words, self.merge_words(words))).__getitem__
        return [b"".join(map(get, c)) for c in cuts]

    def merge_words(self, words: list[str]) -> list[bytes]:
        return self.merge_all([w.encode() for w in words])

    def merge_all(self, raw: list[bytes]) -> list[bytes]:
        """ids of each byte string as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(raw)
        todo = sorted((k for k, token in enumerate(raw) if token), key=lambda k: len(raw[k]))
        at = 0
        while at < len(todo):
            longest = max(8, len(raw[todo[at]]) * 5 // 4)
            rows = []
            while at < len(todo) and len(rows) < max(1, min(ROWS, CELLS // longest)) and len(raw[todo[at]]) <= longest:
                rows.append(todo[at])
                at += 1
            self._merge_rows([raw[k] for k in rows], rows, out)
        return out

    def _merge_rows(self, raw: list[bytes], rows: list[int], out: list[bytes]) -> None:
        lengths = np.array([len(r) for r in raw], np.int64)
        width = int(lengths.max())
        ids = np.full((len(raw), width + 2), -1, np.int32)
        ids[:, :width][np.arange(width)[None, :] < lengths[:, None]] = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        index = np.array(rows)
        ranks = np.full(ids.shape, NONE, np.int32)  # of the pair that begins at a place
        ranks[:, :width] = self.table.look(ids[:, :width].ravel(), ids[:, 1 : width + 1].ravel()).reshape(len(raw), width)
        while True:
            least = ranks.min(1)
            done = least == NONE
            if done.any():
                for k, row, n in zip(index[done], ids[done], lengths[done], strict=True):
                    out[k] = row[:n].astype("<u4").tobytes()
                on = ~done
                if not on.any():
                    return
                index, ids, ranks, lengths, least = index[on], ids[on], ranks[on], lengths[on], least[on]
            row, at = self._merged(ranks, least)
            value = least[row]
            chained = np.zeros(len(row), bool)  # the merge before this one ends where this one begins
            chained[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 2)
            before = np.where(chained, value, np.where(at > 0, ids[row, at - 1], -1))
            left, right = np.split(self.table.look(np.concatenate([before, value]), np.concatenate([value, ids[row, at + 2]])), 2)
            # Where a merge makes a pair of less rank, that pair comes next: such a row merges its leftmost pair alone.
            early = np.unique(row[(left < value) | (right < value)])
            if len(early):
                first = np.append(True, row[1:] != row[:-1])
                stay = first | ~np.isin(row, early)
                row, at, value, chained, left, right = (x[stay] for x in (row, at, value, chained, left, right))
            ids[row, at] = value
            ranks[row, at] = right
            later = at > 0
            gone = np.zeros(ids.shape, bool)
            gone[row, at + 1] = True
            previous = np.where(chained, at - 2, at - 1)
            ranks[row[later], previous[later]] = left[later]
            lengths = lengths - np.bincount(row, minlength=len(ids))
            ids, ranks = self._closed(ids, ranks, gone, lengths)

    def _merged(self, ranks: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places of the pairs of least rank, from the left and without overlaps."""
        row, at = np.nonzero(ranks == least[:, None])
        touching = np.zeros(len(row), bool)
        touching[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1)
        if not touching.any():
            return row, at
        run = np.maximum.accumulate(np.where(touching, 0, np.arange(len(row))))
        every_other = (np.arange(len(row)) - run) % 2 == 0
        return row[every_other], at[every_other]

    def _closed(self, ids: np.ndarray, ranks: np.ndarray, gone: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows moved together over the places that are gone."""
        stays = (ids >= 0) & ~gone
        room = np.arange(int(lengths.max()) + 2)[None, :] < lengths[:, None]
        new_ids, new_ranks = np.full(room.shape, -1, np.int32), np.full(room.shape, NONE, np.int32)
        new_ids[room], new_ranks[room] = ids[stays], ranks[stays]
        return new_ids, new_ranks

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the offsets between texts."""
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.tokens, self.starts[ids], self.sizes[ids]).tobytes()


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        ids, ends = coder(ranks, pattern).encode(block.column("text"))
        return [block.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))]

    return map_texts(slim, make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that each row's ids stand for."""

    def run(batches):
        for batch in batches:
            bpe = coder(ranks, pattern)
            rows = [None if ids is None else bpe.decode(np.asarray(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids, and gives the digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        bpe = coder(ranks, pattern)
        ids, ends = bpe.encode(block.column("text"))
        raw, decoded, at = memoryview(ids.view(np.uint8)), [], ends.tolist()
        for i, j in zip(at, at[1:]):
            decoded.append(hashlib.sha256(bpe.decode(ids[i:j])).hexdigest())
        return [
            block.column("doc_id"),
            pa.array(np.diff(ends)),
            pa.array([hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(at, at[1:])], pa.string()),
            pa.array(decoded, pa.string()),
        ]

    return map_texts(slim, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
