"""Cutting texts where tokenizers always cut, so that what repeats within a corpus is encoded once a worker.

A block of texts is cut by Arrow, its distinct chunks are found by dictionary encoding and parted into a word and the
signs after it, and only distinct words meet Python; numpy then puts the ids of all chunks in their places. What a
worker has met before is remembered within bounds.

Two kinds of cut. "spaced", for byte-level tokenizers: before each space that no blank follows, since a match takes
such a space as its first character and blanks before it never join it; and around a line end between two others.
"folded", for tokenizers that drop white space and case: at ASCII blanks. Matches within chunks of Latin-1 characters
go to the library's model one by one; all others, and texts that hold the string of an added token, go to the library
as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from itertools import chain, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Recent

#: Stands at the start of a chunk for a line end instead of a space before it; texts that hold it are encoded whole.
LINE = "\x01"
#: Two blanks in a row, of any kind that Unicode or Python has (RE2).
_RUNS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
#: Characters that compose with a letter before them, so that its case matters.
_MARKS = r"[\x{0300}-\x{036f}]"
#: A chunk of a word and signs, without apostrophes, digits and blanks.
_SIMPLE = r"^(?P<word>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
#: Characters that no normaliser of a known file changes but for their case, and whose classes never change.
_PLAIN = re.compile("[\t\n\r -~\xa1-\xff]+")
_LINE_END, _BEFORE_WORD = re.compile(r"(?<!\s)\n(?=\S)"), re.compile(r" (?=\S)")


def spaced_chunks(text: str) -> list[str]:
    """The first chunk and, without the space that they start with, the others, where blanks may follow each other."""
    return _BEFORE_WORD.split(_LINE_END.sub(" " + LINE, text))


def strings(array: pa.Array) -> list[str]:
    """What to_pylist() gives for strings without nulls, by the faster way over an array of objects."""
    return array.to_numpy(zero_copy_only=False).tolist()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts and have these sizes, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def joined(found: list[bytes], unit: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values in all of found, and where those of each begin and how many there are."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // unit
    return np.frombuffer(b"".join(found), "<u4" if unit == 4 else np.uint8), np.cumsum(sizes) - sizes, sizes


class Encoder:
    """ids of texts by chunks, as little-endian 32-bit bytes.

    encode_words gives the ids of matches, encode_all those of any strings. specials are strings whose texts go to
    encode_all whole. At most `most` words and a quarter as many other chunks are remembered.
    """

    def __init__(self, kind: str, encode_words: Callable[[list[str]], Iterable[bytes]], encode_all: Callable[[list[str]], Iterable[bytes]], specials: tuple[str, ...] = (), most: int = 600_000):
        self.spaced, self.encode_words, self.encode_all = kind == "spaced", encode_words, encode_all
        self.specials = (*specials, LINE) if self.spaced else specials
        self.words, self.seen = Recent(most), Recent(most // 4)
        self.line = b"".join(encode_all(["\n"])) if self.spaced else b""

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the offsets between texts."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = np.zeros(len(texts), bool)
        for special in self.specials:
            odd |= pc.match_substring(texts, special, ignore_case=not self.spaced).to_numpy(zero_copy_only=False)
        by = pc.match_substring_regex(texts, _RUNS if self.spaced else _MARKS).to_numpy(zero_copy_only=False)
        parts = []
        for rows, way in ((~odd & ~by, self._cut), (~odd & by, self._cut_with_care), (odd, self._whole)):
            at = np.flatnonzero(rows)
            if len(at):
                parts.append((at, *way(texts if len(at) == len(texts) else texts.take(pa.array(at)))))
        if len(parts) == 1:
            return parts[0][1], parts[0][2]
        starts, sizes, before = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        for at, ids, offsets in parts:
            starts[at], sizes[at] = offsets[:-1] + before, np.diff(offsets)
            before += len(ids)
        ids = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, "<u4")
        return gathered(ids, starts, sizes), np.append(0, np.cumsum(sizes))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            return self._placed(pc.split_pattern(pc.replace_substring(texts, "\n", " " + LINE), " "))
        return self._placed(pc.ascii_split_whitespace(pc.ascii_lower(texts)))

    def _cut_with_care(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            return self._placed(pa.array(list(map(spaced_chunks, texts.to_pylist())), pa.list_(pa.string())))
        return self._placed(pc.ascii_split_whitespace(texts))

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, starts, sizes = joined(list(self.encode_all(texts.to_pylist())))
        return ids, np.append(starts, len(ids))

    def _new_words(self, words: list[str]) -> Iterable[bytes]:
        if not self.spaced:
            return self.encode_words([w.lower() for w in words])
        found = self.encode_words([w[1:] if w[0] == LINE else " " + w for w in words])
        return [self.line + f if w[0] == LINE else f for w, f in zip(words, found, strict=True)]

    def _new_chunks(self, chunks: list[str]) -> Iterable[bytes]:
        return self.encode_all([("\n" + c[1:] if c[:1] == LINE else " " + c) for c in chunks] if self.spaced else chunks)

    def _placed(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        flat = pc.list_flatten(cut)
        offsets = np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False)))
        coded = flat.dictionary_encode()
        chunk, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        # The distinct chunks are words with signs, or others; the ids of each are those of two entries of a pool.
        parted = pc.extract_regex(distinct, _SIMPLE.replace("[", r"\x01?[", 1) if self.spaced else _SIMPLE)
        simple = parted.is_valid().to_numpy(zero_copy_only=False)
        words, signs = (parted.field(k).filter(parted.is_valid()).dictionary_encode() for k in (0, 1))
        others = distinct.filter(pa.array(~simple))
        pool = [b"", *self.words.values(strings(words.dictionary), self._new_words), *self.encode_words(strings(signs.dictionary)), *self.seen.values(strings(others), self._new_chunks)]
        n_words, n_signs = len(words.dictionary), len(signs.dictionary)
        entry = np.zeros((len(distinct), 2), np.int64)
        entry[simple, 0] = words.indices.to_numpy(zero_copy_only=False) + 1
        entry[simple, 1] = signs.indices.to_numpy(zero_copy_only=False) + 1 + n_words
        entry[~simple, 0] = np.arange(len(others)) + 1 + n_words + n_signs
        if self.spaced:
            first = self.encode_all(strings(flat.take(pa.array(offsets[:-1]))))
            chunk[offsets[:-1]] = len(entry) + np.arange(len(cut))
            entry = np.concatenate([entry, np.stack([len(pool) + np.arange(len(cut)), np.zeros(len(cut), np.int64)], 1)])
            pool += first
        raw, starts, sizes = joined(pool)
        raw, sizes = gathered(raw, starts[entry].ravel(), sizes[entry].ravel()), sizes[entry].sum(1)
        starts = np.cumsum(sizes) - sizes
        ends = np.append(0, np.cumsum(sizes[chunk]))
        return gathered(raw, starts[chunk], sizes[chunk]), ends[offsets]


def ended(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte: itself where it is one, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_ALPHABET = _byte_alphabet()

# The matches of the two kinds of tokenizer.
MATCHES = {
    "spaced": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "folded": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: What is tried to see that a file is of its kind.
_TRIED = {
    "spaced": ("the", " the", " Straße", "über", " naïveté's", " X.Y,", " zzyzxq-12 ", " a\n\nb  c", "<s>"),
    "folded": ("the", "Straße", "über", "NAÏVETÉ's", "x.y,", "zzyzxq-12", "<s>"),
}


def library_encoder(path: str, kind: str, most: int = 600_000) -> Encoder:
    """An Encoder by the tokenizers library: its ids without special tokens around a text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, cut = tokenizer.model, regex.compile(MATCHES[kind]).findall
    specials = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

    def written(word: str) -> str:
        """A match in the alphabet of the library's model, which writes printable ASCII as it is."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", _ALPHABET[32])
        return word.encode().decode("latin-1").translate(_ALPHABET)

    def by_model(words: list[str]) -> list[bytes]:
        tokenize, id_of = model.tokenize, attrgetter("id")
        found = [list(map(id_of, tokenize(written(w)))) if w else [] for w in words]
        ends = np.cumsum([0, *map(len, found)]) * 4
        raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        return [raw[i:j] for i, j in pairwise(ends.tolist())]

    def by_matches(chunk: str) -> bytes:
        return b"".join(by_model(cut(chunk if kind == "spaced" else chunk.lower())))

    def by_library(chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(chunks[at : at + 4096], add_special_tokens=False)]
        return out

    direct = list(map(by_matches, _TRIED[kind])) == by_library(list(_TRIED[kind]))

    def encode_all(chunks: list[str]) -> list[bytes]:
        plain = [direct and len(c) < 64 and _PLAIN.fullmatch(c) is not None and not any(s in c for s in specials) for c in chunks]
        other = iter(by_library([c for c, p in zip(chunks, plain) if not p]))
        return [by_matches(c) if p else next(other) for c, p in zip(chunks, plain)]

    return Encoder(kind, by_model if direct else by_library, encode_all, specials, most)


_encoders: dict[tuple[str, str], Encoder] = {}


def shared_encoder(path: str, kind: str, most: int = 600_000) -> Encoder:
    """This worker's encoder of a tokenizers file; kind: "spaced" for byte-level ones, "folded" where blanks and case are dropped."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = library_encoder(path, kind, most)
    return _encoders[path, kind]
