"""Token counts under a unigram vocabulary, without building the tokens.

Words (a text cut before each blank, which becomes U+2581) are scored once a worker: an Aho-Corasick automaton
enumerates every vocabulary piece that ends at each position, and dynamic programming carries the best score and
the number of pieces on the path to it. Ties follow the tokenizer: a later candidate must be strictly better, and
candidates come in order of their start, so the longest of equally good pieces wins. A character that is no piece
costs the least score of the vocabulary less 10; runs of such characters are fused and fall back to their bytes
where the vocabulary has byte pieces, else count as one unknown token.

A block's distinct words are found by Arrow. The automaton runs over many words at once, and the programme takes a
step of all of them at a time; words of more than LONG characters are taken alone, character by character.

The vocabulary is a parameter: a sentencepiece model file, whose pieces and scores are read as they are. The
result equals the token count of the tokenizers library's Unigram model with the Metaspace pre-tokenizer.

Defined results: null and empty texts count 0 tokens with score 0; repeated rows are counted one by one; an empty
table gives an empty result; only the id and text columns are read. Cost is linear in the text, apart from words
without blanks, which cost their length times the longest piece; memory is bounded by the word cache.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import strings
from .common import Recent, map_texts

BLANK = "▁"
#: What an unknown character costs below the least score of the vocabulary.
UNKNOWN_COST = 10.0
#: Signs, and words of Latin letters and then signs (RE2).
SIGNS = "!$%&*,.:;?"
SIMPLE_WORD = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<signs>[!$%&*,.:;?]*)$"
#: Characters of words that are taken together, and how many of these at a time.
LONG, WORDS = 64, 20_000


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True, most: int = 600_000):
        import ahocorasick

        self.known = {piece for piece, _ in vocabulary}
        self.bytes = byte_fallback
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_COST
        self.pieces = ahocorasick.Automaton()
        for k, (piece, _) in enumerate(vocabulary):
            if piece:
                self.pieces.add_word(piece, k)
        self.pieces.make_automaton()
        self.lengths = np.array([len(piece) for piece, _ in vocabulary], np.int64)
        self.scores = np.array([score for _, score in vocabulary], np.float64)
        self.unknown = unknown
        self.plain = [(len(piece), score, k == unknown) for k, (piece, score) in enumerate(vocabulary)]
        self.seen = Recent(most)
        # A word of letters and then signs is the sum of both if no piece joins a letter to a sign, every sign is a piece
        # (so that no unknown run reaches over), and sums of scores are exact.
        joins = any(a.isalpha() and b in SIGNS for piece, _ in vocabulary for a, b in zip(piece, piece[1:]))
        self.parted = not joins and set(SIGNS) <= self.known and all(score == int(score) and abs(score) < 1 << 40 for _, score in vocabulary)

    def unknown_tokens(self, run: str) -> int:
        if run in self.known:
            return 1
        raw = run.encode()
        return len(raw) if self.bytes and all(f"<0x{b:02X}>" in self.known for b in raw) else 1

    def count(self, word: str) -> tuple[int, float]:
        """Tokens and best score of a word."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        score[0] = 0.0
        pieces, since = [0] * (n + 1), [-1] * (n + 1)  # since: where an unknown run that reaches here began
        at = 0
        best, found, single = None, None, False

        def close(end: int) -> None:
            nonlocal best
            if not single:
                value = score[end - 1] + self.unknown_score
                if best is None or value > best[0]:
                    best = (value, end - 1, True)
            score[end], start, odd = best
            if odd:
                since[end] = since[start] if since[start] >= 0 else start
                pieces[end] = pieces[start]
            else:
                pieces[end] = pieces[start] + 1 + (self.unknown_tokens(word[since[start] : start]) if since[start] >= 0 else 0)

        for last, found in self.pieces.iter(word):
            end = last + 1
            while at + 1 < end:
                at += 1
                close(at)
                best, single = None, False
            length, value, odd = self.plain[found]
            value += score[end - length]
            if length == 1:
                single = True
            if best is None or value > best[0] or (value == best[0] and end - length < best[1]):
                best = (value, end - length, odd)
        while at < n:
            at += 1
            close(at)
            best, single = None, False
        return pieces[n] + (self.unknown_tokens(word[since[n] : n]) if since[n] >= 0 else 0), score[n]

    def count_words(self, words: list[str]) -> list[tuple[int, float]]:
        """Tokens and best score of each word."""
        out: list[tuple[int, float]] = [(0, 0.0)] * len(words)
        short = sorted((k for k, w in enumerate(words) if len(w) <= LONG), key=lambda k: -len(words[k]))
        for at in range(0, len(short), WORDS):
            some = short[at : at + WORDS]
            for k, found in zip(some, self._count_together([words[k] for k in some]), strict=True):
                out[k] = found
        for k, word in enumerate(words):
            if len(word) > LONG:
                out[k] = self.count(word)
        return out

    def _count_together(self, words: list[str]) -> list[tuple[int, float]]:
        """The same for words of falling length, none of which holds a space: a place in their text is one of the programme."""
        text = " ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1
        score, pieces, since = np.zeros(len(text) + 1), np.zeros(len(text) + 1, np.int64), np.full(len(text) + 1, -1, np.int64)
        matches = np.fromiter(self.pieces.iter(text), np.dtype([("last", np.int64), ("piece", np.int64)]))
        word = np.searchsorted(first, matches["last"], "right") - 1
        step = matches["last"] - first[word] + 1
        inside = (step >= self.lengths[matches["piece"]]) & (step <= size[word])
        order = np.flatnonzero(inside)
        order = order[np.argsort(step[order], kind="stable")]  # by step, then word, then start: the longest piece first
        word, piece, step = word[order], matches["piece"][order], step[order]
        length = self.lengths[piece]
        bounds = np.searchsorted(step, np.arange(1, int(size[0]) + 2)) if len(size) else []
        for n in range(1, int(size[0]) + 1 if len(size) else 1):
            active = int(np.searchsorted(-size, -n, "right"))
            here = first[:active] + n
            best, start, odd, single = np.full(active, -np.inf), here - 1, np.ones(active, bool), np.zeros(active, bool)
            i, j = bounds[n - 1], bounds[n]
            if j > i:
                w, begin = word[i:j], first[word[i:j]] + n - length[i:j]
                value = score[begin] + self.scores[piece[i:j]]
                head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                top = np.maximum.reduceat(value, head)
                least = np.flatnonzero(value == np.repeat(top, np.diff(np.append(head, j - i))))
                least = least[np.append(True, w[least][1:] != w[least][:-1])]
                has = w[head]
                best[has], start[has], odd[has] = top, begin[least], piece[i:j][least] == self.unknown
                single[has] = length[i:j][np.append(head[1:], j - i) - 1] == 1  # the shortest comes last
            none = score[here - 1] + self.unknown_score
            other = ~single & (none > best)
            best[other], start[other], odd[other] = none[other], here[other] - 1, True
            score[here] = best
            run = since[start]
            since[here] = np.where(odd, np.where(run >= 0, run, start), -1)
            pieces[here] = pieces[start] + ~odd
            for k in np.flatnonzero(~odd & (run >= 0)):
                pieces[here[k]] += self.unknown_tokens(text[run[k] : start[k]])
        end = first + size
        for k in np.flatnonzero(since[end] >= 0):
            pieces[end[k]] += self.unknown_tokens(text[since[end[k]] : end[k]])
        return list(zip(pieces[end].tolist(), score[end].tolist()))

    def _known(self, words: list[str]) -> np.ndarray:
        """Both figures of distinct words as one number, which Python's collector needn't follow in what a worker remembers."""
        return np.array(self.seen.values(words, lambda new: (complex(*f) for f in self.count_words([BLANK + w for w in new]))), complex)

    def _distinct(self, words: pa.Array) -> np.ndarray:
        """The same for words, those of letters and signs by their parts where no piece joins the two."""
        if not self.parted:
            return self._known(strings(words))
        cut = pc.extract_regex(words, SIMPLE_WORD)
        simple = cut.is_valid().to_numpy(zero_copy_only=False)
        letters, signs = (cut.field(k).filter(cut.is_valid()).dictionary_encode() for k in (0, 1))
        out = np.zeros(len(words), complex)
        out[~simple] = self._known(strings(words.filter(pa.array(~simple))))
        after = np.array([complex(*f) for f in self.count_words(strings(signs.dictionary))], complex)
        if simple.any():
            out[simple] = self._known(strings(letters.dictionary))[letters.indices.to_numpy(zero_copy_only=False)] + after[signs.indices.to_numpy(zero_copy_only=False)]
        return out

    def count_texts(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and best scores of texts."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        tokens, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        if len(some):
            # A mark of a blank in a text is a blank; the first blank is the one that every text begins with.
            cut = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(texts.take(pa.array(some)), BLANK, " "), "^ ", ""), " ")
            coded = pc.list_flatten(cut).dictionary_encode()
            known = self._distinct(coded.dictionary)
            word = coded.indices.to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.append(0, pc.list_value_length(cut).to_numpy(zero_copy_only=False)))[:-1]
            tokens[some] = np.add.reduceat(known.real.astype(np.int64)[word], starts)
            scores[some] = np.add.reduceat(known.imag[word], starts)
        return tokens, scores


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


_counters: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(read_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and best_score (the sum over words) of each text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        tokens, scores = _counter(vocabulary).count_texts(block.column("text"))
        return [block.column("doc_id"), pa.array(tokens), pa.array(scores)]

    return map_texts(slim, make, "doc_id long, n_tokens long, best_score double")
