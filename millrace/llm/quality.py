"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Rules are rows (metric, least, most); a text is kept when every metric lies within its bounds. Metrics are
counts and ratios of words, symbols, stop words and lines over the whole text. Nothing is sampled or cut, no
user function runs, and no row leaves its partition, so the cost is linear in the text.

Defined results: null and empty texts have no words, all counts 0, and fail the base rules; repeated rows are
judged one by one; an empty table gives an empty result; the input's other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# White space that parts words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# Frequent function words of the languages handled.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the this to was were which with you "  # en
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ou par pas pour que qui sa se ses son sur un une "  # fr
    "als am auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sich sie und von war wie zu zum "  # de
    "al como con del el en es esta la las lo los más no para pero por se sin su sus un una y "  # es
).split()


#: As they are written in lower case, at the start of a sentence, and in capitals.
STOP_FORMS = sorted({form for word in STOP_WORDS for form in (word, word.capitalize(), word.upper())})


@dataclass(frozen=True)
class Rule:
    """A text is kept if least <= metric <= most; a bound of None is open."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The method's verdict beside the base rules.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.05),  # symbols to code points in words
    Rule("marked_word_ratio", None, 0.30),  # words that end in two or more marks, such as "!!"
    Rule("stop_word_ratio", 0.06, None),
    Rule("dup_line_ratio", None, 0.50),
)


def _bind(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, few: int = 16) -> Column:
    """How many words lie in 3-word windows found twice or more in the text.

    Windows become 64-bit hashes, and sorting shows which occur again. Where these are at most `few` values, a scan
    finds their positions; else sorting (hash, position) pairs does, so that no text costs more than a sort. The
    words that the positions cover are the sum of min(3, distance to the next one).
    """

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>"))

    def by_scan(h: Column, again: Column) -> Column:
        flagged = F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i).otherwise(F.lit(-1)))
        return F.array_remove(flagged, -1)

    def by_sort(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _bind(pairs, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")),
            lambda acc: acc["n"],
        )

    def twice(h: Column) -> Column:
        return F.array_distinct(_bind(F.sort_array(h), lambda s: F.filter(s, lambda x, k: F.get(s, k - 1) == x)))

    def count(h: Column) -> Column:
        return _bind(
            twice(h),
            lambda again: F.when(F.size(again) == 0, F.lit(0)).otherwise(covered(F.when(F.size(again) <= few, by_scan(h, again)).otherwise(by_sort(h)))),
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _bind(_bind(hashed, windows), count).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of each text, beside its id and the columns in keep."""
    text = text_of(text_col)
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.struct(*keep).alias("_kept") if keep else F.lit(None).alias("_kept"),
        text.alias("_text"),
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    return split.select(
        "doc_id",
        "_kept",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
        F.regexp_count("_text", F.lit(r"[!?*#$%&~=_^]{2,}(?![^\x20\x09-\x0D])")).cast("long").alias("n_marked_words"),
    )


METRICS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "marked_word_ratio": ("n_marked_words", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each text's counts, base_failed and kept."""

    def within(rule: Rule) -> Column:
        over, under = METRICS[rule.metric]
        ok = F.lit(True)
        if rule.least is not None:
            ok &= F.col(over) >= F.lit(rule.least) * F.col(under)
        if rule.most is not None:
            ok &= F.col(over) <= F.lit(rule.most) * F.col(under)
        return ok

    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = measure(docs, id_col, text_col, keep).withColumn("base_failed", base)
    return counted.withColumn("kept", ~F.col("base_failed") & reduce(Column.__and__, map(within, rules)))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Null and empty texts go; ids aren't read; repeated rows are judged one by one; an empty table stays empty.
    """
    columns = docs.columns
    judged = judge(docs, rules, keep=tuple(columns)).where("kept")
    return judged.select(*[F.col("_kept")[c].alias(c) for c in columns])


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return judge(docs, rules).select(*COLUMNS)
