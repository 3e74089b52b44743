"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = r"[#*$%&|<>]"
#: Function words of the languages in use (fixed values).
STOP_WORDS = tuple(
    "the of and to in is that it for on with as are be by this was at or an "
    "der die das und in zu den von mit ist im nicht ein eine auf für "
    "le la les de des du et en un une est que qui dans pour sur par au avec pas "
    "el los las del y en que un por con para es al se no su como".split()
)
#: name, measure, lowest, highest (None: open). A document is kept if every measure is within its bounds.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 50, None),
    ("mean_word", "mean_word_chars", 2, 15),
    ("symbols", "symbol_ratio", None, 0.25),
    ("stop_words", "stop_word_ratio", 0.005, None),
    ("dup_lines", "dup_line_ratio", None, 0.5),
    ("bang_words", "bang_ratio", None, 0.5),
    ("repeats", "repeat_ratio", None, 0.5),
)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: windows are sorted with their places; equal neighbours repeat."""

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: (i >= 0) & (j < n) & (F.get(s, i)["w"] == F.get(s, j)["w"])
        hits = F.filter(s, lambda x, i: F.coalesce(same(i - 1, i), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["i"], x["i"] + 2)))))

    def windows(ws: Column) -> Column:
        n = F.size(ws)
        each = F.transform(F.slice(ws, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.concat(w, F.lit(" "), F.get(ws, i + 1), F.lit(" "), F.get(ws, i + 2)).alias("w"), i.alias("i")))
        distinct = lambda e: F.size(F.array_distinct(F.transform(e, lambda x: x["w"])))
        return _let(each, lambda e: F.when(distinct(e) == F.size(e), F.lit(0)).otherwise(_let(F.array_sort(e), covered)))

    return _let(words, windows)


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with measures, base_failed, `failed_rules` (names) and kept.

    The whole text counts; a null text has no words, like an empty one, and fails `length`. Ratios of documents
    without words are 0. Rows are judged one by one, so repeated rows agree. Columns of docs with the names of
    measures are replaced. There is no join, no exchange and no user function: a row's work grows as n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    base = docs.withColumns({"__words": words, "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))})
    n = F.size("__words").cast("long")
    base = base.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(_repeat_words(F.col("__words")), F.lit(0)).cast("long"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
            "n_bang_words": F.size(F.filter("__words", lambda w: w.endswith("!!"))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
        }
    )
    per = lambda c, of: F.coalesce(F.col(c) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    base = base.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "stop_word_ratio": per("n_stop_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "bang_ratio": per("n_bang_words", "n_words"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
        }
    )
    breaks = []
    for name, measure, low, high in rules:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(measure) < low)
        if high is not None:
            bad = bad | (F.col(measure) > high)
        breaks.append(F.when(bad, F.lit(name)))
    out = base.withColumn("failed_rules", F.array_compact(F.array(*breaks)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__words", "__lines")
