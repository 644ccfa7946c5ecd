"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Frequent short words of the languages at hand (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on are as with he be at by this from "
    "le la les de des du et en un une que qui dans pour par sur au est il "
    "der die das und zu den von mit ist des im für auf ein eine nicht dem "
    "el y a los se del las con una su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` is within low and high, either of which may be absent."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


BASE_RULES = [Rule("words", "n_words", low=20), Rule("repeats", "repeat_words_percent", high=30)]
RULES = [
    Rule("word_length", "mean_word_chars", low=2, high=12),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("stop_words", "stop_word_share", low=0.02),
    Rule("repeated_lines", "repeated_line_share", high=0.6),
]


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once: the value is bound as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words that windows at ascending starts cover."""
    gaps = F.transform(starts, lambda s, i: F.when(i + 1 < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, i + 1) - s)).otherwise(F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside windows whose hash is found twice or more in the text.

    Most texts have no such window, which a set of hashes shows; only the others
    are sorted, so that equal hashes meet.
    """

    def of(hashes: Column) -> Column:
        def sort(pairs: Column) -> Column:
            h = lambda i: F.get(pairs, i)["h"]
            twice = F.filter(F.transform(pairs, lambda p, i: F.when((p["h"] == h(i - 1)) | (p["h"] == h(i + 1)), p["i"])), lambda p: p.isNotNull())
            return let(F.sort_array(twice), _covered)

        spread = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(spread), sort))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, let(windows, of)).otherwise(F.lit(0).cast("long"))


def measures(text: str) -> Column:
    """Base measures of a text column as one struct."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            (F.size(F.split(t, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"), F.size(x).cast("long").alias("all"))).alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.translate(w, UPPER, UPPER.lower()).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(F.filter(F.split(t, SPACES + "+", -1), lambda w: F.length(w) > 0), of_words)


def compile_rules(rules: list[Rule], of: dict[str, Column]) -> Column:
    """One boolean: all rules hold."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (of[r.measure] >= r.low)
        if r.high is not None:
            out = out & (of[r.measure] <= r.high)
    return out


def assess(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, base: list[Rule] = BASE_RULES) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    ``base_failed`` says that a base rule is broken, and ``kept`` that neither a
    base rule nor one of ``rules`` is.  A value on a threshold is within it.

    Null and empty texts have no words and fail.  Texts are judged whole at any
    length, each row by its text alone, so repeated rows get the same.  An empty
    table gives no rows.  Other columns pass through; those with the names above,
    in any case, are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    m = docs.select(*rest, measures(text).alias("__m"))
    x = {c: F.col(f"__m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")}
    words, lines = F.greatest(x["n_words"], F.lit(1)), F.greatest(F.col("__m.lines.all"), F.lit(1))
    of = {
        "n_words": x["n_words"],
        "repeat_words_percent": x["n_repeat_words"] * 100 / words,
        "mean_word_chars": x["word_chars"] / words,
        "symbols_per_word": x["n_symbols"] / words,
        "stop_word_share": x["n_stop_words"] / words,
        "repeated_line_share": F.col("__m.lines.again") / lines,
    }
    good = compile_rules(base, of)
    return m.select(
        *rest, x["n_words"].alias("n_words"), x["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), F.col("__m.lines.again").alias("n_dup_lines"), x["n_repeat_words"].alias("n_repeat_words"),
        (~good).alias("base_failed"), (good & compile_rules(rules, of)).alias("kept"),
    )
