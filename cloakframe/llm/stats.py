"""Statistics of a text as Spark column expressions, row-local and without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: White space that parts words: tab to carriage return, and space.
SPACE = r"[\x09-\x0D\x20]+"
REPEAT = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share",
    "line_words", "stop_share", "log_words",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text.

    Windows are compared by 64-bit hashes; texts without an equal pair, nearly
    all of them, end after one hash set, the others sort their windows.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.when(k == 0, REPEAT).otherwise(F.least(F.lit(REPEAT), s - F.get(starts, k - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def marked(order: Column) -> Column:
        def twice(w: Column, k: Column) -> Column:
            before = F.coalesce((k > 0) & (F.get(order, k - 1)["h"] == w["h"]), F.lit(False))
            return before | F.coalesce(F.get(order, k + 1)["h"] == w["h"], F.lit(False))

        return F.transform(F.filter(order, twice), lambda w: w["i"])

    def over(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(ordered, marked), lambda starts: let(F.array_sort(starts), covered))
        )

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(each) - (REPEAT - 1)), lambda i: F.xxhash64(F.slice(each, i, REPEAT)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < REPEAT, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), over))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as long as a column has that name."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def counted(docs: DataFrame, text: str = "text", repeats: bool = True, stats: str = "stats") -> DataFrame:
    """``docs`` with one column more, ``stats``: the base counts and the features of every whole text.

    A null text counts as empty; shares of nothing are 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def each(words: Column, lines: Column) -> Column:
        def put(w: Column, lined: Column) -> Column:
            n = F.size(w).cast("long")
            chars = F.length(F.array_join(w, "")).cast("long")
            dup = (F.size(lined) - F.size(F.array_distinct(lined))).cast("long")
            return F.struct(
                n.alias("n_words"), chars.alias("word_chars"), F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                dup.alias("n_dup_lines"), (repeated(w) if repeats else F.lit(0).cast("long")).alias("n_repeat_words"),
                F.size(lined).cast("long").alias("n_lines"), F.regexp_count(body, F.lit("[A-Z]")).cast("long").alias("n_upper"),
                F.regexp_count(body, F.lit("[0-9]")).cast("long").alias("n_digits"), F.regexp_count(body, F.lit("[!?]")).cast("long").alias("n_marks"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
            )

        return let(words, lambda w: let(lines, lambda x: put(w, x)))

    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    return docs.withColumn(stats, each(words, lines))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def feature_columns(stats: str = "stats") -> dict[str, Column]:
    """The features by name, from a ``stats`` column."""
    s = F.col(stats)
    made = {
        "mean_word": share(s["word_chars"], s["n_words"]),
        "symbol_share": share(s["n_symbols"], s["word_chars"]),
        "dup_line_share": share(s["n_dup_lines"], s["n_lines"]),
        "repeat_share": share(s["n_repeat_words"], s["n_words"]),
        "upper_share": share(s["n_upper"], s["word_chars"]),
        "digit_share": share(s["n_digits"], s["word_chars"]),
        "mark_share": share(s["n_marks"], s["n_words"]),
        "distinct_share": share(s["n_distinct"], s["n_words"]),
        "line_words": share(s["n_words"], s["n_lines"]),
        "stop_share": share(s["n_short"], s["n_words"]),
        "log_words": F.log(s["n_words"] + F.lit(1.0)),
    }
    assert list(made) == FEATURES
    return made
