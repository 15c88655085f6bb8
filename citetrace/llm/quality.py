"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on with as are be by this from or an at a have not "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es werden "
    "le la les de des du et un une que qui dans en pour est sur pas par au avec elle "
    "el los las y del se por con una su para al lo como mi esta"
).split()

#: (rule, numerator, denominator, low, high): kept where low * denominator <= 1000 * numerator <= high * denominator.
#: The bounds are in thousandths, so the comparison is in whole numbers; None is open.
THRESHOLDS = (
    ("length", "n_words", None, 50_000, None),
    ("mean_word", "word_chars", "n_words", 2_500, 14_000),
    ("symbols", "n_symbols", "n_words", None, 100),
    ("stop_words", "n_stop_words", None, 2_000, None),
    ("line_repeats", "n_dup_lines", "n_lines", None, 500),
    ("word_repeats", "n_repeat_words", "n_words", None, 500),
)

SPACES = "[\\x20\\x09-\\x0D]+"


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts that the rules compare. All are linear in the text, or a sort of its words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    squeezed = F.translate(t, " \t\n\x0b\f\r", "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    df = df.select(
        "*",
        F.filter(F.split(t, SPACES, -1), lambda x: x != "").alias("_w"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    # hashes of the three words from each word on; order and place are kept
    w = F.col("_w")
    grams = F.when(
        F.size(w) >= 3,
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select("*", grams.alias("_g"))
    # only a text that repeats one at all sorts (hash, place) to find which
    g = F.col("_g")
    ordered = F.when(
        F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.select("*", ordered.alias("_o"))
    o = F.col("_o")
    again = F.filter(
        F.transform(o, lambda x, i: F.when((F.get(o, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(o, i - 1)["h"] == x["h"])), x["i"])), lambda x: x.isNotNull()
    )
    df = df.select("*", F.sort_array(again).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    ).drop("_w", "_l", "_g", "_o", "_p")


def compiled(thresholds=THRESHOLDS) -> Column:
    """The rules that a row fails, as an array of their names."""
    fails = []
    for rule, over, under, low, high in thresholds:
        a, b = F.col(over) * 1000, F.col(under) if under else F.lit(1)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (a < low * b)
        if high is not None:
            bad = bad | (a > high * b)
        fails.append(F.when(bad, F.lit(rule)))
    return F.filter(F.array(*fails), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(doc_id, counts, base_failed, failed, kept) of every row; null, empty and blank texts have no words and fail."""
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counts(own)
        .drop("text")
        .select("*", base.alias("base_failed"), compiled(thresholds).alias("failed"))
        .select("*", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
    )


def keep_good(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, in the same scan; columns as they were."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # a generator, not a filter: a filter would be pushed below the counts and repeat them in each of its terms
    verdict = ~base & (F.size(compiled(thresholds)) == 0)
    return counts(row, "_text").select(F.explode(F.when(verdict, F.array("_row"))).alias("_row")).select("_row.*")
