"""Fill-in-the-middle: each text is cut at two places by one regular expression whose counts are the row's own.

A unit is one code point (``(?s).``). ``regexp_count`` gives the number n of units; the pattern of a row is ``(unit{a}+)(unit{b-a}+)(unit*+)``, all
possessive, so a text is walked once and never backed into, and one replacement by groups puts the three parts in the order of the row's form. All of it
is built-in functions: a projection without a shuffle, a row at a time, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units that one match of the counting pattern takes: ``regexp_count`` lists its matches, and a list of blocks is a thousandth of one of code points.
BLOCK = 1024
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are left plain, and of 100 others so many begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20


def units(text: Column) -> Column:
    """The number of code points: matches of a whole block, and single ones in what those leave."""
    block = F.lit(rf"(?s)\G.{{{BLOCK}}}+")
    rest = F.regexp_replace(text, block, F.lit(""))
    return F.regexp_count(text, block).cast("long") * BLOCK + F.regexp_count(rest, F.lit("(?s).")).cast("long")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 of a row: the first four groups of eight digits of the SHA-256 of seed and key. A null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``docs`` with n, form (plain, psm, spm), prefix_chars and middle_chars (null if plain) and output.

    A text that is empty (or null, which counts as empty) or that holds one of the marks stays plain, as do ``PLAIN`` of 100 others. Rows that repeat, or
    that repeat an id, are rows of their own and get the same cut; a null id has a cut of its own; an empty table gives no rows. Texts are cut whole at
    any length. A column of docs that has the name of one of the results gives way to it; others pass through.
    """
    h1, h2, h3, h4 = draws(F.col(key), seed)
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    body = F.coalesce(F.col(text), F.lit(""))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]).alias("_row")  # in one, so that no name of theirs meets one used here
    rows = docs.select(own, body.alias("_t"), *[h.alias(f"_h{i}") for i, h in enumerate((h1, h2, h3, h4))]).withColumn("n", units(F.col("_t")))
    marked = F.contains("_t", F.lit(PREFIX)) | F.contains("_t", F.lit(SUFFIX)) | F.contains("_t", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (F.col("_h2") % 100 >= 100 - PLAIN), "plain").when(F.col("_h3") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    one, two = F.col("_h0") % (F.col("n") + 1), F.col("_h1") % (F.col("n") + 1)
    cut = F.col("form") != "plain"
    rows = rows.withColumn("form", form).withColumn("prefix_chars", F.when(cut, F.least(one, two))).withColumn("middle_chars", F.when(cut, F.abs(one - two)))
    count = lambda c: F.col(c).cast("string")
    pattern = F.concat(F.lit(r"(?s)\A(.{"), count("prefix_chars"), F.lit("}+)(.{"), count("middle_chars"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(cut, F.regexp_replace("_t", pattern, order)).otherwise(F.col("_t"))
    return rows.withColumn("output", output).select("_row.*", *made)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. No part holds a mark, and no mark can arise where a part meets one, so the first of each is the cut."""
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
