"""Ranked title search: the best works for each title by BM25 over an inverted index, without listing the works of common words.

Scores are whole numbers. A first round scores, in full, the works that hold a title's rarest words and the best few works of each of its words; the k-th
score so far is a bound to beat. A work that was not looked at holds only words that were not: if the most that those can give together is below the bound, it
is out, and words are left out in this sense from the least on while that holds. If only the most common word is left out, the bound is not needed: a work with
that word alone is behind the best few of the word, which were looked at. All other words of the title are listed in a second round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrace.functions import identifiers as ids
from citetrace.operators.seeds import title_key
from citetrace.plans.storage import materialise

#: Works that the rarest words of a title may bring in the first round.
FIRST = 200


def _terms(rows: DataFrame, key: str, title: str) -> DataFrame:
    """(key, term, tf, n): the words of each title with how often they occur, and the number of its words."""
    words = F.filter(F.split(title_key(F.col(title)), " "), lambda w: w != "")
    each = rows.select(F.col(key), words.alias("_w")).where("size(_w) > 0").select(key, F.size("_w").alias("n"), F.explode("_w").alias("term"))
    return each.groupBy(key, "term", "n").agg(F.count("*").alias("tf"))


def index(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (term, node_id, impact) and words (term, df, bound) of the works' titles, written. The impact is what a word adds to a work's score, if anything; bound is its largest."""
    t = materialise(_terms(works.where("node_id is not null"), "node_id", "title"), "title-terms")
    size = t.dropDuplicates(["node_id"]).agg(F.count("*").alias("docs"), F.sum(F.col("n").cast("long")).alias("total"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).cast("long")
    norm = 300 + F.expr("(900L * n * docs) div total")
    weighed = t.join(df, "term").crossJoin(size).withColumn("w", weight).withColumn("m", norm)  # size is one row
    postings = materialise(weighed.select("term", "node_id", F.expr("(w * 2200 * tf) div (1000 * tf + m)").alias("impact")).where("impact > 0"), "title-postings")
    words = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("bound"))
    return postings, materialise(words, "title-words")


def search(seeds: DataFrame, works: DataFrame, k: int = 5, first: int = FIRST) -> DataFrame:
    """(record_id, rank, node_id, score): the k works (node_id, title) of the highest scores above 0 for each seed's title, equal scores by id.

    Titles are compared as ``title_key`` has them; a seed without words, or with none that a work has, has no rows. record_id and node_id are keys.
    """
    postings, words = index(works)
    asked = _terms(seeds, "record_id", "title").select("record_id", "term").join(words, "term")
    rare = Window.partitionBy("record_id").orderBy("df", "term")  # a title's words
    last = Window.partitionBy("record_id").orderBy(F.col("df").desc(), F.col("term").desc())
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = asked.withColumn("_first", (before + F.col("df") <= first) & (F.row_number().over(last) > 1)).withColumn("_commonest", F.row_number().over(last) == 1)
    asked = materialise(asked, "title-queries")
    best = Window.partitionBy("term").orderBy(F.col("impact").desc(), "node_id")
    champions = materialise(
        postings.join(asked.select("term").distinct(), "term", "left_semi").withColumn("_p", F.row_number().over(best)).where(F.col("_p") <= k).select("term", "node_id"), "title-champions"
    )  # at most k a word

    def listed(which: DataFrame, where: DataFrame) -> DataFrame:
        return which.select("record_id", "term").join(where.select("term", "node_id"), "term").select("record_id", "node_id")

    def scored(pairs: DataFrame) -> DataFrame:
        """Whole scores of pairs: each with all of its title's words, by the key of word and work."""
        each = pairs.join(asked.select("record_id", "term"), "record_id")
        return each.join(postings, ["term", "node_id"]).groupBy("record_id", "node_id").agg(F.sum("impact").alias("score"))

    start = listed(asked.where("_first"), postings).unionByName(listed(asked, champions)).distinct()
    start = materialise(scored(start), "title-scores")
    order = Window.partitionBy("record_id").orderBy(F.col("score").desc(), "node_id")
    floor = start.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("record_id", F.col("score").alias("floor"))
    least = Window.partitionBy("record_id").orderBy("bound", F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, 0)
    left = asked.join(floor, "record_id", "left").withColumn("_upto", F.sum("bound").over(least))
    out = F.coalesce(F.col("_upto") < F.col("floor"), F.lit(False))
    some = F.max(out).over(Window.partitionBy("record_id"))
    more = left.withColumn("_out", F.when(some, out).otherwise(F.col("_commonest"))).where("not _out and not _first")
    rest = listed(more, postings).distinct().join(start.select("record_id", "node_id"), ["record_id", "node_id"], "left_anti")
    both = start.unionByName(scored(rest))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("record_id", "rank", "node_id", "score")


def resolve(seeds: DataFrame, works: DataFrame, k: int = 5) -> DataFrame:
    """(record_id, node_id): of the k best works for a seed's title the first that has its author, else the first (works: node_id, title, authors)."""
    found = search(seeds, works, k).join(works.select("node_id", "authors"), "node_id")
    found = found.join(seeds.select("record_id", F.lower(ids.author_last_name(F.col("author"))).alias("_last")), "record_id")
    hit = F.coalesce(F.exists("authors", lambda a: F.lower(a).contains(F.col("_last"))), F.lit(False))
    return found.groupBy("record_id").agg(F.min_by("node_id", F.struct((~hit).alias("miss"), "rank")).alias("node_id"))
