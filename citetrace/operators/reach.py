"""Exact reach and distinct counts by bitmaps over dense node numbers, without a row for each pair of seed and descendant.

Nodes are numbered from 1 by publication date, unknown dates first, so "after the notice" is "above a number" and a bucket of 32,768 numbers is a bitmap of 4 KB.
A seed whose second hop has few edges lists them; for a seed of many, the bitmaps of what it cites through are OR-ed: those of heavy parents are made once for
all seeds, light parents' few edges go straight into the seed's bitmap. How many papers come after some notice needs no pairs at all: the least notice that
reaches a paper is passed on from citer to citer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetrace.operators.ordered import running
from citetrace.plans.storage import materialise

#: Edges of a parent's second hop from which on it has a bitmap of its own, and the least number of edges from which on a seed is counted by bitmaps (or a
#: ``SPARSE``-th of all nodes, where that is more: a bitmap of few bits is larger than their rows).
HEAVY, LARGE, SPARSE = 512, 4096, 128
_BITS = 32768


def number_nodes(frontier: DataFrame, works: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """(node_id, n, depth, day): nodes up to depth k, and seeds (node_id) wherever they are, numbered from 1 by date and id. Written, so that all readers see the same numbers."""
    own = frontier.where(F.col("depth") <= k).select("node_id", "depth").unionByName(seeds.select("node_id", F.lit(None).cast("int").alias("depth")))
    nodes = own.groupBy("node_id").agg(F.min("depth").alias("depth")).join(works.select("node_id", F.col("publication_date").alias("day")), "node_id", "left")
    first = F.coalesce("day", F.lit("0001-01-01").cast("date"))
    return materialise(running(nodes, [first, F.col("node_id")], F.lit(1), "_n").select("node_id", (F.col("_n") + 1).alias("n"), "depth", "day"), "numbered-nodes")


def number_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_n, source_depth, target_n, depth, source_api), written; an end that has no number is null."""
    side = lambda end: nodes.select(F.col("node_id").alias(f"{end}_id"), F.col("n").alias(f"{end}_n"), F.col("depth").alias(f"{end}_depth"))
    both = edges.select("source_id", "target_id", "depth", "source_api").join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    return materialise(both.select("source_n", "source_depth", "target_n", "depth", "source_api"), "numbered-edges")


def bits(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, bucket, bitmap) of the numbers ``n`` of each key; made map-side, so a key of many rows is a few bitmaps a task."""
    rows = rows.where(F.col(n).isNotNull()).select(*keys, F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("_p"))
    return rows.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_p").alias("bitmap"))


def distinct(rows: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    """``keys`` with how many distinct numbers ``n`` each has."""
    return bits(rows, keys, n).groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))


def edge_depths(edges: DataFrame, k: int) -> DataFrame:
    """(depth, source_api, edge_count, distinct_sources, distinct_targets) of numbered edges whose ends all have numbers."""
    e, keys = edges.where(F.col("depth") <= k), ["depth", "source_api"]
    out = e.groupBy(*keys).agg(F.count("*").alias("edge_count"))
    for end in ("source", "target"):
        out = out.join(distinct(e, keys, f"{end}_n", f"distinct_{end}s"), keys)
    return out


def cuts(canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, seed_n, cut) of each seed: papers numbered above ``cut`` come after its notice; null without a notice date, since then none does."""
    per_day = nodes.groupBy(F.coalesce("day", F.lit("0001-01-01").cast("date")).alias("day")).agg(F.count("*").alias("_n"))
    asked = canonical.where("notice_date is not null").select(F.col("notice_date").alias("day"), F.lit(0).cast("long").alias("_n")).distinct()
    days = per_day.unionByName(asked).groupBy("day").agg(F.sum("_n").alias("_n"))  # at most one row a day of the calendar
    upto = days.select(F.col("day").alias("notice_date"), F.sum("_n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("cut"))
    seeds = canonical.select(F.col("node_id").alias("seed"), "notice_date").join(nodes.select(F.col("node_id").alias("seed"), F.col("n").alias("seed_n")), "seed")
    return seeds.join(upto, "notice_date", "left").select("seed", "seed_n", "cut")


def _above(bitmap: Column, bucket: Column, cut: Column) -> Column:
    """How many numbers of a bucket's bitmap are above ``cut``."""
    at = F.bitmap_bucket_number(cut)
    first = (cut - 1) % _BITS + 1  # position of the first number above, in the cut's own bucket
    byte, bit = F.floor(first / 8).cast("int"), (first % 8).cast("int")
    # the byte that holds it, and all bytes after that
    part = F.coalesce(F.conv(F.hex(F.substring(bitmap, byte + 1, 1)), 16, 10).cast("int"), F.lit(0))
    within = F.bit_count(F.call_function("shiftright", part, bit)) + F.bitmap_count(F.substring(bitmap, byte + 2, F.lit(_BITS // 8)))
    return F.when(cut.isNull() | (bucket < at), 0).when((cut == 0) | (bucket > at), F.bitmap_count(bitmap)).otherwise(within)


COUNTS = ("direct_citers", "depth2_descendants", "total_depth2_reach", "post_notice_direct_citers", "post_notice_depth2_descendants")


def _direct(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed_n, n): papers with a number that cite a seed by an edge of depth 1."""
    e = edges.where("depth = 1 and source_n is not null").select(F.col("source_n").alias("n"), F.col("target_n").alias("seed_n"))
    return e.join(seeds.select("seed_n"), "seed_n")


def _second(edges: DataFrame) -> DataFrame:
    """(via, n): papers of depth 2 with what they cite by an edge of depth 2."""
    return edges.where("depth = 2 and source_depth = 2 and target_n is not null").select(F.col("target_n").alias("via"), F.col("source_n").alias("n"))


def seed_metrics(canonical: DataFrame, nodes: DataFrame, edges: DataFrame, heavy: int = HEAVY, large: int = LARGE, sparse: int = SPARSE) -> DataFrame:
    """``canonical`` with direct citers, second-hop descendants, their union, and those after the notice (nodes, edges: numbered)."""
    seeds = materialise(cuts(canonical, nodes), "seed-cuts")
    direct = materialise(_direct(seeds, edges), "direct-citers")
    second = _second(edges)
    fan = second.groupBy("via").agg(F.count("*").alias("fan"))
    fanned = materialise(direct.select("seed_n", F.col("n").alias("via")).join(fan, "via"), "fanned")
    limit = F.greatest(F.lit(large), F.floor(F.count("*") / sparse)).alias("limit")
    work = fanned.groupBy("seed_n").agg(F.sum("fan").alias("work"))
    sized = seeds.join(work, "seed_n", "left").crossJoin(nodes.agg(limit)).select("seed_n", "cut", (F.coalesce("work", F.lit(0)) > F.col("limit")).alias("is_large"))
    sized = materialise(sized, "sized-seeds")
    few, many = sized.where("not is_large").drop("is_large"), sized.where("is_large").drop("is_large")
    # few edges: rows
    one = direct.select("seed_n", "n", F.lit(1).alias("hop"))
    two = fanned.select("seed_n", "via").join(second, "via").select("seed_n", "n", F.lit(2).alias("hop"))
    flag = lambda h: F.max((F.col("hop") == h).cast("int")).alias(f"h{h}")
    listed = one.unionByName(two).join(few, "seed_n").groupBy("seed_n", "cut", "n").agg(flag(1), flag(2)).withColumn("post", F.coalesce((F.col("n") > F.col("cut")).cast("int"), F.lit(0)))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    h1, h2, post = F.col("h1"), F.col("h2"), F.col("post")
    of_few = listed.groupBy("seed_n").agg(*[total(c, name) for c, name in zip((h1, h2, F.lit(1), h1 * post, h2 * post), COUNTS)])
    # many: bitmaps
    mine = fanned.join(many.select("seed_n"), "seed_n", "left_semi")
    light = mine.where(F.col("fan") < heavy).select("seed_n", "via").join(second, "via")
    big = mine.where(F.col("fan") >= heavy).select("seed_n", "via")
    own = bits(second.join(big.select("via").distinct(), "via", "left_semi"), ["via"], "n")
    ored = big.join(own, "via").groupBy("seed_n", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    first = bits(direct.join(many.select("seed_n"), "seed_n", "left_semi"), ["seed_n"], "n").withColumn("hop", F.lit(1))
    later = bits(light, ["seed_n"], "n").unionByName(ored).withColumn("hop", F.lit(2))
    of = lambda h: F.bitmap_or_agg(F.when(F.col("hop") == h, F.col("bitmap"))).alias(f"b{h}")
    maps = first.unionByName(later).groupBy("seed_n", "bucket").agg(of(1), of(2), F.bitmap_or_agg("bitmap").alias("b")).join(many, "seed_n")
    above = lambda b: _above(F.col(b), F.col("bucket"), F.col("cut"))
    size = F.bitmap_count
    of_many = maps.groupBy("seed_n").agg(*[total(c, name) for c, name in zip((size("b1"), size("b2"), size("b"), above("b1"), above("b2")), COUNTS)])
    counted = of_few.unionByName(of_many).join(seeds.select("seed_n", F.col("seed").alias("node_id")), "seed_n").drop("seed_n")
    return canonical.join(counted, "node_id", "left").na.fill(0, list(COUNTS))


def unique_post(canonical: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hop, n) of both hops: how many papers come after the notice of some seed that they cite, directly or through one that does."""
    seeds = cuts(canonical, nodes).where("cut is not null")
    e = edges.where("depth = 1 and source_n is not null").select(F.col("source_n").alias("n"), F.col("target_n").alias("seed_n"))
    least = materialise(e.join(seeds.select("seed_n", "cut"), "seed_n").groupBy("n").agg(F.min("cut").alias("cut")), "least-cuts")
    later = _second(edges).join(least.select(F.col("n").alias("via"), "cut"), "via").groupBy("n").agg(F.min("cut").alias("cut"))
    both = least.withColumn("hop", F.lit(1)).unionByName(later.withColumn("hop", F.lit(2)))
    hops = canonical.sparkSession.range(1, 3).select(F.col("id").cast("int").alias("hop"))
    return hops.join(both.where(F.col("n") > F.col("cut")).groupBy("hop").agg(F.count("*").alias("n")), "hop", "left").na.fill(0, ["n"])
