"""Matched controls: each seed with the nearest paper of its year by log in-degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrace.operators import selection, stats
from citetrace.operators.metrics import first_notices


def _dated(works: DataFrame) -> DataFrame:
    return works.where("publication_date is not null").select(F.col("node_id").alias("source_id"), F.col("publication_date").alias("cited_on"), F.col("publication_year").alias("cited_year"))


def seed_frame(seed_rows: DataFrame, edges: DataFrame, works: DataFrame) -> DataFrame:
    """Per seed: year, dated in-degree, citations after the notice, their share, log in-degree."""
    years = works.where("publication_year is not null").select(F.col("node_id").alias("target_id"), F.col("publication_year").alias("year"))
    s = first_notices(seed_rows).withColumnRenamed("node_id", "target_id").join(years, "target_id")
    e = edges.where("depth = 1").select("source_id", "target_id").join(_dated(works), "source_id").join(s, "target_id")
    out = e.groupBy(F.col("target_id").alias("node_id"), "notice_date", "year").agg(F.count("*").alias("indeg"), F.count_if(F.col("cited_on") > F.col("notice_date")).alias("post_in"))
    return out.withColumn("seed_share", F.col("post_in") / F.col("indeg")).withColumn("logdeg", F.log1p("indeg"))


def pool(edges: DataFrame, frontier: DataFrame, works: DataFrame) -> DataFrame:
    """Papers of depth 1 that are not flagged, with a year and dated citations."""
    ok = works.where("publication_year is not null and not coalesce(is_retracted, false)").select(F.col("node_id").alias("target_id"), F.col("publication_year").alias("year"))
    ok = ok.join(frontier.where("depth = 1").select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    e = edges.where("depth = 2").select("source_id", "target_id").join(_dated(works).select("source_id"), "source_id", "left_semi").join(ok, "target_id")
    return e.groupBy(F.col("target_id").alias("node_id"), "year").agg(F.count("*").alias("indeg")).withColumn("logdeg", F.log1p("indeg"))


def match(seeds: DataFrame, candidates: DataFrame, jitter: float = 0.0) -> DataFrame:
    """``seeds`` with control_id and distance: the nearest log in-degree of the same year, with replacement; no seeds of a year without candidates.

    ``jitter`` is added to each seed's log in-degree.

    Below and above are found by one window over the distinct in-degrees of a year together with the seeds. Of equal
    in-degrees the last id is taken from below and the first from above; equal distance goes below. At or beyond the largest, the
    last id but one of the sorted candidates is the lower one; before the least the first.
    """
    by_id = F.struct("indeg", "node_id")
    level = candidates.groupBy("year", "indeg").agg(F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id"), F.count("*").alias("n"))
    ends = candidates.groupBy("year").agg(F.max(by_id).alias("top"), F.min(by_id).alias("low"), F.count("*").alias("size"))
    # the last but one in (in-degree, id) order: the largest once the top row is left out
    second = candidates.join(ends.select("year", "top"), "year").where(by_id < F.col("top")).groupBy("year").agg(F.max(by_id).alias("second"))
    # what is looked for, once for each year and in-degree: the window holds a year's distinct in-degrees, not its seeds
    want = F.col("indeg").cast("double") if not jitter else F.expm1(F.log1p("indeg") + jitter)
    asked = seeds.select("year", want.alias("at")).distinct()
    blank = F.lit(None).cast("string")
    points = level.select("year", F.col("indeg").cast("double").alias("at"), "indeg", "first_id", "last_id", F.lit(False).alias("asks")).unionByName(
        asked.select("year", "at", F.lit(None).cast("long").alias("indeg"), blank.alias("first_id"), blank.alias("last_id"), F.lit(True).alias("asks"))
    )
    order = Window.partitionBy("year").orderBy("at", "asks")
    point = F.when(~F.col("asks"), F.struct("indeg", "first_id", "last_id"))
    below = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first(point, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = points.select("year", "at", "asks", below.alias("b"), above.alias("a")).where("asks").drop("asks")
    out = seeds.withColumn("at", want).join(found, ["year", "at"]).join(ends, "year").join(second, "year", "left")
    far = F.col("at") >= F.col("top.indeg")
    lower_deg = F.when(far, F.coalesce("second.indeg", "top.indeg")).otherwise(F.coalesce("b.indeg", "low.indeg"))
    lower_id = F.when(far, F.coalesce("second.node_id", "top.node_id")).otherwise(F.coalesce("b.last_id", "low.node_id"))
    upper_deg = F.when(far, F.col("top.indeg")).otherwise(F.col("a.indeg"))
    upper_id = F.when(far, F.col("top.node_id")).otherwise(F.col("a.first_id"))
    dist = lambda d: F.abs(F.log1p(d) - F.log1p("at"))
    choose_low = upper_deg.isNull() | (dist(lower_deg) <= dist(upper_deg))
    return out.select(
        *seeds.columns, F.when(choose_low, lower_id).otherwise(upper_id).alias("control_id"), F.when(choose_low, dist(lower_deg)).otherwise(dist(upper_deg)).alias("distance")
    )


def pairs(matched: DataFrame, edges: DataFrame, works: DataFrame) -> DataFrame:
    """Matched pairs with the control's share of citations after the seed's notice; pairs without dated ones go."""
    m = matched.select("node_id", "year", "indeg", "seed_share", "control_id", "notice_date")
    e = edges.where("depth = 2").select("source_id", F.col("target_id").alias("control_id")).join(_dated(works), "source_id")
    c = m.select("node_id", "control_id", "notice_date").join(e, "control_id").groupBy("node_id").agg(
        F.count("*").alias("control_indeg"), F.count_if(F.col("cited_on") > F.col("notice_date")).alias("control_post_in")
    )
    out = m.join(c, "node_id").withColumn("control_share", F.col("control_post_in") / F.col("control_indeg"))
    return out.withColumn("share_diff", F.col("seed_share") - F.col("control_share"))


def summary(paired: DataFrame) -> DataFrame:
    """(metric, value) rows: sizes, medians, means, how often the seed's share is the higher, and the p of the signed-rank test."""
    middle = selection.quantiles(paired, {"seed_share_median": ("seed_share", 0.5), "control_share_median": ("control_share", 0.5), "median_share_diff": ("share_diff", 0.5)})
    one = paired.agg(
        F.count("*").alias("matched_pairs"),
        F.count_distinct("control_id").alias("unique_controls"),
        *[F.lit(v).cast("double").alias(k) for k, v in middle.items()],
        F.avg("share_diff").alias("mean_share_diff"),
        (100 * F.avg((F.col("share_diff") > 0).cast("double"))).alias("pct_pairs_seed_higher"),
        F.avg("seed_share").alias("seed_share_mean"),
        F.avg("control_share").alias("control_share_mean"),
    )
    test = stats.wilcoxon(paired.withColumn("_d", F.round("share_diff", 9)), "_d").select(F.col("p").alias("wilcoxon_p"))
    one = one.crossJoin(test)
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])
    return one.select(F.explode(cells).alias("_x")).select("_x.*")


def event_overlay(paired: DataFrame, edges: DataFrame, works: DataFrame, clip: int = 15) -> DataFrame:
    """(group, offset_year, n, share): citations by years from the notice, of seeds and of their controls."""
    years = works.where("publication_year is not null").select(F.col("node_id").alias("source_id"), "publication_year")

    def of(depth: int, target: str, group: str) -> DataFrame:
        e = edges.where(F.col("depth") == depth).select("source_id", F.col("target_id").alias(target)).join(years, "source_id")
        offset = (F.col("publication_year") - F.year("notice_date")).alias("offset_year")
        return paired.select(target, "notice_date").join(e, target).groupBy(offset).agg(F.count("*").alias("n")).withColumn("group", F.lit(group))

    both = of(1, "node_id", "seeds").unionByName(of(2, "control_id", "controls")).where(F.col("offset_year").between(-clip, clip))
    return stats.share_within(both, "group")
