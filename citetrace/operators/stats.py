"""Distribution statistics of a numeric column, over distinct values wherever order matters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetrace.operators import selection
from citetrace.operators.ordered import running, running_sums

#: Differences from which on the signed-rank test is approximated.
EXACT = 50


def counted(rows: DataFrame, c: str) -> DataFrame:
    """(v, c): each distinct value with its count. Ordered passes run over these few rows, not over all."""
    return rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("c"))


def quantiles(rows: DataFrame, c: str) -> DataFrame:
    """Quantiles by linear interpolation, mean, maximum, share of zeros."""
    x = F.col(c)
    p = selection.quantiles(rows, {"p50": (c, 0.5), "p90": (c, 0.9), "p95": (c, 0.95), "p99": (c, 0.99)})
    out = rows.agg(F.avg(x).alias("mean"), F.max(x).alias("max"), (F.count_if(x == 0) / F.nullif(F.count(x), F.lit(0))).alias("zero_share"))
    return out.select(*[F.lit(v).cast("double").alias(k) for k, v in p.items()], "mean", "max", "zero_share")


def gini(rows: DataFrame, c: str) -> DataFrame:
    """Gini coefficient: null without rows, 0 for a sum of 0."""
    ranked = running(counted(rows, c), [F.col("v")], F.col("c"), "r")
    weight = F.col("c") * F.col("r") + F.col("c") * (F.col("c") + 1) / 2
    sums = ranked.agg(F.sum(F.col("v") * weight).alias("s"), F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("t"))
    value = F.when(F.col("t") == 0, F.lit(0.0)).otherwise(2 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n"))
    return sums.select(F.when(F.col("n") > 0, value).alias("gini"))


def ccdf(rows: DataFrame, c: str) -> DataFrame:
    """(value, share): share of all rows at or above each positive value."""
    v = counted(rows, c)
    total = v.agg(F.sum("c").alias("n"))
    above = running(v, [F.col("v").desc()], F.col("c"), "a").select("v", (F.col("a") + F.col("c")).alias("a"))
    return above.crossJoin(total).where("v > 0").select(F.col("v").alias("value"), (F.col("a") / F.col("n")).alias("share"))


def lorenz(rows: DataFrame, c: str, points: int = 2000) -> DataFrame:
    """(p, l): share of rows against share of the sum, at the end of each distinct value; thinned to about ``points``."""
    before = running_sums(counted(rows, c), [F.col("v")], {"n": F.col("c"), "s": F.col("v") * F.col("c"), "i": F.lit(1)})
    v = before.select("v", (F.col("n") + F.col("c")).alias("n"), (F.col("s") + F.col("v") * F.col("c")).alias("s"), (F.col("i") + 1).alias("i"))
    total = v.agg(F.max("n").alias("nn"), F.max("s").alias("ss"), F.max("i").alias("k"))
    step = F.greatest(F.ceil(F.col("k") / points), F.lit(1))
    kept = v.crossJoin(total).where((F.col("i") % step == 0) | (F.col("i") == F.col("k")))
    return kept.select((F.col("n") / F.col("nn")).alias("p"), (F.col("s") / F.nullif("ss", F.lit(0))).alias("l"))


def histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, n): equal widths from the least to the largest value, which is in the last bin."""
    x = rows.select(value.cast("double").alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)))
    return x.crossJoin(ends).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def share_within(rows: DataFrame, group: str, n: str = "n") -> DataFrame:
    """``rows`` with each row's share of its group's sum."""
    return rows.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(group)))


def wilcoxon(rows: DataFrame, difference: str) -> DataFrame:
    """Signed-rank test of paired differences: v, n, z and the two-sided p.

    Ranks come from counts of distinct absolute differences, zero ones left out. Below ``EXACT`` differences, none of them zero and no two of one size, p is
    exact; else it is the normal approximation's, z, with tie and continuity corrections.
    """
    x = rows.select(F.col(difference).alias("d"))
    by = x.where("d <> 0").groupBy(F.abs("d").alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("pos"))
    ranked = running(by, [F.col("v")], F.col("c"), "before")
    return _tested(ranked.agg(*_rank_sums()).crossJoin(x.agg(F.count_if(F.col("d") == 0).alias("zeros"))))


def wilcoxon_by(rows: DataFrame, groups: list[str], difference: str) -> DataFrame:
    """``wilcoxon`` of each group: ``groups``, v, n, z, p."""
    x = rows.select(*groups, F.col(difference).alias("d"))
    by = x.groupBy(*groups, F.abs("d").alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("pos")).where("v is not null")
    order = Window.partitionBy(*groups).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    zeros = by.groupBy(*groups).agg(F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("c"))), F.lit(0)).alias("zeros"))
    ranked = by.where("v <> 0").withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))
    sums = zeros.join(ranked.groupBy(*groups).agg(*_rank_sums()), groups, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _tested(sums, groups)


def _rank_sums() -> list[Column]:
    """v (the sum of the ranks of positive differences), n, and what ties take off, from (c, pos, before) of each size."""
    c = F.col("c").cast("double")
    rank = F.col("before") + (F.col("c") + 1) / 2
    return [F.sum(rank * F.col("pos")).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(c * c * c - c).alias("ties")]


def _tested(sums: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    n = F.col("n").cast("double")
    z = F.col("v") - n * (n + 1) / 4
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = (z - F.signum(z) * 0.5) / F.nullif(sigma, F.lit(0.0))
    exact = (F.col("n") > 0) & (F.col("n") < EXACT) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    return sums.select(*groups, "v", "n", z.alias("z"), F.when(exact, signed_rank_two_sided(F.col("v"), F.col("n"))).otherwise(normal_two_sided(z)).alias("p"))


def signed_rank_two_sided(v: Column, n: Column) -> Column:
    """The exact two-sided p of a sum of ranks: twice the share of all sign choices whose sum is as far out, at most 1.

    The number of subsets of 1..k with each sum follows from that of 1..k-1; an array holds it, of n(n+1)/2+1 numbers at most.
    """
    total = (n * (n + 1) / 2).cast("int")
    none = F.transform(F.sequence(F.lit(0), total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    with_rank = lambda counts, k: F.transform(counts, lambda c, s: c + F.when(s >= k, F.get(counts, (s - k).cast("int"))).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), none, with_rank)
    far = F.greatest(v, total - v).cast("int")  # the distribution is symmetric
    tail = F.aggregate(F.slice(counts, far + 1, total + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))


def normal_two_sided(z: Column) -> Column:
    """2 * P(Z > |z|) by a rational approximation of the error function (absolute error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    # Coefficients of the complementary error function's approximation, highest power first.
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + a
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def density_bins(edges: DataFrame, nodes: DataFrame, bins: int = 256) -> DataFrame:
    """Nodes of each depth in ``bins`` by falling degree, and how many edges run between bins."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    degree = nodes.select("node_id", "depth").join(ends.groupBy("node_id").agg(F.count("*").alias("degree")), "node_id", "left").na.fill(0, ["degree"])
    # ntile by the place in the order of all: the first n % bins bins are one larger
    placed = running(degree, [F.col("depth"), F.col("degree").desc(), F.col("node_id")], F.lit(1), "_i")
    size = degree.groupBy("depth").agg(F.count("*").alias("_n"))
    first = size.select("depth", "_n", F.coalesce(F.sum("_n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f"))  # one row a depth
    i, wide, more = F.col("_i") - F.col("_f"), F.floor(F.col("_n") / bins) + 1, F.col("_n") % bins
    tile = F.when(i < more * wide, F.floor(i / wide)).otherwise(more + F.floor((i - more * wide) / F.greatest(wide - 1, F.lit(1)))) + 1
    placed = placed.join(F.broadcast(first), "depth").select("node_id", "depth", tile.cast("int").alias("bin"))
    side = lambda end, a: placed.select(F.col("node_id").alias(f"{end}_id"), F.col("depth").alias(f"{a}_depth"), F.col("bin").alias(f"{a}_bin"))
    both = edges.join(side("source", "source"), "source_id").join(side("target", "target"), "target_id")
    return both.groupBy("source_depth", "source_bin", "target_depth", "target_bin").agg(F.count("*").alias("n"))
