"""Counts and domain metrics over the graph: reach, post-notice citation, bridges, event study, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetrace.operators import graph as g
from citetrace.operators import seeds as s
from citetrace.operators import reach, stats
from citetrace.operators.components import connected_components


def depth_counts(frontier: DataFrame, k: int) -> DataFrame:
    return frontier.where(F.col("depth") <= k).groupBy("depth").agg(F.count("*").alias("node_count"))


def edge_depths(edges: DataFrame, k: int) -> DataFrame:
    return edges.where(F.col("depth") <= k).groupBy("depth", "source_api").agg(
        F.count("*").alias("edge_count"), F.count_distinct("source_id").alias("distinct_sources"), F.count_distinct("target_id").alias("distinct_targets")
    )


def edge_depths_all(edges: DataFrame, k: int) -> DataFrame:
    """As ``edge_depths`` but over all sources of data, so a node counts once."""
    return edge_depths(edges.withColumn("source_api", F.lit("all")), k)


def topic_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.where("depth between 1 and 2").groupBy("depth", "topic_domain", "topic_name").agg(F.count("*").alias("node_count"))


def edges_by_api(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_api").agg(F.count("*").alias("n"))


def pubdate_coverage(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if(F.col("publication_date").isNull()).alias("pubdate_null"))


def frontier_status(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("depth").agg(F.count("*").alias("node_count"), F.count_if(~F.col("processed")).alias("pending_count"))


def direct_pairs(canonical: DataFrame, edges: DataFrame, frontier: DataFrame, k: int = 2) -> DataFrame:
    """(seed, source_id): direct citers of each seed within the frontier."""
    inside = frontier.where(F.col("depth") <= k).select(F.col("node_id").alias("source_id"))
    e = edges.where("depth = 1").select("source_id", "target_id").join(inside, "source_id", "left_semi")
    return e.join(canonical.select(F.col("node_id").alias("target_id"), F.col("node_id").alias("seed")), "target_id").select("seed", "source_id").distinct()


def second_pairs(direct: DataFrame, edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(seed, source_id): nodes of depth 2 that cite a direct citer by an edge of depth 2."""
    outer = frontier.where("depth = 2").select(F.col("node_id").alias("source_id"))
    e = edges.where("depth = 2").select("source_id", F.col("target_id").alias("via")).join(outer, "source_id", "left_semi")
    return direct.select("seed", F.col("source_id").alias("via")).join(e, "via").select("seed", "source_id").distinct()


def seed_pairs(canonical: DataFrame, edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(seed, source_id, hop) of both hops."""
    one = direct_pairs(canonical, edges, frontier)
    return one.withColumn("hop", F.lit(1)).unionByName(second_pairs(one, edges, frontier).withColumn("hop", F.lit(2)))


def dated_pairs(pairs: DataFrame, canonical: DataFrame, works: DataFrame) -> DataFrame:
    """Pairs with whether the citing work appeared after the seed's notice; unknown dates never do."""
    out = pairs.join(works.select(F.col("node_id").alias("source_id"), "publication_date", "publication_year"), "source_id", "left")
    out = out.join(canonical.select(F.col("node_id").alias("seed"), "notice_date"), "seed")
    return out.withColumn("post", F.coalesce(F.col("publication_date") > F.col("notice_date"), F.lit(False)))


def seed_metrics(canonical: DataFrame, edges: DataFrame, frontier: DataFrame, works: DataFrame) -> DataFrame:
    """Per seed: direct citers, second-hop descendants, union reach, and those after the notice."""
    return of_pairs(canonical, dated_pairs(seed_pairs(canonical, edges, frontier), canonical, works))


def of_pairs(canonical: DataFrame, pairs: DataFrame) -> DataFrame:
    """``seed_metrics`` from dated pairs. They are distinct for each hop, so plain counts do; the union is one more pre-aggregation by (seed, source)."""
    per_source = pairs.groupBy("seed", "source_id").agg(F.max((F.col("hop") == 1).cast("int")).alias("h1"), F.max((F.col("hop") == 2).cast("int")).alias("h2"), F.max(F.col("post").cast("int")).alias("post"))
    counted = per_source.groupBy(F.col("seed").alias("node_id")).agg(
        F.sum("h1").alias("direct_citers"),
        F.sum("h2").alias("depth2_descendants"),
        F.count("*").alias("total_depth2_reach"),
        F.sum(F.col("h1") * F.col("post")).alias("post_notice_direct_citers"),
        F.sum(F.col("h2") * F.col("post")).alias("post_notice_depth2_descendants"),
    )
    return canonical.join(counted, "node_id", "left").na.fill(0, COUNTS)


COUNTS = ["direct_citers", "depth2_descendants", "total_depth2_reach", "post_notice_direct_citers", "post_notice_depth2_descendants"]


def post_notice_totals(metrics: DataFrame) -> DataFrame:
    d, e = F.col("post_notice_direct_citers"), F.col("post_notice_depth2_descendants")
    return metrics.agg(F.sum(d).alias("direct_sum"), F.sum(e).alias("depth2_sum"), F.count_if(d > 0).alias("seeds_direct"), F.count_if(e > 0).alias("seeds_depth2"))


def unique_post(canonical: DataFrame, edges: DataFrame, frontier: DataFrame, works: DataFrame, hop: int) -> DataFrame:
    """How many papers cite some seed, at that hop, after its notice."""
    return unique_of_pairs(dated_pairs(seed_pairs(canonical, edges, frontier), canonical, works), hop)


def unique_of_pairs(dated: DataFrame, hop: int) -> DataFrame:
    return dated.where((F.col("hop") == hop) & F.col("post")).agg(F.count_distinct("source_id").alias("n"))


def bridges(edges: DataFrame, frontier: DataFrame, works: DataFrame) -> DataFrame:
    """Nodes of depth 1 with how many seeds they cite and how many second-hop nodes cite them."""
    at = lambda d, as_: frontier.where(F.col("depth") == d).select(F.col("node_id").alias(as_))
    to_seed = edges.where("depth = 1").join(at(0, "target_id"), "target_id", "left_semi").groupBy(F.col("source_id").alias("node_id")).agg(F.count_distinct("target_id").alias("cited_seeds"))
    citers = edges.where("depth = 2").join(at(2, "source_id"), "source_id", "left_semi").groupBy(F.col("target_id").alias("node_id")).agg(F.count_distinct("source_id").alias("depth2_citers"))
    nodes = at(1, "node_id").join(to_seed, "node_id", "left").join(citers, "node_id", "left").na.fill(0, ["cited_seeds", "depth2_citers"])
    return nodes.join(works.select("node_id", "title"), "node_id", "left")


def post_notice_timeline(canonical: DataFrame, edges: DataFrame, frontier: DataFrame, works: DataFrame) -> DataFrame:
    pairs = dated_pairs(direct_pairs(canonical, edges, frontier), canonical, works)
    return pairs.where("post and publication_year is not null").groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("n"))


def first_notices(seed_rows: DataFrame) -> DataFrame:
    return seed_rows.where("resolved_status = 'resolved' and node_id is not null").groupBy("node_id").agg(F.min("notice_date").alias("notice_date"))


def event_study(seed_rows: DataFrame, edges: DataFrame, works: DataFrame, clip: int = 15) -> DataFrame:
    """Citations of seeds by years from the notice, within ``clip`` years, and the period."""
    e = edges.where("depth = 1").join(first_notices(seed_rows).withColumnRenamed("node_id", "target_id"), "target_id")
    e = e.join(works.select(F.col("node_id").alias("source_id"), "publication_year"), "source_id").where("publication_year is not null and notice_date is not null")
    offset = (F.col("publication_year") - F.year("notice_date")).alias("offset_year")
    out = e.groupBy(offset).agg(F.count("*").alias("n")).where(F.col("offset_year").between(-clip, clip))
    return out.withColumn("period", F.when(F.col("offset_year") < 0, "before").when(F.col("offset_year") == 0, "notice year").otherwise("after"))


def top(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by falling ``order``, then by id."""
    return rows.orderBy(*[F.col(c).desc() for c in order], "node_id").limit(n)


def as_rows(one: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """A one-row table as (metric, value) rows of text."""
    cells = F.array(*[F.struct(F.lit(c).alias(key), F.col(c).cast("string").alias(value)) for c in one.columns])
    return one.select(F.explode(cells).alias("_x")).select("_x.*")


def side_by_side(*tables: DataFrame) -> DataFrame:
    """Tables of one row each, next to each other."""
    return reduce(lambda a, b: a.crossJoin(b), tables)


def summary(seed_rows: DataFrame, frontier: DataFrame, edges: DataFrame, scoped: DataFrame, metrics: DataFrame, k: int = 2) -> DataFrame:
    """(metric, value) rows of the run."""
    inside = g.induced_edges(edges, frontier, k)
    seed_counts = seed_rows.agg(
        F.count("*").alias("seed_records"), F.count_if(F.col("resolved_status") == "resolved").alias("resolved_seed_records"), F.count_if(F.col("node_id").isNotNull()).alias("linked_seed_records")
    )
    depth = F.col("depth")
    node_counts = frontier.where(depth <= k).agg(
        F.count("*").alias("depth2_nodes"), F.count_if(depth == 0).alias("depth0_nodes"), F.count_if(depth == 1).alias("depth1_nodes"), F.count_if(depth == 2).alias("depth2_nodes_only")
    )
    api = F.col("source_api")
    edge_counts = inside.agg(F.count("*").alias("depth2_edges"), F.count_if(api == "opencitations").alias("opencitations_edges"), F.count_if(api == "openalex").alias("openalex_edges"))
    scope = g.edge_scope(scoped, frontier, k).drop("exported_edges")
    post = metrics.agg(F.sum("post_notice_direct_citers").alias("post_notice_direct_citers"))
    weak = weak_component_count(frontier.where(depth <= k), inside)
    return as_rows(side_by_side(seed_counts, s.duplicate_counts(seed_rows), node_counts, edge_counts, scope, post, weak))


def weak_component_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: components of the graph, nodes without an edge included."""
    c = connected_components(edges, "source_id", "target_id")
    alone = nodes.select("node_id").join(c.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    return c.agg(F.count_distinct("component").alias("a")).crossJoin(alone.agg(F.count("*").alias("b"))).select((F.col("a") + F.col("b")).alias("weak_components"))


def headline(
    seed_rows: DataFrame,
    prepared: DataFrame,
    metadata: DataFrame,
    edges: DataFrame,
    frontier: DataFrame,
    works: DataFrame,
    numbered: tuple[DataFrame, DataFrame],
    metrics: DataFrame,
    citations: DataFrame,
    expected: DataFrame,
) -> DataFrame:
    """One row of all headline numbers of a run.

    prepared: seeds with their statuses; numbered: ``reach.number_nodes`` and ``reach.number_edges``; metrics: ``reach.seed_metrics``; citations: all known ones;
    expected: (node_id, expected) counts to reconcile.
    """
    value = lambda key: F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit("unknown")).alias(key)
    run = metadata.agg(*[value(k) for k in ("rw_snapshot_date", "oc_access_date", "pipeline_mode")])
    status, depth, total = F.col("resolved_status"), F.col("depth"), F.col("total_depth2_reach")
    records = seed_rows.agg(F.count("*").alias("seed_records"), F.count_if(F.col("node_id").isNotNull()).alias("linked_seed_records"), F.count_if(status == "resolved").alias("resolved_seed_records"))
    no_doi = prepared.agg(F.count_if(status == "no_doi").alias("no_doi_seeds"))
    nodes = frontier.agg(*[F.count_if(depth == d).alias(f"depth{d}_nodes") for d in (0, 1, 2)], F.count("*").alias("total_nodes"))
    links = edges.agg(F.count("*").alias("total_edges"), *[F.count_if(depth == d).alias(f"depth{d}_edges") for d in (1, 2)])
    at = lambda d, c: F.coalesce(F.sum(F.when(depth == d, F.col("_n"))), F.lit(0)).alias(c)
    ends = [reach.distinct(numbered[1], ["depth"], f"{end}_n", "_n").agg(*[at(d, f"depth{d}_distinct_{end}s") for d in (1, 2)]) for end in ("source", "target")]
    spread = stats.quantiles(metrics, "total_depth2_reach").select(
        F.col("mean").alias("reach_mean"), F.col("p50").alias("reach_median"), *[F.col(p).alias(f"reach_{p}") for p in ("p90", "p95", "p99")], F.col("max").alias("reach_max"), (100 * F.col("zero_share")).alias("zero_reach_pct")
    )
    seeds = metrics.agg(F.count("*").alias("seed_papers"), F.count_if(total == 0).alias("zero_reach_n"))
    gini = stats.gini(metrics, "total_depth2_reach").withColumnRenamed("gini", "reach_gini")
    post = post_notice_totals(metrics).select(*[F.col(a).alias(b) for a, b in (("direct_sum", "direct_relationship_sum"), ("depth2_sum", "depth2_relationship_sum"), ("seeds_direct", "seeds_with_post_direct"), ("seeds_depth2", "seeds_with_post_depth2"))])
    unique = reach.unique_post(s.canonical(seed_rows), *numbered).agg(*[F.max(F.when(F.col("hop") == h, F.col("n"))).alias(c) for h, c in ((1, "direct_unique_nodes"), (2, "depth2_unique_nodes"))])
    day = works.select("node_id", "publication_date")
    cover = frontier.join(day, "node_id", "left").agg(*[F.count_if((depth == d) & F.col("publication_date").isNull()).alias(f"depth{d}_pubdate_null") for d in (1, 2)])
    counts = g.reconcile(edges.where("depth = 2"), expected).select(
        F.col("parents").alias("reconciled_parents"), F.col("exact").alias("exact_parents"), F.col("under").alias("undercount_parents"), F.col("over").alias("overcount_parents"), F.col("net_delta").alias("net_delta_citations")
    )
    zero = g.terminal(frontier, citations, 1).agg(F.count("*").alias("zero_count_pruned"))
    gone = g.stale(citations, frontier).select(F.col("stale_edges").alias("stale_edges_deleted"), F.col("stale_targets").alias("stale_missing_targets"))
    return side_by_side(run, records, s.duplicate_counts(seed_rows), no_doi, nodes, links, *ends, seeds, spread, gini, post, unique, cover, counts, zero, gone)


def labels(rows: DataFrame, n: int, order: str, title: str = "title", width: int = 55) -> DataFrame:
    """The first ``n`` rows by falling ``order`` with a label: rank in two digits and the title, cut at ``width``."""
    rank = F.row_number().over(Window.orderBy(F.col(order).desc(), "node_id"))
    return top(rows, n, order).withColumn("label", F.concat(F.format_string("%02d ", rank), F.substring(title, 1, width)))


def ego_sample(metrics: DataFrame, edges: DataFrame, direct: int = 120, second: int = 350) -> DataFrame:
    """Edges around the seed of the largest reach: some direct ones and some into their sources, by hash order."""
    seed = top(metrics, 1, "total_depth2_reach").select(F.col("node_id").alias("target_id"))
    mark: Column = F.sha2(F.concat_ws(">", "source_id", "target_id"), 256)
    one = edges.where("depth = 1").join(F.broadcast(seed), "target_id", "left_semi").orderBy(mark).limit(direct).select("source_id", "target_id", F.lit(1).alias("hop"))
    two = edges.where("depth = 2").join(F.broadcast(one.select(F.col("source_id").alias("target_id"))), "target_id", "left_semi")
    return one.unionByName(two.orderBy(mark).limit(second).select("source_id", "target_id", F.lit(2).alias("hop")))
