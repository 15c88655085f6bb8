"""Citation graph: merges by least depth, breadth-first levels, scopes and checks of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrace.functions import identifiers as ids
from citetrace.operators.ordered import running
from citetrace.operators.sieve import among, sieved
from citetrace.plans.storage import materialise


def least_depth(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_id").agg(F.min("depth").alias("depth"))


def merge_edges(observed: DataFrame, order: tuple[str, ...] = ("depth", "seq")) -> DataFrame:
    """One edge for each (source_id, target_id): the shallowest observation, of equal ones the first by ``order``."""
    rest = [c for c in observed.columns if c not in ("source_id", "target_id")]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_e")
    return observed.groupBy("source_id", "target_id").agg(best).select("source_id", "target_id", "_e.*")


def bfs(citations: DataFrame, roots: DataFrame, max_depth: int, expandable: str | None = None, cut_lineage: bool | None = None) -> DataFrame:
    """(node_id, depth): distance of each citing node to the nearest root, up to ``max_depth``.

    expandable: a condition on node_id below which a node grows no further. Lineage is cut at each level that grows further (or as told),
    so no level is made twice. Citations are sieved by the level before they meet it, so only few are shuffled.
    """
    pairs = citations.select("source_id", "target_id").where("source_id <> target_id")
    known = roots.where("node_id is not null").select("node_id").distinct().withColumn("depth", F.lit(0))
    level = known
    for depth in range(1, max_depth + 1):
        grow = level.where(expandable) if expandable else level
        asked = grow.select(F.col("node_id").alias("target_id"))
        found = among(pairs, "target_id", asked).select(F.col("source_id").alias("node_id")).distinct()
        level = found.join(known.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth))
        if cut_lineage or (cut_lineage is None and (depth < max_depth or depth > 2)):
            level = materialise(level, "bfs")
        known = known.unionByName(level)
    return known


def level_edges(citations: DataFrame, frontier: DataFrame, max_depth: int) -> DataFrame:
    """Merged edges into frontier nodes above ``max_depth``: depth is that of the target plus one."""
    parents = frontier.where(F.col("depth") < max_depth).select(F.col("node_id").alias("target_id"), (F.col("depth") + 1).alias("depth"))
    hit = sieved(citations.where("source_id <> target_id"), "target_id", parents.select("target_id"))
    return merge_edges(hit.join(parents, "target_id"))


def level_stats(citations: DataFrame, frontier: DataFrame, depth: int, parent_limit: int | None = None, failed: DataFrame | None = None, expandable: str | None = None) -> DataFrame:
    """One row for a level: parents, those asked, failed and not expandable, their citations, and new nodes.

    failed: (node_id) of parents whose citations could not be had; expandable: a condition on node_id. ``parent_limit`` takes the first by id.
    """
    parents = frontier.where(F.col("depth") == depth).select("node_id")
    if parent_limit is not None:
        parents = parents.orderBy("node_id").limit(parent_limit)
    gone = parents.limit(0) if failed is None else failed.select("node_id").distinct()
    parents = parents.withColumn("grows", F.coalesce(F.expr(expandable), F.lit(False)) if expandable else F.lit(True))
    parents = parents.join(gone.withColumn("_f", F.lit(True)), "node_id", "left").withColumn("failed", F.col("grows") & F.col("_f").isNotNull())
    asked = parents.where("grows and not failed").select(F.col("node_id").alias("target_id"))
    hit = citations.where("source_id <> target_id").join(asked, "target_id", "left_semi")
    fresh = hit.select(F.col("source_id").alias("node_id")).distinct().join(frontier.where(F.col("depth") <= depth).select("node_id"), "node_id", "left_anti")
    counts = parents.agg(
        F.count("*").alias("parents"), F.count_if(F.col("grows") & ~F.col("failed")).alias("parents_queried"), F.count_if("failed").alias("parents_failed"), F.count_if(~F.col("grows")).alias("parents_without_doi")
    )
    return counts.crossJoin(hit.agg(F.count("*").alias("citations"), F.count_distinct("source_id", "target_id").alias("edges"))).crossJoin(fresh.agg(F.count("*").alias("new_nodes")))


def capped_level(citations: DataFrame, frontier: DataFrame, depth: int, cap: int) -> DataFrame:
    """New nodes of a level under a soft cap: parents expand in id order while the nodes found before them are fewer than ``cap``.

    A node belongs to its least parent. The running count is over parents (one row each), not over nodes, in ranges of
    parents.
    """
    parents = frontier.where(F.col("depth") == depth).select(F.col("node_id").alias("target_id"))
    hit = citations.where("source_id <> target_id").join(parents, "target_id", "left_semi")
    fresh = hit.join(frontier.where(F.col("depth") <= depth).select(F.col("node_id").alias("source_id")), "source_id", "left_anti")
    owner = fresh.groupBy("source_id").agg(F.min("target_id").alias("parent_id"))
    per_parent = owner.groupBy("parent_id").agg(F.count("*").alias("n"))
    allowed = running(per_parent, [F.col("parent_id")], F.col("n"), "before").where(F.col("before") < cap).select("parent_id")
    return owner.join(allowed, "parent_id", "left_semi").select(F.col("source_id").alias("node_id"), "parent_id")


def pending(frontier: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """Nodes of a depth that are not processed, by id."""
    out = frontier.where((F.col("depth") == depth) & ~F.col("processed")).select("node_id").orderBy("node_id")
    return out.limit(limit) if limit is not None else out


def mark_processed(frontier: DataFrame, done: DataFrame) -> DataFrame:
    """``frontier`` with the nodes of ``done`` (node_id) processed; others as they were."""
    marked = done.select("node_id").distinct().withColumn("_done", F.lit(True))
    rest = [c for c in frontier.columns if c != "processed"]
    return frontier.join(marked, "node_id", "left").select(*rest, (F.col("processed") | F.col("_done").isNotNull()).alias("processed"))


def citation_edges(citations: DataFrame, target_depth: int) -> DataFrame:
    """Edges of parsed citations of a parent: to the cited node and, where it differs, to the parent as well."""
    citing = F.coalesce(ids.doi_node(F.col("citing_doi")), ids.pmid_node(F.col("citing_pmid")))
    targets = F.array_distinct(F.filter(F.array(ids.doi_node(F.col("cited_doi")), F.col("parent_id")), lambda x: x.isNotNull()))
    out = citations.select(citing.alias("source_id"), F.explode(targets).alias("target_id"), F.lit(target_depth).alias("depth"), F.col("creation_date").alias("citation_date"))
    return out.where("source_id is not null and source_id <> target_id").distinct()


def citation_nodes(citations: DataFrame, seeds: DataFrame, target_depth: int) -> DataFrame:
    """(node_id, depth, doi, publication_date, is_retracted) of the citing ends of parsed citations, one row a node; a node that is a seed is retracted."""
    citing = F.coalesce(ids.doi_node(F.col("citing_doi")), ids.pmid_node(F.col("citing_pmid")))
    rows = citations.select(citing.alias("node_id"), "citing_doi", "creation_date").where("node_id is not null")
    nodes = rows.groupBy("node_id").agg(F.min("citing_doi").alias("doi"), F.min("creation_date").alias("publication_date"))
    flagged = seeds.where("node_id is not null").select("node_id").distinct().withColumn("_s", F.lit(True))
    return nodes.join(flagged, "node_id", "left").select("node_id", F.lit(target_depth).alias("depth"), "doi", "publication_date", F.col("_s").isNotNull().alias("is_retracted"))


def page_store(works: DataFrame, parents: DataFrame, target_depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of pages of works: every work becomes a node of the depth, also one without a reference to a parent."""
    nodes = works.where("node_id is not null").select("node_id").distinct().withColumn("depth", F.lit(target_depth))
    return nodes, reference_edges(works, parents).withColumn("depth", F.lit(target_depth))


def hybrid_crawl(citations: DataFrame, works: DataFrame, roots: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(frontier, edges) of a crawl over two sources, at each level ``citations`` (source_id, target_id, citation_date, seq) first, then the references of ``works``.

    Edges that both have keep what the first says; depth is that of the expanded node plus one.
    """
    frontier = least_depth(roots.where("node_id is not null").select("node_id", F.lit(0).alias("depth")))
    edges = None
    refs = works.select(F.col("node_id").alias("source_id"), F.explode(F.array_distinct("referenced_works")).alias("target_id")).where("source_id <> target_id")
    blank = lambda kind: F.lit(None).cast(kind)
    second = refs.select("source_id", "target_id", F.lit("openalex").alias("source_api"), blank("date").alias("citation_date"), blank("long").alias("seq"), F.lit(1).alias("source_rank"))
    first = citations.where("source_id <> target_id").select("source_id", "target_id", F.lit("opencitations").alias("source_api"), "citation_date", "seq", F.lit(0).alias("source_rank"))
    both = first.unionByName(second)
    for depth in range(1, max_depth + 1):
        parents = frontier.where(F.col("depth") == depth - 1).select(F.col("node_id").alias("target_id"))
        level = materialise(among(both, "target_id", parents).withColumn("depth", F.lit(depth)), "hybrid-level")
        edges = level if edges is None else edges.unionByName(level)
        found = level.select(F.col("source_id").alias("node_id"), "depth").distinct()
        frontier = materialise(least_depth(frontier.unionByName(found)), "hybrid-frontier")
    return frontier, merge_edges(edges, ("depth", "source_rank", "seq"))


def build(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, vertices without an edge, and edge ends that are no vertex (a graph needs none of them)."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    own = nodes.select("node_id").distinct()
    return (
        own.agg(F.count("*").alias("vertices"))
        .crossJoin(edges.agg(F.count("*").alias("edges")))
        .crossJoin(own.join(ends, "node_id", "left_anti").agg(F.count("*").alias("isolated")))
        .crossJoin(ends.join(own, "node_id", "left_anti").agg(F.count("*").alias("dangling_ends")))
    )


def reference_edges(works: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges of works to those of their references that are parents."""
    refs = works.select(F.col("node_id").alias("source_id"), F.explode(F.array_distinct("referenced_works")).alias("target_id"))
    return refs.join(parents.select(F.col("node_id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id")


def hybrid(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges of two sources; of equal depth the first source's observation stays."""
    rows = first.withColumn("source_rank", F.lit(0)).unionByName(second.withColumn("source_rank", F.lit(1)))
    return merge_edges(rows, ("depth", "source_rank", "seq"))


def resolve_citers(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Citations with the citing work, by DOI, or by PMID where there is no DOI."""
    by_doi = citations.where("citing_doi is not null").join(works.select(F.col("doi").alias("citing_doi"), "node_id"), "citing_doi", "left")
    by_pmid = citations.where("citing_doi is null").join(works.select(F.col("pmid").alias("citing_pmid"), "node_id"), "citing_pmid", "left")
    return by_doi.unionByName(by_pmid)


def frontier_with_doi(frontier: DataFrame, works: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Distinct nodes of a depth with a DOI, of the work or else of a seed."""
    w = works.select("node_id", F.col("doi").alias("w_doi"))
    s = seeds.where("node_id is not null").groupBy("node_id").agg(F.min("original_doi").alias("s_doi"))
    rows = frontier.where(F.col("depth") == depth).select("node_id").join(w, "node_id", "left").join(s, "node_id", "left")
    return rows.select("node_id", F.coalesce("w_doi", "s_doi").alias("doi")).where("doi is not null").distinct()


def induced_edges(edges: DataFrame, frontier: DataFrame, k: int) -> DataFrame:
    inside = frontier.where(F.col("depth") <= k).select("node_id")
    e = edges.join(inside.select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    return e.join(inside.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")


def induced_nodes(frontier: DataFrame, works: DataFrame, k: int) -> DataFrame:
    return frontier.where(F.col("depth") <= k).select("node_id", "depth").join(works, "node_id", "left")


def edge_scope(edges: DataFrame, frontier: DataFrame, k: int) -> DataFrame:
    """Stored edges, those without a source or target in the frontier, and the rest."""
    f = frontier.where(F.col("depth") <= k).select("node_id")
    ends = edges.join(f.select(F.col("node_id").alias("source_id"), F.lit(1).alias("_s")), "source_id", "left").join(
        f.select(F.col("node_id").alias("target_id"), F.lit(1).alias("_t")), "target_id", "left"
    )
    return ends.agg(
        F.count("*").alias("stored_edges"),
        F.count_if(F.col("_s").isNull()).alias("missing_source"),
        F.count_if(F.col("_t").isNull()).alias("missing_target"),
        F.count_if(F.col("_s").isNotNull() & F.col("_t").isNotNull()).alias("exported_edges"),
    )


def reconcile(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """Edges found against edges reported for each parent: exact, under, over, and the net difference; a parent that only one side has counts as 0 there."""
    found = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("found"))
    both = expected.join(found, "node_id", "full").withColumn("d", F.coalesce("found", F.lit(0)) - F.coalesce("expected", F.lit(0)))
    d = F.col("d")
    return both.agg(
        F.count("*").alias("parents"), F.count_if(d == 0).alias("exact"), F.count_if(d < 0).alias("under"), F.count_if(d > 0).alias("over"), F.coalesce(F.sum("d"), F.lit(0)).alias("net_delta")
    )


def terminal(frontier: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Nodes of a depth that nothing cites."""
    return frontier.where(F.col("depth") == depth).select("node_id").join(edges.select(F.col("target_id").alias("node_id")), "node_id", "left_anti")


def stale(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """How many edges have a target outside the frontier, and how many such targets."""
    out = edges.join(frontier.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    return out.agg(F.count("*").alias("stale_edges"), F.count_distinct("target_id").alias("stale_targets"))
