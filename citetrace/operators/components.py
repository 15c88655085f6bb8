"""Connected components by randomised contraction (no driver-side graph), at once or as edges come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrace.plans.log_store import LogStore, Table
from citetrace.plans.storage import materialise


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges ``a``-``b``.

    Only nodes with an edge are returned; null ends and loops are ignored. Nodes go by 64-bit numbers. In each round every node
    moves to the first of itself and its neighbours in an order that is drawn anew, and from there once more; edges follow, and
    those that have become loops or copies go. So the graph shrinks by a share of its nodes each round, however long its paths, and
    all rounds together cost a multiple of the first. The moves of all rounds, joined, lead from a node to its component, whose least
    node is found at the end. A hub is aggregated map-side, so a node with very many neighbours never lands in one task as a list.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = materialise(e, "cc")
    names, salt = _named(e)
    e = e.select(_number("a", salt).alias("u"), _number("b", salt).alias("v"))
    e, moves = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), []
    for number in range(max_rounds):
        e = materialise(e, "cc")
        if e.isEmpty():
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        place = lambda c, n=number: F.xxhash64(F.lit(n), c)
        first = both.groupBy("u").agg(F.min_by("v", place("v")).alias("v"), F.min(place("v")).alias("p"))
        once = first.select("u", F.when(F.col("p") < place("u"), F.col("v")).otherwise(F.col("u")).alias("m"))
        onward = once.select(F.col("u").alias("m"), F.col("m").alias("m2"))
        moves.append(materialise(once.join(onward, "m").select("u", F.col("m2").alias("m")), "cc-moves"))
        of = lambda end: moves[-1].select(F.col("u").alias(end), F.col("m").alias(f"{end}_m"))
        moved = e.join(of("u"), "u").join(of("v"), "v").where("u_m <> v_m")
        e = moved.select(F.greatest("u_m", "v_m").alias("u"), F.least("u_m", "v_m").alias("v")).distinct()
    else:
        raise RuntimeError("connected_components did not settle")
    if not moves:
        return names.select("node", F.col("node").alias("component"))  # no rows
    *earlier, found = moves
    for move in reversed(earlier):
        later = found.select(F.col("u").alias("m"), F.col("m").alias("_c"))
        found = move.join(later, "m", "left").select("u", F.coalesce("_c", "m").alias("m"))
    found = materialise(names.join(found, "u").select("node", "m"), "cc-found")
    least = found.groupBy("m").agg(F.min("node").alias("component"))
    return found.join(least, "m").select("node", "component")


def _number(c: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), c)


def _named(e: DataFrame) -> tuple[DataFrame, int]:
    """(u, node), written: a number for each end of the edges ``a``-``b``, and the salt of the numbers, one under which no two nodes have the same."""
    ends = e.select(F.col("a").alias("node")).unionAll(e.select(F.col("b").alias("node")))
    for salt in range(100):
        names = materialise(ends.groupBy(_number("node", salt).alias("u")).agg(F.min("node").alias("node"), F.max("node").alias("_last")), "cc-names")
        if names.where("node <> _last").isEmpty():
            return names.select("u", "node"), salt
    raise RuntimeError("no salt tells all nodes apart")


LABELS = {"labels": Table("node string, component string", ("node",), ("component",))}


class Components:
    """Components that follow new edges: stored labels, of which a batch changes those of the components that it joins, and no others.

    A label is the least node of its component, so labels only fall and the store keeps the least of each node.
    """

    def __init__(self, spark: SparkSession, folder: str, **sizes: int):
        self.store = LogStore(spark, folder, LABELS, **sizes)

    def labels(self) -> DataFrame:
        """(node, component) of every node that an edge has named."""
        return self.store.read("labels")

    def add(self, edges: DataFrame, a: str = "source_id", b: str = "target_id", number: int | None = None) -> int:
        """Take in a batch of edges; how many labels are new or changed. Loops name their node, null ends nothing; a ``number`` that was taken changes nothing.

        The batch's edges are contracted to edges between stored components, and only those are searched.
        """
        state = self.store.state()
        if number is not None and number <= state.batch:
            return 0
        known = self.store.read("labels", state)
        e = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct(), "batch-edges")
        of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
        joined = e.join(of("u"), "u", "left").join(of("v"), "v", "left")
        joined = materialise(joined.select("u", "v", "u_c", "v_c"), "batch-labels")
        between = joined.select(F.coalesce("u_c", "u").alias("p"), F.coalesce("v_c", "v").alias("q")).where("p <> q")
        found = connected_components(between, "p", "q").select(F.col("node").alias("component"), F.col("component").alias("new"))
        found = materialise(found.where("component <> new"), "joined-components")
        moved = known.join(found, "component").select("node", F.col("new").alias("component"))
        ends = joined.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("u_c").alias("c")), F.struct(F.col("v").alias("node"), F.col("v_c").alias("c")))).alias("x")).select("x.*")
        fresh = ends.where("c is null").select("node").distinct().join(found.withColumnRenamed("component", "node"), "node", "left").select("node", F.coalesce("new", "node").alias("component"))
        changed = materialise(moved.unionByName(fresh), "changed-labels")
        n = changed.count()
        self.store.commit({"labels": changed}, number, sizes={"labels": n})
        return n
