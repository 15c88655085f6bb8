"""A crawl that grows and resumes: breadth-first depths kept in a store, changed by new citations only where they matter.

The store holds all citations seen, the least depth of each node, the depth at which a node was last expanded, and the parents whose citations could not be
had. A node is pending if it was never expanded or has since come nearer to a root. Each step expands the shallowest pending level and is one commit, so a
crawl may stop after any step and go on later; as a step only ever adds deeper nodes, no node is expanded twice for the same set of citations. New citations
of expanded parents lower depths at once; whatever that changes is pending again, and nothing else is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrace.operators.graph import level_edges
from citetrace.operators.ordered import running
from citetrace.operators.sieve import among
from citetrace.plans.log_store import LogStore, Table
from citetrace.plans.storage import materialise

TABLES = {
    "citations": Table("source_id string, target_id string, source_api string, citation_date date, seq long", ("target_id", "source_id"), ("seq",)),
    "nodes": Table("node_id string, depth int", ("node_id",), ("depth",)),
    "expanded": Table("node_id string, at_depth int", ("node_id",), ("at_depth",)),
    "failures": Table("node_id string, error string, step long", ("node_id",), ("-step",)),
}
#: The log is a row a commit, and part of the manifest.
LOG = "step long, kind string, depth int, parents long, failed long, without_doi long, citations long, changed long, truncated boolean"


class Crawl:
    """``max_depth``: nodes of that depth are kept and not expanded. ``expandable``: a condition on node_id; parents that do not meet it are done without being asked."""

    def __init__(self, spark: SparkSession, folder: str, max_depth: int = 2, expandable: str = "true", **sizes: int):
        self.store, self.max_depth, self.expandable = LogStore(spark, folder, TABLES, **sizes), max_depth, expandable

    # --- what is known ---

    def nodes(self) -> DataFrame:
        """(node_id, depth, processed) of all nodes so far; a node that has come nearer since it was expanded is not processed."""
        state = self.store.state()
        both = self.store.read("nodes", state).join(self.store.read("expanded", state), "node_id", "left")
        return both.select("node_id", "depth", F.coalesce(F.col("at_depth") <= F.col("depth"), F.lit(False)).alias("processed"))

    def pending(self) -> DataFrame:
        return self.nodes().where(~F.col("processed") & (F.col("depth") < self.max_depth)).select("node_id", "depth")

    def edges(self) -> DataFrame:
        """Merged edges into the nodes above ``max_depth``, each with the depth of its target plus one."""
        state = self.store.state()
        nodes = self.store.read("nodes", state)
        asked = nodes.where(F.col("depth") < self.max_depth).select(F.col("node_id").alias("target_id"))
        return level_edges(self.store.read("citations", state, asked), nodes, self.max_depth)

    def failures(self) -> DataFrame:
        """(node_id, error) of parents that failed and have not succeeded since."""
        return self.store.read("failures").where("error is not null").select("node_id", "error")

    def log(self) -> DataFrame:
        """One row a commit: what it was, what it read and how many nodes it made new or nearer."""
        return self.store.spark.createDataFrame([tuple(x) for x in self.store.state().note.get("log", [])], LOG)

    # --- what changes it ---

    def add_roots(self, roots: DataFrame) -> None:
        """Nodes of depth 0. One that is known at a greater depth comes nearer and is expanded again."""
        found = roots.where("node_id is not null").select("node_id", F.lit(0).alias("depth")).distinct()
        nodes = self._nearer(found)
        self._commit("roots", {"nodes": nodes}, {}, depth=0, changed=nodes.count())

    def add_citations(self, batch: DataFrame, number: int | None = None) -> None:
        """Citations (source_id, target_id, source_api, citation_date, seq). Those of parents that are expanded lower the depths of their sources at once.

        A ``number`` that was taken before changes nothing. Loops and rows without an end are left out.
        """
        state = self.store.state()
        if number is not None and number <= state.batch:
            return
        rows = materialise(batch.where("source_id <> target_id").select("source_id", "target_id", "source_api", "citation_date", "seq"), "crawl-batch")
        asked = self.store.read("expanded", state).where(self.expandable).select(F.col("node_id").alias("target_id"))
        depth = self.store.read("nodes", state).where(F.col("depth") < self.max_depth).select(F.col("node_id").alias("target_id"), (F.col("depth") + 1).alias("depth"))
        hit = among(rows.select("source_id", "target_id"), "target_id", asked).join(depth, "target_id")
        nodes = self._nearer(hit.groupBy(F.col("source_id").alias("node_id")).agg(F.min("depth").alias("depth")))
        n = rows.count()
        self._commit("citations", {"citations": rows, "nodes": nodes}, {"citations": n}, number=number, citations=n, changed=nodes.count())

    def step(self, failed: DataFrame | None = None, parent_limit: int | None = None, cap: int | None = None) -> bool:
        """Expand the shallowest pending level; whether there was one.

        failed: (node_id, error) of parents that could not be asked: they stay pending, with their error until they succeed. parent_limit: only so many parents,
        the first by id. cap: parents expand in id order while the new nodes before them, with those of the next depth so far, are fewer; the step is then
        truncated, and what it left is pending.
        """
        waiting = self.pending()
        able = waiting if failed is None else waiting.join(failed.select("node_id"), "node_id", "left_anti")
        depth = able.agg(F.min("depth")).first()[0]
        if depth is None:
            depth = None if failed is None else waiting.agg(F.min("depth")).first()[0]  # all that wait have failed
        if depth is None:
            return False
        level = waiting.where(F.col("depth") == depth).select("node_id")
        parents = level if failed is None else level.join(failed.select("node_id"), "node_id", "left_anti")
        if parent_limit is not None:
            parents = parents.orderBy("node_id").limit(parent_limit)
        parents, truncated = materialise(parents, "crawl-parents"), False
        state = self.store.state()
        cites = lambda asked: self.store.read("citations", state, asked).select("source_id", "target_id")  # noqa: E731  of those parents alone
        asks = lambda p: p.where(self.expandable).select(F.col("node_id").alias("target_id"))
        if cap is not None:
            every = parents.count()
            parents = materialise(self._within(parents, cites(asks(parents)), depth + 1, cap), "crawl-parents")
            truncated = parents.count() < every
        hit = cites(asks(parents))
        found = materialise(hit.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("n")), "crawl-found")
        nodes = self._nearer(found.select("node_id", F.lit(depth + 1).alias("depth")))
        asked = F.count_if(F.expr(f"not coalesce({self.expandable}, false)"))
        counts = dict(zip(("parents", "without_doi"), parents.agg(F.count("*"), asked).first())) | {"citations": found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
        batch = {"expanded": parents.select("node_id", F.lit(depth).alias("at_depth")), "nodes": nodes}
        marks = []  # failures that are new, and marks that clear old ones
        if state.runs.get("failures"):
            marks.append(parents.join(self.failures(), "node_id", "left_semi").select("node_id", F.lit(None).cast("string").alias("error")))
        if failed is not None:
            gone = level.join(failed.groupBy("node_id").agg(F.min("error").alias("error")), "node_id")
            marks.append(materialise(gone.select("node_id", F.coalesce("error", F.lit("failed")).alias("error")), "crawl-failed"))
            counts["failed"] = marks[-1].count()
        if marks:
            batch["failures"] = reduce(DataFrame.unionByName, marks).withColumn("step", F.lit(state.number + 1).cast("long"))
        self._commit("level", batch, {"expanded": counts["parents"]}, depth=depth, truncated=truncated, changed=nodes.count(), **counts)
        return counts["parents"] > 0

    def run(self, failed: DataFrame | None = None) -> None:
        """Step until nothing is pending, or only parents that fail."""
        while self.step(failed):
            pass

    # --- helpers ---

    def _nearer(self, found: DataFrame) -> DataFrame:
        """Those of (node_id, depth) that are new or nearer than known."""
        known = self.store.read("nodes").select("node_id", F.col("depth").alias("_d"))
        return materialise(found.join(known, "node_id", "left").where("_d is null or depth < _d").select("node_id", "depth"), "crawl-nodes")

    def _within(self, parents: DataFrame, hit: DataFrame, depth: int, cap: int) -> DataFrame:
        """The first parents by id whose new nodes fit: a node belongs to the least of its parents."""
        known = self.store.read("nodes")
        have = known.where(F.col("depth") == depth).count()
        fresh = hit.join(known.where(F.col("depth") <= depth).select(F.col("node_id").alias("source_id")), "source_id", "left_anti")
        owned = fresh.groupBy("source_id").agg(F.min("target_id").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
        rows = parents.join(owned, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))
        return running(rows, [F.col("node_id")], F.col("n"), "before").where(F.col("before") + have < cap).select("node_id")

    def _commit(self, kind: str, batch: dict[str, DataFrame], sizes: dict[str, int], changed: int, number: int | None = None, **counts: int | bool) -> None:
        """One commit of all tables, with a row of the log."""
        state = self.store.state()
        row = {"step": state.number + 1, "kind": kind, "depth": None, "parents": 0, "failed": 0, "without_doi": 0, "citations": 0, "changed": changed, "truncated": False} | counts
        self.store.commit(batch, number, {"log": [*state.note.get("log", []), list(row.values())]}, sizes | {"nodes": changed})
