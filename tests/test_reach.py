"""Reach and distinct counts by bitmaps against the plain pairs."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from citetrace.operators import metrics, reach


def graph_of(spark, seed, n_seeds=12, n_direct=60, n_second=400, hub=True):
    """Seeds, papers that cite them, papers that cite those, with a hub on either level, unknown dates, and edges that do not count."""
    rnd = random.Random(seed)
    day = lambda: None if rnd.random() < 0.1 else date(2000, 1, 1) + timedelta(days=rnd.randrange(3000))
    s, d, e = ([f"{k}{i}" for i in range(n)] for k, n in (("s", n_seeds), ("d", n_direct), ("e", n_second)))
    edges = {(x, rnd.choice(s), 1) for x in d for _ in range(rnd.randrange(1, 4))} | {(x, rnd.choice(d), 2) for x in e for _ in range(rnd.randrange(1, 4))}
    if hub:
        edges |= {(x, "d0", 2) for x in e} | {("d0", y, 1) for y in s[:5]} | {(x, "s0", 1) for x in d}
    edges |= {("s1", "s0", 1), ("d1", "d2", 2), ("out", "s2", 1), ("out", "d3", 2), ("e1", "s3", 1)}
    depth = {**dict.fromkeys(s, 0), **dict.fromkeys(d, 1), **dict.fromkeys(e, 2)}
    works = spark.createDataFrame([(n, x := day(), x and x.year) for n in [*depth, "out"]], "node_id string, publication_date date, publication_year int")
    frontier = spark.createDataFrame(list(depth.items()), "node_id string, depth int")
    edges = spark.createDataFrame([(*x, rnd.choice("ab")) for x in sorted(edges)], "source_id string, target_id string, depth int, source_api string")
    canonical = spark.createDataFrame([(n, day()) for n in [*s, "unseen"]], "node_id string, notice_date date")
    return canonical, edges, frontier, works


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("sizes", [{}, {"heavy": 20, "large": 30, "sparse": 1000}, {"heavy": 1, "large": 0, "sparse": 10**9}])
def test_reach_equals_pairs(spark, sizes, monkeypatch):
    canonical, edges, frontier, works = graph_of(spark, 7)
    want = rows(metrics.seed_metrics(canonical, edges, frontier, works).select("node_id", *reach.COUNTS))
    nodes = reach.number_nodes(frontier, works, canonical)
    numbered = reach.number_edges(edges, nodes)
    got = reach.seed_metrics(canonical, nodes, numbered, **sizes)
    assert rows(got.select("node_id", *reach.COUNTS)) == want
    for hop, n in reach.unique_post(canonical, nodes, numbered).collect():
        assert n == metrics.unique_post(canonical, edges, frontier, works, hop).first()[0]


def test_reach_over_many_buckets(spark):
    """Numbers spread over several bitmaps, cuts within and at the edges of buckets."""
    works = spark.range(1, 100_001).selectExpr("concat('e', id) node_id", "date_add(date'2000-01-01', cast(id / 7 as int)) publication_date", "1 publication_year")
    more = spark.createDataFrame([(n, None, None) for n in ("s0", "s1", "d0", "d1")], "node_id string, publication_date date, publication_year int")
    works = works.unionByName(more)
    frontier = works.selectExpr("node_id", "case substring(node_id, 1, 1) when 's' then 0 when 'd' then 1 else 2 end depth")
    edges = spark.range(1, 100_001).selectExpr("concat('e', id) source_id", "'d0' target_id", "2 depth", "'a' source_api")
    edges = edges.unionByName(spark.range(1, 100_001, 3).selectExpr("concat('e', id) source_id", "'d1' target_id", "2 depth", "'a' source_api"))
    edges = edges.unionByName(spark.createDataFrame([("d0", "s0", 1, "a"), ("d1", "s0", 1, "a"), ("d1", "s1", 1, "a")], "source_id string, target_id string, depth int, source_api string"))
    nodes = reach.number_nodes(frontier, works, frontier.where("depth = 0"))
    numbered = reach.number_edges(edges, nodes)
    for n in (0, 32764, 65533, 99_990):
        day = date(2000, 1, 1) + timedelta(days=n // 7)
        canonical = spark.createDataFrame([("s0", day), ("s1", day)], "node_id string, notice_date date")
        got = {r.node_id: r for r in reach.seed_metrics(canonical, nodes, numbered, large=100, sparse=10**9).collect()}
        after = sum(1 for i in range(1, 100_001) if i // 7 > n // 7)
        assert (got["s0"].depth2_descendants, got["s0"].post_notice_depth2_descendants, got["s0"].total_depth2_reach) == (100_000, after, 100_002)
        third = [i for i in range(1, 100_001, 3)]
        assert (got["s1"].depth2_descendants, got["s1"].post_notice_depth2_descendants) == (len(third), sum(1 for i in third if i // 7 > n // 7))


def test_hub_is_not_listed(spark):
    """Fifty seeds share a parent of 20,000 citers: no join gives their million pairs, and no plan expands rows."""
    e = spark.range(20_000).selectExpr("concat('e', id) node_id")
    works = e.selectExpr("node_id", "date'2010-01-01' publication_date")
    frontier = e.selectExpr("node_id", "2 depth").unionByName(spark.createDataFrame([("d", 1), *((f"s{i}", 0) for i in range(50))], "node_id string, depth int"))
    edges = e.selectExpr("node_id source_id", "'d' target_id", "2 depth", "'a' source_api").unionByName(spark.range(50).selectExpr("'d' source_id", "concat('s', id) target_id", "1 depth", "'a' source_api"))
    canonical = spark.range(50).selectExpr("concat('s', id) node_id", "date'2009-01-01' notice_date")
    nodes = reach.number_nodes(frontier, works, canonical)
    got = reach.seed_metrics(canonical, nodes, reach.number_edges(edges, nodes))
    assert {tuple(r[c] for c in reach.COUNTS) for r in got.collect()} == {(1, 20_000, 20_001, 0, 20_000)}
    plan = got._jdf.queryExecution().executedPlan()
    assert "Expand" not in plan.toString()

    def made(node):
        while node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ResultQueryStageExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            node = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan()
        own = node.metrics().get("numOutputRows")
        here = [own.get().value()] if "Join" in node.getClass().getSimpleName() and own.isDefined() else []
        kids = node.children()
        return here + [x for i in range(kids.size()) for x in made(kids.apply(i))]

    assert max(made(plan)) < 50_000


def test_edge_depths_equal_plain(spark):
    _, edges, frontier, works = graph_of(spark, 3)
    inside = edges.where("source_id <> 'out'")
    nodes = reach.number_nodes(frontier, works, frontier.where("depth = 0"))
    got = reach.edge_depths(reach.number_edges(inside, nodes), 2)
    assert rows(got) == rows(metrics.edge_depths(inside, 2).select(*got.columns))
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_dense_and_by_date(spark):
    canonical, edges, frontier, works = graph_of(spark, 5)
    got = reach.number_nodes(frontier, works, canonical).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))
    key = [(r.day or date(1, 1, 1), r.node_id) for r in got]
    assert key == sorted(key) and {"unseen"} < {r.node_id for r in got}
