"""A crawl in batches and steps against one breadth-first search, and the store below it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citetrace.operators import graph
from citetrace.operators.crawl import Crawl
from citetrace.plans.log_store import LogStore, Table

CITES = "source_id string, target_id string, source_api string, citation_date date, seq long"


def citations(seed, n_nodes, n):
    rnd = random.Random(seed)
    hub = "n0"
    rows = [(f"n{rnd.randrange(n_nodes)}", hub if rnd.random() < 0.2 else f"n{rnd.randrange(n_nodes)}", "openalex", None, i) for i in range(n)]
    return rows


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_batches_and_stops_give_one_search(spark, tmp_path):
    parts = 3
    all_rows = citations(parts, 90, 160)
    roots = spark.createDataFrame([("n1",), ("n2",), (None,)], "node_id string")
    folder = f"file://{tmp_path}/crawl"
    Crawl(spark, folder, 3, tier_rows=10).add_roots(roots)
    for k in range(parts):
        Crawl(spark, folder, 3, tier_rows=10).add_citations(spark.createDataFrame(all_rows[k::parts], CITES), number=k)
        if k == 1:
            Crawl(spark, folder, 3, tier_rows=10).step()  # stops between two levels, and goes on as another object
        elif k != 1:
            Crawl(spark, folder, 3, tier_rows=10).run()
    crawl = Crawl(spark, folder, 3, tier_rows=10)
    crawl.run()
    crawl.add_citations(spark.createDataFrame(all_rows[:5], CITES), number=parts - 1)  # a retry
    whole = spark.createDataFrame(all_rows, CITES)
    one = graph.bfs(whole, roots, 3)
    assert rows(crawl.nodes().select("node_id", "depth")) == rows(one)
    assert crawl.pending().isEmpty() and crawl.nodes().where("processed <> (depth < 3)").isEmpty()
    assert rows(crawl.edges()) == rows(graph.level_edges(whole, one, 3).select(*crawl.edges().columns))


def test_a_later_batch_expands_only_what_it_changes(spark, tmp_path):
    chain = [(f"c{i + 1}", f"c{i}", "openalex", None, i) for i in range(6)] + [(f"x{i}", "c1", "openalex", None, 100 + i) for i in range(20)]
    crawl = Crawl(spark, f"file://{tmp_path}/crawl", 5)
    crawl.add_roots(spark.createDataFrame([("c0",)], "node_id string"))
    crawl.add_citations(spark.createDataFrame(chain, CITES))
    crawl.run()
    before = crawl.log().agg(F.max("step")).first()[0]
    # c4 cites the root itself: it and what follows come nearer; the twenty others are not touched
    crawl.add_citations(spark.createDataFrame([("c4", "c0", "openalex", None, 900), ("y", "x3", "openalex", None, 901), ("z", "far", "openalex", None, 902)], CITES))
    crawl.run()
    later = [(r.kind, r.depth, r.parents, r.citations, r.changed) for r in crawl.log().where(F.col("step") > before).orderBy("step").collect()]
    # y cites a node that is expanded, so it is found with the batch and is expanded itself later
    assert later == [("citations", None, 0, 3, 2), ("level", 1, 1, 1, 1), ("level", 2, 1, 1, 1), ("level", 3, 2, 0, 0)]
    assert dict(crawl.nodes().select("node_id", "depth").collect())["c6"] == 3


def test_failed_parents_wait_and_are_cleared(spark, tmp_path):
    rows_ = [("a", "r", "openalex", None, 1), ("b", "r", "openalex", None, 2), ("c", "a", "openalex", None, 3), ("d", "b", "openalex", None, 4), ("e", "pmid:1", "openalex", None, 5), ("pmid:1", "r", "openalex", None, 6)]
    crawl = Crawl(spark, f"file://{tmp_path}/crawl", 2, expandable="node_id not like 'pmid:%'")
    crawl.add_roots(spark.createDataFrame([("r",)], "node_id string"))
    crawl.add_citations(spark.createDataFrame(rows_, CITES))
    assert crawl.step()
    bad = spark.createDataFrame([("b", "timeout"), ("zz", "unknown")], "node_id string, error string")
    crawl.run(bad)
    assert rows(crawl.failures()) == Counter([("b", "timeout")])
    assert [r.node_id for r in crawl.pending().collect()] == ["b"]
    assert rows(crawl.nodes().select("node_id", "depth")) == Counter([("r", 0), ("a", 1), ("b", 1), ("pmid:1", 1), ("c", 2)])
    crawl.run()
    assert crawl.failures().isEmpty() and crawl.pending().isEmpty()
    assert ("d", 2) in rows(crawl.nodes().select("node_id", "depth"))
    last = crawl.log().where("kind = 'level' and depth = 1").orderBy("step").collect()
    assert [(r.parents, r.failed, r.without_doi) for r in last[:1]] == [(2, 1, 1)]


def test_capped_steps_and_limits(spark, tmp_path):
    found = [(f"s{p}{i}", f"p{p}", "openalex", None, 10 * p + i) for p in range(4) for i in range(5)] + [(f"p{p}", "r", "openalex", None, 100 + p) for p in range(4)]
    crawl = Crawl(spark, f"file://{tmp_path}/crawl", 2)
    crawl.add_roots(spark.createDataFrame([("r",)], "node_id string"))
    crawl.add_citations(spark.createDataFrame(found, CITES))
    crawl.step()
    crawl.step(cap=7)  # p0 (0 before), p1 (5 before); p2 has 10 before
    assert [r.node_id for r in crawl.pending().orderBy("node_id").collect()] == ["p2", "p3"]
    assert crawl.nodes().where("depth = 2").count() == 10
    crawl.step(parent_limit=1)
    assert [r.node_id for r in crawl.pending().collect()] == ["p3"]
    crawl.run()
    assert crawl.nodes().where("depth = 2").count() == 20
    assert [r.truncated for r in crawl.log().where("kind = 'level'").orderBy("step").collect()] == [False, True, False, False]


# --- the store --------------------------------------------------------------------------------------------

TABLE = {"t": Table("k long, v long, seq long", ("k",), ("v", "seq"))}


def least(all_rows):
    best = {}
    for k, v, s in all_rows:
        best[k] = min(best.get(k, (v, s)), (v, s))
    return Counter((k, *x) for k, x in best.items())


def test_store_merges_compacts_and_splits(spark, tmp_path):
    rnd = random.Random(4)
    store = LogStore(spark, f"file://{tmp_path}/s", TABLE, bucket_rows=60, tier_rows=8, fan=3)
    taken = []
    for n in range(7):
        batch = [(rnd.randrange(150), rnd.randrange(50), n * 100 + i) for i in range(rnd.choice((5, 40)))]
        store.commit({"t": spark.createDataFrame(batch, TABLE["t"].schema)}, number=n)
        store.commit({"t": spark.createDataFrame([(0, -1, 0)], TABLE["t"].schema)}, number=n)  # a retry with other rows is not taken
        taken += batch
        if n > 2:
            assert rows(store.read("t")) == least(taken)
    state = store.state()
    assert state.bits["t"] > 0 and len(store.states()) == 2
    per = Counter((r["bits"], r["bucket"]) for r in state.runs["t"])
    assert {r["bits"] for r in state.runs["t"]} == {state.bits["t"]} and max(per.values()) <= 2 * 4
    on_disk = {str(p.parent.parent.name) + "/" + p.parent.name for p in (tmp_path / "s/t").glob("*/_bucket=*/*.parquet")}
    named = {"/".join(r["path"].split("/")[1:]) for number in store.states() for r in store.state(number).runs["t"]}
    assert on_disk == named  # what no manifest names is gone


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", TABLE)
    store.commit({"t": spark.range(200_000).selectExpr("id as k", "id as v", "id as seq")})
    large = store.state()
    for n in range(3):
        store.commit({"t": spark.range(100).selectExpr(f"id * 7 as k", "-1L as v", "id as seq")})
        now = store.state()
        assert now.rewritten == 0 and now.written < large.written / 50
    assert store.read("t").where("v = -1").count() == 100 and store.read("t").count() == 200_000


def test_an_attempt_without_a_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    store = LogStore(spark, f"file://{tmp_path}/s", TABLE)
    store.commit({"t": spark.createDataFrame([(1, 5, 1)], TABLE["t"].schema)}, number=0)
    monkeypatch.setattr(LogStore, "_publish", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.commit({"t": spark.createDataFrame([(1, 4, 1), (2, 2, 2)], TABLE["t"].schema)}, number=1)
    monkeypatch.undo()
    assert rows(store.read("t")) == Counter([(1, 5, 1)])
    store.commit({"t": spark.createDataFrame([(1, 4, 1), (2, 2, 2)], TABLE["t"].schema)}, number=1)
    assert rows(store.read("t")) == Counter([(1, 4, 1), (2, 2, 2)])
    with pytest.raises(RuntimeError):
        store._publish(store.state())  # the number is taken
