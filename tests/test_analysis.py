"""A whole analysis in one call over a folder of tables."""

from datetime import date

import pytest
from test_graph import toy

from citetrace.plans import analysis
from citetrace.sources import sinks


def test_toy_study_in_one_call(spark, tmp_path):
    records, edges, works, frontier = toy(spark)
    base = f"file://{tmp_path}"
    for name, df in {"seeds": records, "works": works, "frontier_nodes": frontier, "citation_edges": edges}.items():
        df.write.parquet(f"{base}/in/{name}")
    paths = analysis.analyse(spark, f"{base}/in", f"{base}/out")
    read = {name: spark.read.parquet(path) for name, path in paths.items() if name != "graph"}
    m = {r.node_id: r for r in read["seed_metrics"].collect()}
    counts = ("direct_citers", "depth2_descendants", "total_depth2_reach", "post_notice_direct_citers", "post_notice_depth2_descendants")
    assert [m["S1"][c] for c in counts] == [2, 1, 3, 1, 1] and [m["S2"][c] for c in counts] == [1, 1, 2, 1, 1]
    assert {(r.depth, r.node_count) for r in read["depth_counts"].collect()} == {(0, 2), (1, 3), (2, 2)}
    assert {r.node_id: (r.cited_seeds, r.depth2_citers) for r in read["bridge_papers"].collect()} == {"D1A": (1, 1), "D1B": (1, 0), "D1C": (1, 1)}
    s = {r.metric: r.value for r in read["summary"].collect()}
    assert (s["depth2_nodes"], s["depth2_edges"], s["weak_components"], s["post_notice_direct_citers"]) == ("7", "5", "2", "2")
    h = read["headline"].first()
    assert (h.total_edges, h.direct_unique_nodes, h.depth2_unique_nodes, h.reach_max) == (5, 2, 2, 3)
    c = {r.check_name: r.status for r in read["checks"].collect()}
    assert c["required_metadata"] == "fail" and c["full_graph_export"] == "pass" and c["stored_vs_exported_edges"] == "pass" and c["output_exists:summary"] == "pass"
    assert list((tmp_path / "out/graphs/network_depth2").glob("*.gz"))
    sinks.write_graphml(read["nodes"], read["edges"].limit(0), paths["graph"])  # results are replaced
    assert tuple(sinks.read_manifest(spark, paths["graph"]).first()) == (7, 0)


def test_tables_are_shaped(spark, tmp_path):
    base = f"file://{tmp_path}/in"
    spark.createDataFrame([("R1", "S1", date(2020, 1, 1), "x")], "record_id string, node_id string, notice_date date, own string").write.parquet(f"{base}/seeds.parquet")
    spark.createDataFrame([("S1", "2019-05-06")], "node_id string, publication_date string").write.parquet(f"{base}/works")
    with pytest.raises(FileNotFoundError, match="frontier_nodes"):
        analysis.Tables.load(spark, base)
    spark.createDataFrame([("S1", 0, None)], "node_id string, depth long, processed_at timestamp").write.parquet(f"{base}/frontier_nodes")
    spark.createDataFrame([("S1",)], "source_id string").write.parquet(f"{base}/citation_edges")
    with pytest.raises(ValueError, match="target_id, depth"):
        analysis.Tables.load(spark, base)
    spark.createDataFrame([], "source_id string, target_id string, depth int").write.mode("overwrite").parquet(f"{base}/citation_edges")
    t = analysis.Tables.load(spark, base)
    assert t.works.first().publication_year == 2019 and t.seeds.first().resolved_status == "resolved" and t.frontier.first().processed is False and t.metadata.count() == 0


def test_works_that_no_result_joins_are_left_out(spark):
    """Once, before all joins; works of the frontier and of seeds outside it stay, with all their columns."""
    frames = {
        "seeds": spark.createDataFrame([("R1", "S1"), ("R2", None)], "record_id string, node_id string"),
        "works": spark.createDataFrame([("S1", "a"), ("D1", "b"), ("X1", "c"), (None, "d")], "node_id string, title string"),
        "frontier_nodes": spark.createDataFrame([("D1", 1), ("D2", 1)], "node_id string, depth int"),
        "citation_edges": spark.createDataFrame([("D1", "S1", 1)], "source_id string, target_id string, depth int"),
        "run_metadata": spark.createDataFrame([], "key string, value string"),
    }
    t = analysis.Tables.of(frames)
    known = analysis.known_works(t, t.seeds.where("node_id is not null"))
    assert known.columns == t.works.columns and {(r.node_id, r.title) for r in known.collect()} == {("S1", "a"), ("D1", "b")}
    made = dict(analysis.results(t))
    assert {r.node_id: r.title for r in made["nodes"].collect()} == {"D1": "b", "D2": None}
