import random
from datetime import date

from pyspark.sql import functions as F

from citetrace.operators import control, graph, metadata, metrics, quality, reach, seeds, stats
from citetrace.operators.components import connected_components
from citetrace.operators.ordered import running
from citetrace.sources import readers, sinks
from citetrace.streaming import merge

D = date
EDGES = [("D1A", "S1", 1), ("D1B", "S1", 1), ("D1C", "S2", 1), ("D2A", "D1A", 2), ("D2B", "D1C", 2)]
WORKS = [
    ("S1", D(2019, 1, 1)), ("S2", D(2018, 1, 1)), ("D1A", D(2021, 3, 10)), ("D1B", D(2018, 5, 1)), ("D1C", D(2020, 8, 20)), ("D2A", D(2022, 4, 1)), ("D2B", D(2021, 12, 15)),
]


def toy(spark, extra_edges=(), extra_works=(), depths=None):
    depth = depths or {"S": 0, "D1": 1, "D2": 2}
    of = lambda n: depth.get(n, depth.get(n[:2], depth.get(n[:1])))
    edges = spark.createDataFrame([(*e, "openalex") for e in [*EDGES, *extra_edges]], "source_id string, target_id string, depth int, source_api string")
    works = spark.createDataFrame([(n, d, d.year if d else None, f"Title {n}") for n, d in [*WORKS, *extra_works]], "node_id string, publication_date date, publication_year int, title string")
    frontier = spark.createDataFrame([(n, of(n), of(n) < 2) for n, _ in [*WORKS, *extra_works] if of(n) is not None], "node_id string, depth int, processed boolean")
    rows = [("R1", "S1", D(2020, 1, 15), "resolved"), ("R2", "S2", D(2019, 6, 1), "resolved")]
    records = spark.createDataFrame([(r, n, d, s, "Retraction", f"T {n}") for r, n, d, s in rows], "record_id string, node_id string, notice_date date, resolved_status string, notice_type string, title string")
    return records, edges, works, frontier


def by_node(df):
    return {r.node_id: r for r in df.collect()}


def test_toy_metrics(spark):
    records, edges, works, frontier = toy(spark)
    m = by_node(metrics.seed_metrics(seeds.canonical(records), edges, frontier, works))
    assert [m["S1"][c] for c in metrics.COUNTS] == [2, 1, 3, 1, 1]
    assert [m["S2"][c] for c in metrics.COUNTS] == [1, 1, 2, 1, 1]
    b = by_node(metrics.bridges(edges, frontier, works))
    assert {k: (r.cited_seeds, r.depth2_citers) for k, r in b.items()} == {"D1A": (1, 1), "D1B": (1, 0), "D1C": (1, 1)}
    canonical = seeds.canonical(records)
    dated = metrics.dated_pairs(metrics.seed_pairs(canonical, edges, frontier), canonical, works)
    meta = spark.createDataFrame([("pipeline_mode", "toy")], "key string, value string")
    expected = spark.createDataFrame([("D1A", 1), ("D1B", 3)], "node_id string, expected long")
    nodes = reach.number_nodes(frontier, works, canonical)
    numbered = nodes, reach.number_edges(edges, nodes)
    h = metrics.headline(records, records.limit(0), meta, edges, frontier, works, numbered, metrics.of_pairs(canonical, dated), edges, expected).first()
    assert (h.total_edges, h.depth1_edges, h.depth2_edges, h.direct_unique_nodes, h.depth2_unique_nodes) == (5, 3, 2, 2, 2)
    assert (h.depth1_distinct_sources, h.depth1_distinct_targets, h.depth2_distinct_sources, h.depth2_distinct_targets) == (3, 2, 2, 2)
    assert (h.seed_papers, h.reach_median, h.reach_max, h.zero_reach_n, h.pipeline_mode, h.oc_access_date) == (2, 2.5, 3, 0, "toy", "unknown")
    assert (h.exact_parents, h.undercount_parents, h.overcount_parents, h.net_delta_citations) == (1, 1, 1, -2)  # D1C is found, not expected
    assert (h.zero_count_pruned, h.stale_edges_deleted) == (1, 0)


def test_rules_that_separate(spark):
    """A depth-2 edge of a depth-1 source, a seed citing a seed, a source outside, a null date."""
    extra = [("D1B", "D1A", 2), ("S2", "S1", 1), ("X", "S1", 1), ("D2N", "D1B", 2)]
    records, edges, works, frontier = toy(spark, extra, [("D2N", None)])
    m = by_node(metrics.seed_metrics(seeds.canonical(records), edges, frontier, works))
    assert [m["S1"][c] for c in metrics.COUNTS] == [3, 2, 5, 1, 1]
    assert "S2" not in by_node(metrics.bridges(edges, frontier, works))


def test_canonical_and_duplicates(spark):
    records, *_ = toy(spark)
    more = records.unionByName(spark.createDataFrame([("R1B", "S1", D(2019, 12, 1), "resolved", "Concern", "T S1"), ("R9", "S1", None, "resolved", None, None)], records.schema))
    r = by_node(seeds.canonical(more))["S1"]
    assert (r.record_id, r.seed_record_count, r.seed_record_ids, r.notice_type, r.notice_date) == ("R1B", 3, "R1B;R1;R9", "Concern; Retraction", D(2019, 12, 1))
    status = {x.record_id: x.resolved_status for x in seeds.mark_duplicates(more).collect()}
    assert status == {"R1": "duplicate_node", "R1B": "resolved", "R9": "duplicate_node", "R2": "resolved"}
    c = seeds.duplicate_counts(more).first()
    assert tuple(c) == (2, 2, 3)


def test_merges(spark):
    nodes = spark.createDataFrame([("W1", 2), ("W1", 1), ("W1", 5)], "node_id string, depth int")
    assert graph.least_depth(nodes).collect()[0].depth == 1
    e = spark.createDataFrame([("A", "B", 2, "openalex", 1), ("A", "B", 1, "opencitations", 2), ("A", "B", 3, "openalex", 3), ("A", "B", 1, "late", 4)], "source_id string, target_id string, depth int, source_api string, seq int")
    r = graph.merge_edges(e).first()
    assert (r.depth, r.source_api) == (1, "opencitations")
    kept = seeds.last_wins(spark.createDataFrame([("k", "a", 1), ("k", None, 2)], "key string, value string, seq int"), ["key"]).first()
    assert kept.value is None


def test_bfs_is_shortest_distance(spark):
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)}
    pairs = {p for p in pairs if p[0] != p[1]}
    want, level = {"n0": 0, "n1": 0}, {"n0", "n1"}
    for d in range(1, 5):
        level = {s for s, t in pairs if t in level} - set(want)
        want |= dict.fromkeys(level, d)
    got = graph.bfs(spark.createDataFrame(list(pairs), "source_id string, target_id string"), spark.createDataFrame([("n0",), ("n1",), (None,)], "node_id string"), 4)
    assert {r.node_id: r.depth for r in got.collect()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}


def test_dual_edges_and_caps(spark):
    c = spark.createDataFrame([("10.5555/one", None, "10.5555/cited", "doi:10.5555/asked", None), (None, "77", None, "doi:10.5555/asked", D(2020, 5, 1)), (None, None, "10.5555/cited", "doi:10.5555/asked", None)], "citing_doi string, citing_pmid string, cited_doi string, parent_id string, creation_date date")
    assert {(r.source_id, r.target_id) for r in graph.citation_edges(c, 1).collect()} == {("doi:10.5555/one", "doi:10.5555/cited"), ("doi:10.5555/one", "doi:10.5555/asked"), ("pmid:77", "doi:10.5555/asked")}
    nodes = by_node(graph.citation_nodes(c, spark.createDataFrame([("pmid:77",)], "node_id string"), 2))
    assert {k: (r.depth, r.is_retracted) for k, r in nodes.items()} == {"doi:10.5555/one": (2, False), "pmid:77": (2, True)}
    many = {"doi:10.1/a": 4, "doi:10.1/b": 6, "doi:10.1/c": 1}
    cites = spark.createDataFrame([(f"n{p}{i}", p) for p, n in many.items() for i in range(n)], "source_id string, target_id string")
    frontier = spark.createDataFrame([(p, 1) for p in many], "node_id string, depth int")
    for cap, want in ((4, {"doi:10.1/a"}), (5, {"doi:10.1/a", "doi:10.1/b"}), (10, {"doi:10.1/a", "doi:10.1/b"}), (11, set(many))):
        assert {r.parent_id for r in graph.capped_level(cites, frontier, 1, cap).collect()} == want


def test_ranges_of_ids_with_a_common_prefix(spark):
    ids = [f"doi:10.{1000 + i % 7}/x{i:04d}" for i in range(1000)]
    rng = random.Random(5)
    rng.shuffle(ids)
    rows = spark.createDataFrame([(i, rng.randrange(5)) for i in ids], "id string, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = running(rows, [F.col("id")], F.col("v"), "before").withColumn("task", F.spark_partition_id()).orderBy("id").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for r in got:
        assert r.before == total
        total += r.v
    assert len({r.task for r in got}) > 1
    batches = sinks.id_batches(rows, "id", 64).orderBy("batch").collect()
    assert [r.batch for r in batches] == list(range(16)) and [x for r in batches for x in r.ids.split(",")] == sorted(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:], strict=False)], "source_id string, target_id string")
    assert [r.n for r in sinks.numbered(edges).orderBy("source_id", "target_id").collect()] == list(range(1, 1000))
    assert running(rows.limit(0), [F.col("id")], F.col("v"), "before").count() == 0


def test_matching(spark):
    import math

    schema = "node_id string, year int, indeg long"
    pool = [("k1", 2015, 2), ("k2", 2015, 2), ("k3", 2015, 20), ("k4", 2015, 300), ("k5", 2015, 300), ("k6", 2015, 300), ("only", 2012, 9)]
    want = [("at_top", 2015, 300), ("above", 2015, 9000), ("below", 2015, 1), ("tie_low", 2015, 2), ("near", 2015, 25), ("one", 2012, 500), ("none", 2013, 5)]
    found = by_node(control.match(spark.createDataFrame(want, schema), spark.createDataFrame(pool, schema)))
    # at or beyond the largest the last but one of the sorted pool, below the least the first; of equal in-degrees below the last id
    assert {k: r.control_id for k, r in found.items()} == {"at_top": "k5", "above": "k5", "below": "k1", "tie_low": "k2", "near": "k3", "one": "only"}
    moved = by_node(control.match(spark.createDataFrame([("up", 2015, 25)], schema), spark.createDataFrame(pool, schema), jitter=2.0))
    assert moved["up"].control_id == "k4" and abs(moved["up"].distance - abs(math.log1p(25) + 2 - math.log1p(300))) < 1e-9
    rng = random.Random(8)
    pool = [(f"p{i:03}", 2000 + i % 3, rng.randrange(1, 12)) for i in range(90)]
    want = [(f"s{i:03}", 2000 + i % 3, rng.randrange(0, 15)) for i in range(60)]
    got = {r.node_id: r.distance for r in control.match(spark.createDataFrame(want, schema), spark.createDataFrame(pool, schema)).collect()}
    for n, y, d in want:
        assert abs(got[n] - min(abs(math.log1p(q) - math.log1p(d)) for _, yy, q in pool if yy == y)) < 1e-9


def test_levels_of_two_sources(spark):
    first = spark.createDataFrame([("b", "a", D(2020, 1, 1), 1), ("c", "b", D(2021, 1, 1), 2), ("a", "a", None, 3)], "source_id string, target_id string, citation_date date, seq long")
    works = spark.createDataFrame([("b", ["a", "z"]), ("d", ["a"]), ("e", ["d", "b"]), ("f", ["z"])], "node_id string, referenced_works array<string>")
    roots = spark.createDataFrame([("a",), (None,)], "node_id string")
    nodes, edges = graph.hybrid_crawl(first, works, roots, 2)
    assert {r.node_id: r.depth for r in nodes.collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert {(r.source_id, r.target_id, r.depth, r.source_api) for r in edges.collect()} == {
        ("b", "a", 1, "opencitations"), ("d", "a", 1, "openalex"), ("c", "b", 2, "opencitations"), ("e", "d", 2, "openalex"), ("e", "b", 2, "openalex")
    }
    stored, hits = graph.page_store(works, roots, 1)
    assert {r.node_id for r in stored.collect()} == {"b", "d", "e", "f"} and hits.count() == 2
    frontier = nodes.withColumn("processed", F.lit(False))
    done = graph.mark_processed(frontier, spark.createDataFrame([("b",), ("nowhere",)], "node_id string"))
    assert [r.node_id for r in graph.pending(done, 1).collect()] == ["d"] and graph.pending(frontier, 1, 1).count() == 1
    failed = spark.createDataFrame([("d",)], "node_id string")
    pairs = edges.select("source_id", "target_id")
    assert tuple(graph.level_stats(pairs, nodes, 1, failed=failed).first()) == (2, 1, 1, 0, 2, 2, 2)
    assert tuple(graph.level_stats(pairs, nodes, 1, expandable="node_id <> 'b'").first()) == (2, 1, 0, 1, 1, 1, 1)
    assert tuple(graph.build(nodes, edges.select("source_id", F.when(F.col("target_id") == "d", "gone").otherwise(F.col("target_id")).alias("target_id"))).first()) == (5, 5, 0, 1)


def test_metadata(spark):
    kv = "key string, value string, seq long"
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = metadata.put(old, spark.createDataFrame([("b", "3", 2), ("b", "4", 1), ("c", None, 1)], kv))
    assert {r.key: r.value for r in new.collect()} == {"a": "1", "b": "3", "c": None}
    asked = spark.createDataFrame([("a",), ("c",), ("x",), ("x",)], "key string")
    assert {r.key: r.value for r in metadata.get(metadata.delete(new, asked.where("key = 'a'")), asked, "-").collect()} == {"a": "-", "c": "-", "x": "-"}
    failures = spark.createDataFrame([("failed:a", "x"), ("failed:b", "x"), ("mode", "x")], "key string, value string")
    assert {r.key for r in merge.clear_failures(failures, spark.createDataFrame([("a",)], "node_id string"), "failed:").collect()} == {"failed:b", "mode"}
    one = spark.createDataFrame([("/in/rw_20240102T030405Z.csv", D(2024, 3, 1))], "path string, today date")
    assert {r.key: r.value for r in metadata.provenance(one, F.col("path"), "m", F.col("today")).collect()} == {
        "pipeline_mode": "m", "rw_snapshot_date": "20240102T030405Z", "oc_access_date": "2024-03-01", "openalex_access_date": "not used"
    }


def test_resolution(spark):
    s = [("r1", "10.1/a", None, "One", "A B"), ("r2", None, "9", "Two", "A B"), ("r3", None, None, "Three", "A Smith"), ("r4", None, None, "Nowhere", None), ("r5", "10.1/none", None, None, None)]
    rows = spark.createDataFrame(s, "record_id string, original_doi string, original_pmid string, title string, author string")
    works = spark.createDataFrame([("W1", "10.1/a", None, "x", ["q"], 1), ("W2", None, "9", "y", ["q"], 1), ("W3", None, None, "three!", ["J Jones"], 1), ("W4", None, None, "Three", ["K Smith"], 2)], "node_id string, doi string, pmid string, title string, authors array<string>, rank int")
    got = {r.record_id: (r.resolved_node, r.resolved_by, r.status) for r in seeds.resolve(rows, works).collect()}
    assert got == {"r1": ("W1", "doi", "resolved"), "r2": ("W2", "pmid", "resolved"), "r3": ("W4", "title_author", "resolved"), "r4": (None, "all", "not_found"), "r5": (None, "all", "not_found")}
    assert tuple(seeds.resolve_stats(seeds.resolve(rows, works)).first()) == (3, 2, 0, 5)
    exact = seeds.resolve(rows, works, title_fallback=False)
    assert {r.status for r in exact.collect() if r.record_id > "r2"} == {"pending_title_fallback"} and seeds.resolve(rows, works, limit=2).count() == 2


def test_statistics(spark):
    rng = random.Random(1)
    x = [rng.randrange(0, 40) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in x], "x long")
    brute = sum(abs(a - b) for a in x for b in x) / (2 * len(x) ** 2 * (sum(x) / len(x)))
    assert abs(stats.gini(df, "x").first().gini - brute) < 1e-9
    assert stats.gini(df.limit(0), "x").first().gini is None
    assert stats.gini(df.select(F.lit(0).alias("x")), "x").first().gini == 0
    q = stats.quantiles(spark.createDataFrame([(1,), (2,), (10,)], "x long"), "x").first()
    assert abs(q.p90 - 8.4) < 1e-9
    assert {r.value: round(r.share, 4) for r in stats.ccdf(spark.createDataFrame([(0,), (1,), (1,), (5,)], "x long"), "x").collect()} == {1: 0.75, 5: 0.25}
    w = stats.wilcoxon(spark.createDataFrame([(float(i),) for i in range(-3, 20)], "d double"), "d").first()
    assert w.n == 22 and 0 < w.p < 0.01


def test_checks(spark):
    meta = spark.createDataFrame([(k, "1") for k in quality.REQUIRED], "key string, value string")
    pending = spark.createDataFrame([("S1", 0, False)], "node_id string, depth int, processed boolean")
    assert quality.required_metadata(spark, meta).first().status == "pass"
    assert quality.required_metadata(spark, meta.limit(0)).first().status == "fail"
    assert quality.frontier_processed(pending, 2).first().status == "fail"
    records, *_ = toy(spark)
    assert quality.duplicate_canonical(seeds.canonical(records), records).first().status == "pass"
    part = quality.required_metadata(spark, meta.where("key in ('pipeline_mode', 'oc_access_date')")).first()
    assert part.observed == "oc_access_date;pipeline_mode" and part.expected == ";".join(quality.REQUIRED) and part.details.startswith("Missing: rw_snapshot_date;opencitations_seed_stats")
    counted = spark.createDataFrame([(3, 2, 3, 1)], "expected_nodes long, expected_edges long, written_nodes long, written_edges long")
    assert quality.manifest_matches(counted).first().status == "fail"


def test_outputs_exist(spark, tmp_path):
    spark.range(2).write.parquet(f"file://{tmp_path}/full")
    spark.range(0).write.parquet(f"file://{tmp_path}/empty")
    got = quality.outputs_exist(spark, {n: f"file://{tmp_path}/{n}" for n in ("full", "empty", "none")}).collect()
    assert {r.check_name: r.status for r in got} == {"output_exists:full": "pass", "output_exists:empty": "fail", "output_exists:none": "fail"}


def test_notice_rows(spark):
    names = ["Record ID", "RecordID", "Title", "RetractionNature", "RetractionDate", "OriginalPaperDOI", "OriginalPaperPubMedID"]
    rows = [
        (" 501 ", None, "t", "Retraction", "11/30/2018 0:00", "HTTPS://DX.DOI.ORG/10.4321/QrS.5", "PMID 8080"),
        (None, "502", "t", "Reinstatement; Expression of Concern", "2019/2/3", "unavailable", "0"),
        ("", "503", "t", "Retraction", "", None, None),
        ("504", None, "t", "Correction", "12/1/2018", None, None),
        (" ", " ", "t", "Retraction", None, None, None),
    ]
    got = {r.record_id: (str(r.notice_date), r.original_doi, r.original_pmid) for r in seeds.from_notices(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))).collect()}
    assert got == {"501": ("2018-11-30", "10.4321/qrs.5", "8080"), "502": ("2019-02-03", None, None), "503": ("None", None, None)}


def test_nested_works(spark):
    doc = '{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1234/ABC","display_name":"A work","publication_date":"2020-01","referenced_works":["https://openalex.org/W0","https://openalex.org/W11"],"primary_topic":{"id":"https://openalex.org/T1","domain":{"display_name":"Health"}}}'
    w = readers.works_from_json(spark.createDataFrame([(doc,), ("broken",)], "json string")).orderBy(F.col("node_id").desc_nulls_last()).collect()
    assert (w[0].node_id, w[0].doi, w[0].title, str(w[0].publication_date), w[0].topic_id, w[0].topic_domain, w[0].referenced_works) == ("W1", "10.1234/abc", "A work", "2020-01-01", "T1", "Health", ["W0", "W11"])
    assert w[1].node_id is None
    works = spark.createDataFrame([("W2", ["W0", "W9", "W1", "W0"])], "node_id string, referenced_works array<string>")
    parents = spark.createDataFrame([("W0",), ("W1",)], "node_id string")
    assert sorted(r.target_id for r in graph.reference_edges(works, parents).collect()) == ["W0", "W1"]


def test_graphml_file(spark, tmp_path):
    import gzip

    records, edges, works, frontier = toy(spark)
    rest = {k: F.lit("a & b" if k == "doi" else None).cast("string") for k, _ in sinks.NODE_KEYS if k not in ("depth", "title", "publication_year")}
    nodes = graph.induced_nodes(frontier, works.withColumns(rest), 2)
    edges = edges.withColumn("citation_date", F.lit(date(2020, 2, 3)))
    sinks.write_graphml(nodes, edges, f"file://{tmp_path}/g")
    text = "".join(gzip.open(p, "rt").read() for p in sorted((tmp_path / "g").glob("*.gz")))
    lines = text.splitlines()
    assert lines[0].startswith("<?xml") and lines[-1] == "</graphml>" and sum("<node" in x for x in lines) == 7 and sum("<edge" in x for x in lines) == 5
    import xml.etree.ElementTree as xml

    ns = {"g": "http://graphml.graphdrawing.org/xmlns"}
    root = xml.fromstring(text)
    keys = {k.get("id") for k in root.findall("g:key", ns)}
    used = {d.get("key") for d in root.iter(f"{{{ns['g']}}}data")}
    assert used == {"n_depth", "n_doi", "n_title", "n_publication_year", "e_depth", "e_source_api", "e_citation_date"} < keys and len(keys) == 11
    assert tuple(sinks.read_manifest(spark, f"file://{tmp_path}/g").first()) == (7, 5)


def test_streamed_edges_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(9)}", f"t{rng.randrange(9)}", rng.randrange(1, 4), rng.choice("ab"), i) for i in range(200)]
    schema = "source_id string, target_id string, depth int, source_api string, seq long"
    df = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in graph.merge_edges(df).collect()}
    for parts, files in ((1, 1), (5, 2)):
        base = f"file://{tmp_path}/{parts}"
        df.repartition(parts, "seq").write.parquet(f"{base}/inbox")
        assert {tuple(r) for r in merge.ingest(spark, f"{base}/inbox", base, schema, files).collect()} == want
        assert {tuple(r) for r in merge.ingest(spark, f"{base}/inbox", base, schema, files).collect()} == want
        store = merge.store(spark, base, schema)
        kept = {str(p.relative_to(tmp_path / str(parts) / "store")) for p in (tmp_path / str(parts) / "store/edges").glob("*/_bucket=*")}
        assert kept == {r["path"] for n in store.states() for r in store.state(n).runs["edges"]}  # what a retry needs, not every batch


def test_streamed_failures(spark, tmp_path):
    """Whatever the batches, a parent is failed if the last that is known of it is a failure."""
    schema = "source_id string, target_id string, depth int, source_api string, seq long, error string"
    rows = [("a", "p", 1, "x", 5, None), (None, "p", None, None, 3, "early"), (None, "q", None, None, 8, "late"), ("b", "q", 1, "x", 2, None), (None, "r", None, None, 1, "only"), (None, "r", None, None, 4, "again")]
    for parts, files in ((1, 1), (6, 1)):
        base = f"file://{tmp_path}/f{parts}"
        spark.createDataFrame(rows, schema).repartition(parts, "seq").write.parquet(f"{base}/inbox")
        assert {r.target_id for r in merge.ingest(spark, f"{base}/inbox", base, schema, files).collect()} == {"p", "q"}
        assert {tuple(r) for r in merge.failures(spark, base, schema).collect()} == {("q", "late"), ("r", "again")}
