"""Every query of the library over the derived graph, by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrace import catalog_sql
from citetrace.functions import identifiers as ids
from citetrace.operators import control, crawl, graph, metadata, metrics, quality, reach, seeds, stats, titles
from citetrace.plans.fixture import Fixture, fixture
from citetrace.plans.storage import folder
from citetrace.sources import dumps, readers, sinks
from citetrace.streaming import merge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL = catalog_sql.SQL


def query(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(fixture(spark, sf_dir))
    return f


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- scalar functions -------------------------------------------------------------------------------------


def doi_texts(x: Fixture) -> DataFrame:
    bare = F.concat(F.lit("10."), (1000 + F.col("p_partkey") % 9000).cast("string"), F.lit("/"), F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))
    kind = F.col("p_partkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("https://doi.org/"), bare))
        .when(kind == 1, F.concat(F.lit("doi: "), bare))
        .when(kind == 2, F.concat(bare, F.lit(".")))
        .when(kind == 3, F.concat(F.lit("see http://dx.doi.org/"), bare, F.lit(" for details")))
        .otherwise("Unavailable")
    )
    return x.table("part").select(F.col("p_partkey").alias("id"), text.alias("text"))


def date_texts(x: Fixture) -> DataFrame:
    day, kind = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.month(day).cast("string"), F.lit("/"), F.day(day).cast("string"), F.lit("/"), F.year(day).cast("string"), F.lit(" 0:00")))
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(day, "yyyy/MM/dd"))
        .when(kind == 3, F.date_format(day, "yyyy-MM"))
        .otherwise(F.date_format(day, "yyyy"))
    )
    return x.table("orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


def pid_texts(x: Fixture) -> DataFrame:
    text = F.concat(F.lit("omid:br/"), F.col("o_orderkey"), F.lit(" DOI:10.1000/W"), F.col("o_orderkey"), F.lit(" pmid:"), F.col("o_orderkey") + 5000)
    return x.table("orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


def notice_rows(x: Fixture) -> DataFrame:
    """Notice rows as a file would hold them: all text, from orders and customers."""
    o, c = x.table("orders"), x.table("customer")
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    kind = F.when(key % 200 == 0, "Retraction").when(key % 200 == 50, "Expression of Concern").when(key % 200 == 100, "Correction; Retraction").otherwise("Correction")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.concat(F.lit(" R"), key).alias("Record ID"),
        F.concat(F.lit("Order "), key, F.lit(" ")).alias("Title"),
        kind.alias("RetractionNature"),
        F.concat(F.month(day), F.lit("/"), F.day(day), F.lit("/"), F.year(day), F.lit(" 0:00")).alias("RetractionDate"),
        F.date_format(day, "yyyy-MM-dd").alias("OriginalPaperDate"),
        F.when(key % 150 == 0, "Unavailable").otherwise(F.concat(F.lit("https://doi.org/10.1000/W"), (key % 1000).cast("string"))).alias("OriginalPaperDOI"),
        F.when(key % 250 == 0, "0").otherwise(F.concat(F.lit("PMID: "), key)).alias("OriginalPaperPubMedID"),
        F.concat(F.col("c_name"), F.lit("; Other")).alias("Author"),
    )


@query
def text_or_none(x):
    text = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" \t"), "p_name", F.lit(" \n")))
    return x.table("part").select(F.col("p_partkey").alias("id"), ids.as_text(text).alias("value"))


@query
def clean_doi(x):
    return doi_texts(x).select("id", ids.doi(F.col("text")).alias("doi"))


@query
def doi_url(x):
    return doi_texts(x).select("id", ids.doi_url(F.col("text")).alias("url"))


@query
def clean_pmid(x):
    text = F.when(F.col("c_custkey") % 4 == 0, "0").when(F.col("c_custkey") % 4 == 1, "n/a").otherwise(F.concat(F.lit("PMID: "), F.col("c_custkey"), F.lit(" (v2)")))
    return x.table("customer").select(F.col("c_custkey").alias("id"), ids.pmid(text).alias("pmid"))


@query
def parse_date(x):
    return date_texts(x).select("id", ids.parse_date(F.col("text")).alias("day"))


@query
def parse_year(x):
    return date_texts(x).select("id", ids.parse_year(F.col("text")).cast("long").alias("year"))


@query
def compact_id(x):
    url = F.concat(F.lit("https://openalex.org/W"), "o_orderkey")
    return x.table("orders").select(F.col("o_orderkey").alias("id"), ids.compact_id(url).alias("compact"), ids.full_id(F.concat(F.lit("W"), "o_orderkey")).alias("full_id"))


@query
def node_ids(x):
    d = ids.doi_node(F.col("text"))
    return doi_texts(x).select("id", d.alias("doi_node"), ids.pmid_node(F.col("id").cast("string")).alias("pmid_node"), ids.node_doi(d).alias("doi_back"))


@query
def extract_pid(x):
    return pid_texts(x).select("id", ids.pid(F.col("text"), "doi").alias("doi"), ids.pid(F.col("text"), "pmid").alias("pmid"), ids.pid(F.col("text"), "pmcid").alias("pmcid"))


@query
def author_last_name(x):
    text = F.when(F.col("c_custkey") % 7 == 0, "  ;  ").otherwise(F.concat(F.lit("Jane Q. "), "c_name", F.lit("; Jones")))
    return x.table("customer").select(F.col("c_custkey").alias("id"), ids.author_last_name(text).alias("last_name"))


@query
def notice_filter(x):
    rows = notice_rows(x)
    return rows.select(ids.as_text(F.col("`Record ID`")).alias("record_id"), ids.is_notice(F.col("RetractionNature")).alias("is_seed"))


@query
def xml_escape(x):
    return x.table("pages").select("page_id", F.sha2(ids.xml_text(F.col("html")), 256).alias("escaped_sha256"), F.length(ids.xml_text(F.col("html"))).cast("long").alias("n_chars"))


@query
def snapshot_label(x):
    name = F.concat(F.lit("rw_"), F.date_format(F.col("o_orderdate"), "yyyyMMdd"), F.lit("T000000Z.csv"))
    return x.table("orders").select(F.col("o_orderkey").alias("id"), ids.snapshot_label(name).alias("label"))


@query
def group_fingerprint(x):
    return sinks.group_fingerprint(x.edges, "target_id", "source_id")


@query
def batch_ids(x):
    return sinks.id_batches(x.frontier.where("depth = 1"), "node_id", 100)


# --- sources and sinks ------------------------------------------------------------------------------------


@query
def io_notice_csv(x):
    rows = notice_rows(x)
    path = folder(x.spark, "notices")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = readers.notice_csv(x.spark, path)
    return back.select(F.col("`Record ID`").alias("record_id"), F.col("Title").alias("title"), "RetractionNature", "RetractionDate", "OriginalPaperDOI", "Author")


@query
def io_parquet_roundtrip(x):
    return sinks.through(x.frontier.select("node_id", "depth"), "parquet")


@query
def io_csv_roundtrip(x):
    return sinks.through(x.works.select("node_id", "publication_date", "publication_year", "topic_name"), "csv")


@query
def normalize_work(x):
    """Nested documents made of orders, each referring to the orders that its citations name."""
    refs = x.raw_citations.groupBy(F.col("source_id").alias("node_id")).agg(F.sort_array(F.collect_set("target_id")).alias("refs"))
    w = x.base_works.join(refs, "node_id", "left")
    url = lambda c: F.concat(F.lit("https://openalex.org/"), c)
    doc = F.struct(
        url(F.col("node_id")).alias("id"), F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.col("title"), F.col("publication_date").cast("string").alias("publication_date"),
        "publication_year", F.col("work_type").alias("type_crossref"), F.transform("refs", url).alias("referenced_works"),
        F.struct(F.col("topic_name").alias("display_name"), F.struct(F.col("topic_domain").alias("display_name")).alias("domain")).alias("primary_topic"),
    )
    out = readers.works_from_json(w.select(F.to_json(doc).alias("json")))
    return out.select("node_id", "doi", "title", "publication_date", "publication_year", "work_type", "topic_name", "topic_domain", F.coalesce(F.size("referenced_works"), F.lit(0)).cast("long").alias("n_refs"))


@query
def parse_citations(x):
    text = lambda k: F.concat(F.lit("omid:x doi:10.1000/"), F.col(k), F.lit(" pmid:"), F.substring(k, 2, 20))
    rows = x.raw_citations
    out = readers.citations_from_pids(rows, text("source_id"), text("target_id"), F.date_format("citation_date", "yyyy-MM"))
    return out.groupBy("citing_doi", "citing_pmid", "cited_doi", "creation_date").agg(F.count("*").alias("n"))


@query
def row_to_json(x):
    return sinks.row_json(x.frontier.select("node_id", "depth"))


@query
def bulk_id_mapping(x):
    pairs = x.raw_citations.select(F.substring("source_id", 2, 20).cast("long").alias("citing"), F.substring("target_id", 2, 20).cast("long").alias("cited"))
    mapping = x.table("orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("index_id"), F.concat(F.lit("doi:10.1000/w"), "o_orderkey").alias("node_id"))
    return readers.map_ids(pairs, mapping)


@query
def graphml_lines(x):
    nodes = graph.induced_nodes(x.frontier, x.works, 2)
    return sinks.graphml(nodes, graph.induced_edges(x.edges, x.frontier, 2)).select("section", "line")


@query
def graph_manifest(x):
    nodes, edges = graph.induced_nodes(x.frontier, x.works, 2), graph.induced_edges(x.edges, x.frontier, 2)
    return sinks.manifest(nodes, edges, written_graph(x, nodes, edges))


def written_graph(x: Fixture, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The manifest of the graph once it is written."""
    path = folder(x.spark, "graph")
    sinks.write_graphml(nodes, edges, path)
    return sinks.read_manifest(x.spark, path)


@query
def io_export_tables(x):
    """Tables exported and read again, as counts of rows and columns."""
    base = folder(x.spark, "export")
    tables = {"seeds": x.seed_rows, "works": x.works, "frontier_nodes": x.frontier, "citation_edges": x.edges, "run_metadata": run_metadata(x)}
    sinks.export(tables, base)
    counts = [x.spark.read.parquet(f"{base}/{name}").agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name in tables]
    return reduce(DataFrame.unionByName, counts)


@query
def io_result_csv(x):
    """A result table written as CSV and read with its schema; one that does not exist has no rows."""
    path = folder(x.spark, "result")
    schema = "depth int, topic_domain string, topic_name string, node_count long"
    metrics.topic_distribution(graph.induced_nodes(x.frontier, x.works, 2)).write.option("header", True).csv(path)
    return readers.result_csv(x.spark, path, schema).unionByName(readers.result_csv(x.spark, f"{path}-none", schema))


# --- seeds ------------------------------------------------------------------------------------------------

SEED = ("record_id", "title", "notice_type", "notice_date", "original_paper_date", "original_doi", "original_pmid", "author")


@query
def seed_load(x):
    return seeds.from_notices(notice_rows(x)).select(*SEED)


@query
def seed_partition(x):
    return seeds.partition_by_doi(seeds.from_notices(notice_rows(x))).select("record_id", "original_doi", "seed_class")


@query
def seed_prepare(x):
    return seeds.prepare(seeds.from_notices(notice_rows(x))).select("record_id", "node_id", "resolved_status")


@query
def seed_prepare_stats(x):
    return seeds.prepare(seeds.from_notices(notice_rows(x))).groupBy("resolved_status").agg(F.count("*").alias("n"))


@query
def seed_mark_duplicates(x):
    return x.seed_rows.select("record_id", "node_id", "notice_date", "resolved_status")


@query
def canonical_seeds(x):
    return x.canonical


@query
def seed_duplicate_counts(x):
    return seeds.duplicate_counts(x.seed_rows)


def cascade(x: Fixture) -> tuple[DataFrame, DataFrame]:
    w = x.table("orders").select(
        F.concat(F.lit("W"), "o_orderkey").alias("node_id"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("10.1000/w"), (F.col("o_orderkey") % 1000).cast("string"))).alias("doi"),
        F.when(F.col("o_orderkey") % 6 == 0, F.col("o_orderkey").cast("string")).alias("pmid"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("ORDER "), "o_orderkey")).alias("title"),
        F.array(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("authors"),
        F.lit(None).cast("int").alias("rank"),
    )
    return seeds.from_notices(notice_rows(x)), w


@query
def resolve_cascade(x):
    return seeds.resolve(*cascade(x)).select("record_id", "resolved_node", "resolved_by", "status")


@query
def resolve_exact_only(x):
    return seeds.resolve(*cascade(x), title_fallback=False).select("record_id", "resolved_node", "resolved_by", "status")


@query
def resolve_stats(x):
    return seeds.resolve_stats(seeds.resolve(*cascade(x)))


@query
def resolve_title_author(x):
    return seeds.resolve_title_author(*cascade(x))


@query
def title_search(x):
    """The five best works for each seed's title; all titles share a common word."""
    return titles.search(*cascade(x))


@query
def resolve_ranked_titles(x):
    return titles.resolve(*cascade(x))


@query
def unresolved_seeds(x):
    rows = seeds.from_notices(notice_rows(x)).withColumn("node_id", F.when(F.col("original_doi").isNotNull(), ids.doi_node(F.col("original_doi"))))
    return seeds.unresolved(rows.withColumn("resolved_status", F.lit(None).cast("string"))).select("record_id")


@query
def resolved_seed_ids(x):
    return x.seed_rows.where("resolved_status = 'resolved' and node_id is not null").select("node_id").distinct()


@query
def resolved_seeds_with_doi(x):
    return x.seed_rows.where("resolved_status = 'resolved' and original_doi is not null").select("record_id", "node_id", "original_doi")


@query
def merge_last_wins(x):
    rows = x.raw_citations.select(F.col("source_id").alias("node_id"), F.when(F.col("seq") % 7 != 0, F.col("source_api")).alias("source_api"), "citation_date", "seq")
    return seeds.last_wins(rows, ["node_id"], ("seq", "citation_date"))


@query
def metadata_kv(x):
    """The first half of the events is put, the second half replaces it, keys that end in 0 are deleted, all are asked."""
    rows = x.table("events").select(F.concat(F.lit("user."), "user_id").alias("key"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("value"), F.col("event_id").alias("seq"))
    first = metadata.put(rows.select("key", "value").limit(0), rows.where("seq % 2 = 0"))
    both = metadata.delete(metadata.put(first, rows.where("seq % 2 = 1")), rows.where("key like '%0'"))
    return metadata.get(both, rows, "default")


@query
def source_provenance(x):
    run = x.table("orders").agg(F.max("o_orderdate").alias("last"))
    path = F.concat(F.lit("/in/rw_"), F.date_format("last", "yyyyMMdd'T'HHmmss'Z'"), F.lit(".csv"))
    return metadata.provenance(run, path, "opencitations", F.col("last").cast("date"))


@query
def propagate_retracted(x):
    return x.works.select("node_id", "is_retracted")


# --- graph ------------------------------------------------------------------------------------------------


def observed(x: Fixture) -> DataFrame:
    """Every citation twice, the second time deeper or shallower and from the other source."""
    r = x.raw_citations
    a = r.withColumn("depth", (F.col("seq") % 3 + 1).cast("int"))
    other = F.when(F.col("source_api") == "openalex", "opencitations").otherwise("openalex")
    b = r.withColumn("depth", (F.col("seq") % 2 + 1).cast("int")).withColumn("source_api", other).withColumn("seq", F.col("seq") + 10_000_000_000_000_000)
    return a.unionByName(b)


@query
def frontier_min_depth(x):
    o = observed(x)
    return graph.least_depth(o.select(F.col("source_id").alias("node_id"), "depth"))


@query
def edge_min_depth_merge(x):
    return graph.merge_edges(observed(x)).select("source_id", "target_id", "depth", "source_api", "citation_date")


@query
def bfs_frontier(x):
    return x.frontier.select("node_id", "depth")


@query
def bfs_edges(x):
    return x.edges.select("source_id", "target_id", "depth", "source_api", "citation_date")


@query
def bfs_level_stats(x):
    number = "cast(substring(node_id, 2, 20) as long)"
    return graph.level_stats(x.raw_citations, x.frontier, 1, failed=x.frontier.where(f"{number} % 13 = 0"), expandable=f"{number} % 11 <> 0")


@query
def bfs_capped(x):
    return graph.capped_level(x.raw_citations, x.frontier, 1, 500)


def parsed_citations(x: Fixture) -> DataFrame:
    return x.raw_citations.select(
        F.concat(F.lit("10.1000/"), "source_id").alias("citing_doi"), F.lit(None).cast("string").alias("citing_pmid"), F.concat(F.lit("10.1000/"), "target_id").alias("cited_doi"),
        F.when(F.col("seq") % 5 == 0, F.lit("doi:10.1000/parent")).otherwise(F.concat(F.lit("doi:10.1000/"), F.lower("target_id"))).alias("parent_id"), F.col("citation_date").alias("creation_date"),
    )


@query
def citation_edges_build(x):
    return graph.citation_edges(parsed_citations(x), 1)


@query
def citation_nodes_build(x):
    seed = x.canonical.select(F.concat(F.lit("doi:10.1000/"), F.lower("node_id")).alias("node_id"))
    return graph.citation_nodes(parsed_citations(x), seed, 1)


@query
def edges_from_refs(x):
    w = x.raw_citations.groupBy(F.col("source_id").alias("node_id")).agg(F.collect_list("target_id").alias("referenced_works"))
    return graph.reference_edges(w, x.frontier.where("depth <= 1"))


def two_sources(x: Fixture) -> tuple[DataFrame, DataFrame]:
    o = observed(x)
    return o.where("source_api = 'opencitations'"), o.where("source_api = 'openalex'")


@query
def hybrid_graph(x):
    return graph.hybrid(*two_sources(x)).select("source_id", "target_id", "depth", "source_api")


def referring_works(x: Fixture) -> DataFrame:
    """Works of the second source with the works that they refer to."""
    rows = x.raw_citations.where("source_api = 'openalex'")
    return rows.groupBy(F.col("source_id").alias("node_id")).agg(F.collect_set("target_id").alias("referenced_works"))


@query
def hybrid_crawl(x):
    """Both sources level by level: nodes with their depth, and edges with theirs."""
    first = x.raw_citations.where("source_api = 'opencitations'")
    nodes, edges = graph.hybrid_crawl(first, referring_works(x), x.canonical, 2)
    return nodes.select(F.col("node_id").alias("source_id"), F.lit(None).cast("string").alias("target_id"), "depth", F.lit("node").alias("source_api")).unionByName(
        edges.select("source_id", "target_id", "depth", "source_api")
    )


@query
def page_store(x):
    nodes, edges = graph.page_store(referring_works(x), x.frontier.where("depth = 0"), 1)
    hits = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("n_edges"))
    return nodes.join(hits, "node_id", "left").na.fill(0, ["n_edges"])


@query
def pending_frontier(x):
    """The first level once those that anything cites are processed."""
    waiting = x.frontier.withColumn("processed", F.lit(False))
    return graph.pending(graph.mark_processed(waiting, x.raw_citations.select(F.col("target_id").alias("node_id"))), 1)


@query
def graph_build(x):
    return graph.build(graph.induced_nodes(x.frontier, x.works, 2), graph.induced_edges(x.edges, x.frontier, 2))


@query
def resolve_citers(x):
    c = x.raw_citations.select(
        F.when(F.col("seq") % 3 != 0, F.concat(F.lit("10.1000/"), F.lower("source_id"))).alias("citing_doi"), F.substring("source_id", 2, 20).alias("citing_pmid"), "seq"
    )
    w = x.base_works.where("publication_year is not null").select("node_id", "doi", F.substring("node_id", 2, 20).alias("pmid"))
    return graph.resolve_citers(c, w).select("seq", "node_id")


@query
def frontier_with_doi(x):
    w = x.base_works.select("node_id", F.when(F.col("publication_year").isNotNull(), F.col("doi")).alias("doi"))
    return graph.frontier_with_doi(x.frontier, w, x.seed_rows, 0)


@query
def frontier_status(x):
    return metrics.frontier_status(x.frontier)


@query
def induced_edges(x):
    return graph.induced_edges(x.scoped_edges, x.frontier, 1).select("source_id", "target_id", "depth")


@query
def induced_nodes(x):
    return graph.induced_nodes(x.frontier, x.works, 1).select("node_id", "depth", "title", "publication_date", "topic_name", "is_retracted")


@query
def edge_scope(x):
    return graph.edge_scope(x.scoped_edges, x.frontier, 2)


@query
def weak_components(x):
    return metrics.weak_component_count(x.frontier, graph.induced_edges(x.edges, x.frontier, 2))


@query
def reconcile_counts(x):
    expected = x.frontier.where("depth = 1").select("node_id", (F.substring("node_id", 2, 20).cast("long") % 20).alias("expected"))
    return graph.reconcile(x.edges, expected)


def expected_counts(x: Fixture) -> DataFrame:
    return x.frontier.where("depth = 1").select("node_id", (F.substring("node_id", 2, 20).cast("long") % 20).alias("expected"))


@query
def terminal_parents(x):
    return graph.terminal(x.frontier, x.raw_citations, 2)


@query
def stale_edges(x):
    return graph.stale(x.raw_citations, x.frontier)


@query
def ego_sample(x):
    return metrics.ego_sample(measured(x), x.edges)


# --- metrics ----------------------------------------------------------------------------------------------


def measured(x: Fixture) -> DataFrame:
    return x.measured


@query
def seed_metrics(x):
    return measured(x)


@query
def seed_pairs(x):
    return metrics.seed_pairs(x.canonical, x.edges, x.frontier)


@query
def bridge_papers(x):
    return metrics.bridges(x.edges, x.frontier, x.works)


@query
def post_notice_timeline(x):
    return metrics.post_notice_timeline(x.canonical, x.edges, x.frontier, x.works)


@query
def event_study(x):
    return metrics.event_study(x.seed_rows, x.edges, x.works)


@query
def headline_stats(x):
    prepared = seeds.prepare(seeds.from_notices(notice_rows(x)))
    return rounded(metrics.headline(x.seed_rows, prepared, run_metadata(x), x.edges, x.frontier, x.works, (x.numbered_nodes, x.numbered_edges), measured(x), x.raw_citations, expected_counts(x)))


@query
def depth_counts(x):
    return metrics.depth_counts(x.frontier, 2)


@query
def edge_depths(x):
    every = x.numbered_edges.withColumn("source_api", F.lit("all"))
    return reach.edge_depths(x.numbered_edges, 2).unionByName(reach.edge_depths(every, 2))


@query
def topic_distribution(x):
    return metrics.topic_distribution(graph.induced_nodes(x.frontier, x.works, 2))


@query
def edges_by_api(x):
    return metrics.edges_by_api(graph.induced_edges(x.edges, x.frontier, 2))


@query
def summary_metrics(x):
    return metrics.summary(x.seed_rows, x.frontier, x.edges, x.scoped_edges, measured(x))


@query
def pubdate_coverage(x):
    return metrics.pubdate_coverage(graph.induced_nodes(x.frontier, x.works, 2))


@query
def unique_post_direct(x):
    return reach.unique_post(x.canonical, x.numbered_nodes, x.numbered_edges).where("hop = 1").select("n")


@query
def unique_post_depth2(x):
    return reach.unique_post(x.canonical, x.numbered_nodes, x.numbered_edges).where("hop = 2").select("n")


@query
def post_notice_totals(x):
    return metrics.post_notice_totals(measured(x))


@query
def duplicate_groups(x):
    return quality.duplicate_groups(x.seed_rows)


@query
def top_seeds(x):
    return metrics.top(measured(x), 10, "total_depth2_reach").select("node_id", "total_depth2_reach")


@query
def top_bridges(x):
    return metrics.top(metrics.bridges(x.edges, x.frontier, x.works), 15, "cited_seeds", "depth2_citers")


@query
def top_labels(x):
    return metrics.labels(measured(x), 10, "total_depth2_reach").select("label", "total_depth2_reach")


@query
def top_seeds_long(x):
    ten = metrics.top(measured(x), 10, "total_depth2_reach")
    return ten.unpivot(["node_id"], ["direct_citers", "depth2_descendants"], "hop", "n")


@query
def edge_counts_by_depth(x):
    return metrics.edge_depths(x.edges, 2).groupBy("depth").agg(F.sum("edge_count").alias("edge_count"))


# --- statistics -------------------------------------------------------------------------------------------


@query
def reach_quantiles(x):
    return rounded(stats.quantiles(measured(x), "total_depth2_reach"))


@query
def reach_gini(x):
    return rounded(stats.gini(measured(x), "total_depth2_reach"))


@query
def reach_ccdf(x):
    return rounded(stats.ccdf(measured(x), "total_depth2_reach"))


@query
def reach_lorenz(x):
    return rounded(stats.lorenz(measured(x), "total_depth2_reach"))


@query
def reach_histogram(x):
    return stats.histogram(measured(x), F.log10(F.col("total_depth2_reach") + 1), 60)


@query
def diff_histogram(x):
    return stats.histogram(paired(x), F.round("share_diff", 9), 40)


@query
def event_share(x):
    return rounded(stats.share_within(metrics.event_study(x.seed_rows, x.edges, x.works), "period"))


@query
def density_bins(x):
    return stats.density_bins(graph.induced_edges(x.edges, x.frontier, 2), x.frontier)


# --- controls ---------------------------------------------------------------------------------------------


def matched(x: Fixture) -> DataFrame:
    return control.match(control.seed_frame(x.seed_rows, x.edges, x.works), control.pool(x.edges, x.frontier, x.works))


def paired(x: Fixture) -> DataFrame:
    return x.paired


@query
def control_seed_frame(x):
    return rounded(control.seed_frame(x.seed_rows, x.edges, x.works))


@query
def control_pool(x):
    return rounded(control.pool(x.edges, x.frontier, x.works))


@query
def control_match(x):
    return rounded(matched(x).select("node_id", "year", "indeg", "control_id", "distance"))


@query
def control_pairs(x):
    return rounded(paired(x).select("node_id", "control_id", "control_indeg", "control_post_in", "seed_share", "control_share", "share_diff"))


@query
def control_summary(x):
    return rounded(control.summary(paired(x)))


@query
def control_match_jitter(x):
    """As ``control_match`` with every seed's log in-degree raised by a tenth."""
    found = control.match(control.seed_frame(x.seed_rows, x.edges, x.works), control.pool(x.edges, x.frontier, x.works), jitter=0.1)
    return rounded(found.select("node_id", "year", "indeg", "control_id", "distance"))


@query
def wilcoxon_signed_rank(x):
    return rounded(stats.wilcoxon(paired(x).withColumn("share_diff", F.round("share_diff", 9)), "share_diff").select("v", "n", "z", "p"))


@query
def wilcoxon_by_nation(x):
    """Balances of suppliers against 4500, nation by nation: small samples, of which the test is exact where no two sizes are equal."""
    s = x.table("supplier").select("s_nationkey", F.round(F.col("s_acctbal") - 4500, 2).alias("d"))
    return rounded(stats.wilcoxon_by(s, ["s_nationkey"], "d").select("s_nationkey", "v", "n", "p"))


@query
def price_quantiles(x):
    """Quantiles over many distinct values, by selection."""
    return rounded(stats.quantiles(x.table("lineitem"), "l_extendedprice"))


@query
def control_event_overlay(x):
    return rounded(control.event_overlay(paired(x), x.edges, x.works))


# --- checks -----------------------------------------------------------------------------------------------


def run_metadata(x: Fixture) -> DataFrame:
    """Keys and values as a run would have them, from the regions and orders; two of the required keys are missing."""
    r = x.table("orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("a"), F.count("*").cast("string").alias("b"))
    rows = F.array(
        *[F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in (("rw_snapshot_date", "a"), ("oc_access_date", "a"), ("pipeline_mode", "b"), ("opencitations_seed_stats", "b"), ("opencitations_failed_parent:W1", "b"))]
    )
    return r.select(F.explode(rows).alias("x")).select("x.*")


@query
def metadata_check(x):
    """Required keys that are missing where each kind of event has put one, chosen by how often it happened; keys repeat, and a value may be null."""
    n = F.col("n")
    keys = F.array(*map(F.lit, quality.REQUIRED))
    rows = x.table("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return quality.missing_metadata(x.spark, rows.select(F.get(keys, (n % len(quality.REQUIRED)).cast("int")).alias("key"), F.when(n % 2 == 0, n.cast("string")).alias("value")))


@query
def quality_report(x):
    """The checks over what a run has written: result tables, the graph and its manifest."""
    base = folder(x.spark, "outputs")
    tables = {"topic_distribution": metrics.topic_distribution(graph.induced_nodes(x.frontier, x.works, 2)), "bridge_papers": metrics.bridges(x.edges, x.frontier, x.works)}
    sinks.export(tables, base)
    outputs = {name: f"{base}/{name}" for name in tables}
    nodes, edges = graph.induced_nodes(x.frontier, x.works, 2), graph.induced_edges(x.edges, x.frontier, 2)
    return quality.report(
        quality.required_metadata(x.spark, run_metadata(x)),
        quality.duplicate_canonical(x.canonical, x.seed_rows),
        quality.stored_vs_exported(x.scoped_edges, x.frontier, 2),
        quality.frontier_processed(x.frontier, 2),
        quality.failed_parents(run_metadata(x)),
        quality.any_label(x.spark.read.parquet(outputs["topic_distribution"]), ["topic_name", "topic_domain"], "topic_labels_present"),
        quality.any_label(x.spark.read.parquet(outputs["bridge_papers"]), ["title"], "bridge_titles_present"),
        quality.manifest_matches(sinks.manifest(nodes, edges, written_graph(x, nodes, edges))),
        quality.outputs_exist(x.spark, outputs | {"missing_table": f"{base}/missing_table"}),
    )


@query
def analysis_summary(x):
    """The summary that one call of the whole analysis writes over a folder of tables."""
    return x.spark.read.parquet(x.analysed(run_metadata(x))["summary"])


@query
def analysis_checks(x):
    """The checks of that call."""
    return x.spark.read.parquet(x.analysed(run_metadata(x))["checks"])


@query
def analysis_control_summary(x):
    return rounded(x.spark.read.parquet(x.analysed(run_metadata(x))["control_summary"]))


# --- streaming --------------------------------------------------------------------------------------------


STREAMED = "source_id string, target_id string, depth int, source_api string, citation_date date, seq long, error string"


def failed_observations(x: Fixture) -> DataFrame:
    """Of every seventh parent a failure: before all else that is known of it, or (every other one) after."""
    parents = x.raw_citations.select("target_id").distinct().withColumn("k", F.substring("target_id", 2, 20).cast("long")).where("k % 7 = 0")
    blank = lambda kind: F.lit(None).cast(kind)
    seq = F.when(F.col("k") % 2 == 0, F.lit(0)).otherwise(F.lit(9_000_000_000_000_000_000)).cast("long")
    return parents.select(blank("string").alias("source_id"), "target_id", blank("int").alias("depth"), blank("string").alias("source_api"), blank("date").alias("citation_date"), seq.alias("seq"), F.concat(F.lit("no answer for "), "target_id").alias("error"))


@query
def streaming_edge_merge(x):
    """Observations written as files and taken in by a stream; the same edges as one merge."""
    return merge.store(x.spark, x.streamed(observed, failed_observations), STREAMED).read("edges").select("source_id", "target_id", "depth", "source_api", "citation_date")


@query
def streaming_failures(x):
    """Parents whose last known answer in that stream is a failure."""
    return merge.failures(x.spark, x.streamed(observed, failed_observations), STREAMED)


# --- stored state -----------------------------------------------------------------------------------------


@query
def crawl_resumed(x):
    """The nodes of a crawl over three batches of citations, stopped between two levels and taken up again."""
    return crawled(x).nodes().select("node_id", "depth", "processed")


@query
def crawl_edges(x):
    return crawled(x).edges().select("source_id", "target_id", "depth", "source_api", "citation_date")


@query
def crawl_expansions(x):
    """How many parents the crawl expanded after each batch: all up to the second, and then only those that the last batch made new or nearer."""
    log = crawled(x).log()
    taken = log.where("kind = 'citations'").agg(F.max("step").alias("_last"))
    phase = F.when(F.col("step") > F.col("_last"), "last batch").otherwise("before")
    return log.crossJoin(taken).where("kind = 'level'").groupBy(phase.alias("phase")).agg(F.sum("parents").alias("parents"))  # one row


def crawled(x: Fixture) -> crawl.Crawl:
    return x.crawled()


@query
def growing_components(x):
    """Components of the edges taken in three batches: each with its number of nodes."""
    return x.labelled.labels().groupBy("component").agg(F.count("*").alias("n"))


@query
def dump_citations(x):
    """Citations of the parents that a crawl asks for, from zipped CSV archives of all of them."""
    wanted = x.frontier.where("depth < 2").select(F.col("node_id").alias("cited"))
    return dumps.read(x.spark, x.dumped(), "citing string, cited string, creation string", wanted, "cited").select("citing", "cited", "creation")


@query
def stored_upserts(x):
    """A stored table of the last observation of each node, after three batches of upserts and one of deletions."""
    return x.upserted.read().select("node_id", "source_api", "citation_date", "seq")
