"""DuckDB SQL for the queries of the catalog. Shared tables are common table expressions, taken in as needed."""

from __future__ import annotations

import re

#: name: SQL. A later one may use earlier ones.
TABLES = {
    "seed_records": """
        SELECT 'R' || o_orderkey AS record_id, 'Retraction' AS notice_type, CAST(o_orderdate AS DATE) + 180 AS notice_date, 'W' || o_orderkey AS node_id,
               'Order ' || o_orderkey AS title, '10.1000/w' || o_orderkey AS original_doi
        FROM orders WHERE o_orderkey % 200 = 0
        UNION ALL
        SELECT 'R' || o_orderkey || 'B', 'Expression of concern', CAST(o_orderdate AS DATE) + 120, 'W' || o_orderkey, 'Order ' || o_orderkey, '10.1000/w' || o_orderkey
        FROM orders WHERE o_orderkey % 1000 = 0""",
    "works": """
        SELECT 'W' || o_orderkey AS node_id, '10.1000/w' || o_orderkey AS doi, 'Order ' || o_orderkey AS title,
               CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS publication_date,
               CASE WHEN o_orderkey % 97 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS publication_year,
               o_orderstatus AS work_type, o_orderpriority AS topic_domain, c_mktsegment AS topic_name, c_name AS source_name, o_orderkey % 200 = 0 AS is_retracted
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "lagged": """
        SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_returnflag AS f, CAST(l_shipdate AS DATE) AS d,
               lag(l_orderkey, 1) OVER item AS one, lag(l_orderkey, 2) OVER item AS two
        FROM lineitem WINDOW item AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)""",
    "raw": """
        SELECT 'W' || k AS source_id, 'W' || one AS target_id, CASE WHEN f = 'R' THEN 'opencitations' ELSE 'openalex' END AS source_api, d AS citation_date, (k * 1000 + n * 10) * 1000000 + p AS seq
        FROM lagged WHERE one <> k
        UNION ALL
        SELECT 'W' || k, 'W' || two, CASE WHEN f = 'R' THEN 'opencitations' ELSE 'openalex' END, d, (k * 1000 + n * 10 + 1) * 1000000 + p FROM lagged WHERE two <> k""",
    "seed_rows": """
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY node_id ORDER BY notice_date NULLS LAST, record_id) = 1 THEN 'resolved' ELSE 'duplicate_node' END AS resolved_status
        FROM seed_records""",
    "canonical": """
        SELECT node_id, arg_min(record_id, (notice_date, record_id)) AS record_id, count(DISTINCT record_id) AS seed_record_count,
               string_agg(record_id, ';' ORDER BY notice_date, record_id) AS seed_record_ids, string_agg(notice_type, '; ' ORDER BY notice_date, record_id) AS notice_type,
               min(notice_date) AS notice_date, min(title) AS title
        FROM seed_rows GROUP BY node_id""",
    "d0": "SELECT DISTINCT node_id FROM seed_records",
    "d1": "SELECT DISTINCT source_id AS node_id FROM raw WHERE target_id IN (SELECT node_id FROM d0) AND source_id NOT IN (SELECT node_id FROM d0)",
    "d2": """SELECT DISTINCT source_id AS node_id FROM raw WHERE target_id IN (SELECT node_id FROM d1)
        AND source_id NOT IN (SELECT node_id FROM d0) AND source_id NOT IN (SELECT node_id FROM d1)""",
    "frontier": "SELECT node_id, 0 AS depth FROM d0 UNION ALL SELECT node_id, 1 FROM d1 UNION ALL SELECT node_id, 2 FROM d2",
    "scoped": """
        SELECT source_id, target_id, depth + 1 AS depth, arg_min(source_api, seq) AS source_api, arg_min(citation_date, seq) AS citation_date
        FROM raw JOIN frontier ON node_id = target_id GROUP BY ALL""",
    "edges": "SELECT * FROM scoped WHERE depth <= 2",
    "inside": "SELECT e.* FROM edges e WHERE source_id IN (SELECT node_id FROM frontier) AND target_id IN (SELECT node_id FROM frontier)",
    "nodes": "SELECT f.depth, w.* FROM frontier f JOIN works w USING (node_id)",
    "observed": """
        SELECT source_id, target_id, CAST(seq % 3 + 1 AS INTEGER) AS depth, source_api, citation_date, seq FROM raw
        UNION ALL
        SELECT source_id, target_id, CAST(seq % 2 + 1 AS INTEGER), CASE WHEN source_api = 'openalex' THEN 'opencitations' ELSE 'openalex' END, citation_date, seq + 10000000000000000 FROM raw""",
    "merged": """
        SELECT source_id, target_id, min(depth) AS depth, arg_min(source_api, (depth, seq)) AS source_api, arg_min(citation_date, (depth, seq)) AS citation_date
        FROM observed GROUP BY source_id, target_id""",
    "one_hop": """
        SELECT DISTINCT target_id AS seed, source_id FROM edges
        WHERE depth = 1 AND target_id IN (SELECT node_id FROM canonical) AND source_id IN (SELECT node_id FROM frontier)""",
    "two_hop": "SELECT DISTINCT seed, e.source_id FROM one_hop o JOIN edges e ON e.target_id = o.source_id AND e.depth = 2 WHERE e.source_id IN (SELECT node_id FROM d2)",
    "dated": """
        SELECT p.*, w.publication_year, coalesce(w.publication_date > c.notice_date, FALSE) AS post
        FROM (SELECT *, 1 AS hop FROM one_hop UNION ALL SELECT *, 2 FROM two_hop) p
        JOIN canonical c ON c.node_id = p.seed LEFT JOIN works w ON w.node_id = p.source_id""",
    "metrics": """
        SELECT c.*, count(DISTINCT source_id) FILTER (hop = 1) AS direct_citers, count(DISTINCT source_id) FILTER (hop = 2) AS depth2_descendants,
               count(DISTINCT source_id) AS total_depth2_reach, count(DISTINCT source_id) FILTER (hop = 1 AND post) AS post_notice_direct_citers,
               count(DISTINCT source_id) FILTER (hop = 2 AND post) AS post_notice_depth2_descendants
        FROM canonical c LEFT JOIN dated d ON d.seed = c.node_id GROUP BY ALL""",
    "bridge": """
        SELECT n.node_id, coalesce(a.n, 0) AS cited_seeds, coalesce(b.n, 0) AS depth2_citers, w.title
        FROM d1 n
        LEFT JOIN (SELECT source_id, count(DISTINCT target_id) AS n FROM edges WHERE depth = 1 GROUP BY 1) a ON a.source_id = n.node_id
        LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS n FROM edges WHERE depth = 2 AND source_id IN (SELECT node_id FROM d2) GROUP BY 1) b ON b.target_id = n.node_id
        LEFT JOIN works w ON w.node_id = n.node_id""",
    "events_by_year": """
        SELECT offset_year, count(*) AS n, CASE WHEN offset_year < 0 THEN 'before' WHEN offset_year = 0 THEN 'notice year' ELSE 'after' END AS period
        FROM (SELECT w.publication_year - CAST(year(c.notice_date) AS INTEGER) AS offset_year FROM edges e JOIN canonical c ON c.node_id = e.target_id
              JOIN works w ON w.node_id = e.source_id WHERE e.depth = 1 AND w.publication_year IS NOT NULL)
        WHERE offset_year BETWEEN -15 AND 15 GROUP BY offset_year""",
    "seed_frame": """
        SELECT c.node_id, c.notice_date, w.publication_year AS year, count(*) AS indeg, count(*) FILTER (cw.publication_date > c.notice_date) AS post_in,
               count(*) FILTER (cw.publication_date > c.notice_date) / count(*) AS seed_share, ln(1 + count(*)) AS logdeg
        FROM canonical c JOIN works w ON w.node_id = c.node_id JOIN edges e ON e.target_id = c.node_id AND e.depth = 1 JOIN works cw ON cw.node_id = e.source_id
        WHERE w.publication_year IS NOT NULL AND cw.publication_date IS NOT NULL GROUP BY 1, 2, 3""",
    "control_pool": """
        SELECT w.node_id, w.publication_year AS year, count(*) AS indeg, ln(1 + count(*)) AS logdeg
        FROM edges e JOIN works w ON w.node_id = e.target_id JOIN works cw ON cw.node_id = e.source_id
        WHERE e.depth = 2 AND e.target_id IN (SELECT node_id FROM d1) AND w.publication_year IS NOT NULL AND NOT w.is_retracted AND cw.publication_date IS NOT NULL
        GROUP BY 1, 2""",
    "numbered_pool": "SELECT *, row_number() OVER (PARTITION BY year ORDER BY indeg, node_id) AS i, count(*) OVER (PARTITION BY year) AS size FROM control_pool",
    "jittered": """
        SELECT s.*, s.logdeg + 0.1 AS t, greatest(1, least(p.size - 1, p.below)) AS lo, least(p.size, greatest(1, least(p.size - 1, p.below)) + 1) AS hi
        FROM seed_frame s JOIN LATERAL (
            SELECT count(*) FILTER (q.logdeg <= s.logdeg + 0.1) AS below, max(q.size) AS size FROM numbered_pool q WHERE q.year = s.year) p ON p.size > 0""",
    "placed": """
        SELECT s.*, greatest(1, least(p.size - 1, p.below)) AS lo, least(p.size, greatest(1, least(p.size - 1, p.below)) + 1) AS hi
        FROM seed_frame s JOIN LATERAL (
            SELECT count(*) FILTER (q.indeg <= s.indeg) AS below, max(q.size) AS size FROM numbered_pool q WHERE q.year = s.year) p ON p.size > 0""",
    "matched": """
        SELECT m.*, CASE WHEN abs(ln(1 + a.indeg) - m.logdeg) <= abs(ln(1 + b.indeg) - m.logdeg) THEN a.node_id ELSE b.node_id END AS control_id,
               least(abs(ln(1 + a.indeg) - m.logdeg), abs(ln(1 + b.indeg) - m.logdeg)) AS distance
        FROM placed m JOIN numbered_pool a ON a.year = m.year AND a.i = greatest(m.lo, 1) JOIN numbered_pool b ON b.year = m.year AND b.i = greatest(m.hi, 1)""",
    "paired": """
        SELECT m.node_id, m.notice_date, m.control_id, count(*) AS control_indeg, count(*) FILTER (w.publication_date > m.notice_date) AS control_post_in, m.seed_share,
               count(*) FILTER (w.publication_date > m.notice_date) / count(*) AS control_share,
               m.seed_share - count(*) FILTER (w.publication_date > m.notice_date) / count(*) AS share_diff
        FROM matched m JOIN edges e ON e.target_id = m.control_id AND e.depth = 2 JOIN works w ON w.node_id = e.source_id AND w.publication_date IS NOT NULL
        GROUP BY m.node_id, m.notice_date, m.control_id, m.seed_share""",
    "notices": """
        SELECT 'R' || o_orderkey AS record_id, 'Order ' || o_orderkey AS title,
               CASE o_orderkey % 200 WHEN 0 THEN 'Retraction' WHEN 50 THEN 'Expression of Concern' WHEN 100 THEN 'Correction; Retraction' ELSE 'Correction' END AS notice_type,
               CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 150 <> 0 THEN '10.1000/w' || (o_orderkey % 1000) END AS original_doi,
               CASE WHEN o_orderkey % 250 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS original_pmid, c_name || '; Other' AS author, o_orderkey AS k, o_custkey AS ck
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "loaded": "SELECT * FROM notices WHERE notice_type <> 'Correction'",
    "candidates": """
        SELECT s.*, x.n AS a, y.n AS b, z.n AS c FROM loaded s
        LEFT JOIN (SELECT '10.1000/w' || (o_orderkey % 1000) AS doi, min('W' || o_orderkey) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) x ON x.doi = s.original_doi
        LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS pmid, 'W' || o_orderkey AS n FROM orders WHERE o_orderkey % 6 = 0) y ON y.pmid = s.original_pmid
        LEFT JOIN (SELECT o_orderkey, 'W' || o_orderkey AS n FROM orders WHERE o_orderkey % 3 <> 0) z ON z.o_orderkey = s.k""",
    "classed": """
        SELECT *, CASE WHEN original_doi IS NULL THEN 'no_doi' WHEN row_number() OVER (PARTITION BY original_doi ORDER BY day, record_id) = 1 THEN 'canonical' ELSE 'duplicate' END AS seed_class
        FROM loaded""",
    "doi_texts": """
        SELECT p_partkey AS id, lower(CASE WHEN p_partkey % 5 < 4 THEN '10.' || (1000 + p_partkey % 9000) || '/' || replace(p_name, ' ', '-') END) AS doi FROM part""",
}

#: Two-sided p of z as the library's rational approximation gives it.
P_OF_Z = """least(1.0, t * exp(-x * x + (((((((((0.17087277 * t - 0.82215223) * t + 1.48851587) * t - 1.13520398) * t + 0.27886807) * t - 0.18628806) * t
    + 0.09678418) * t + 0.37409196) * t + 1.00002368) * t - 1.26551223)))"""

BODIES = {
    "text_or_none": "SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN p_name END AS value FROM part",
    "clean_doi": "SELECT id, doi FROM doi_texts",
    "doi_url": "SELECT id, 'https://doi.org/' || doi AS url FROM doi_texts",
    "clean_pmid": "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 >= 2 THEN CAST(c_custkey AS VARCHAR) END AS pmid FROM customer",
    "parse_date": """SELECT o_orderkey AS id, CAST(CASE o_orderkey % 5 WHEN 3 THEN date_trunc('month', o_orderdate) WHEN 4 THEN date_trunc('year', o_orderdate) ELSE o_orderdate END AS DATE) AS day FROM orders""",
    "parse_year": "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders",
    "compact_id": "SELECT o_orderkey AS id, 'W' || o_orderkey AS compact, 'https://openalex.org/W' || o_orderkey AS full_id FROM orders",
    "node_ids": "SELECT id, 'doi:' || doi AS doi_node, 'pmid:' || nullif(id, 0) AS pmid_node, doi AS doi_back FROM doi_texts",
    "extract_pid": "SELECT o_orderkey AS id, '10.1000/W' || o_orderkey AS doi, CAST(o_orderkey + 5000 AS VARCHAR) AS pmid, CAST(NULL AS VARCHAR) AS pmcid FROM orders",
    "author_last_name": "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN list_extract(string_split(c_name, ' '), -1) END AS last_name FROM customer",
    "notice_filter": "SELECT record_id, notice_type <> 'Correction' AS is_seed FROM notices",
    "xml_escape": """
        SELECT page_id, sha256(e) AS escaped_sha256, CAST(length(e) AS BIGINT) AS n_chars
        FROM (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS e FROM pages)""",
    "snapshot_label": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d') || 'T000000Z' AS label FROM orders",
    "group_fingerprint": """
        SELECT target_id, sha256(count(*) || ':' || sum(CAST('0x' || substr(sha256(source_id), 1, 15) AS BIGINT))) AS fingerprint FROM (SELECT DISTINCT source_id, target_id FROM edges) GROUP BY target_id""",
    "batch_ids": """
        SELECT batch, string_agg(node_id, ',' ORDER BY node_id) AS ids
        FROM (SELECT node_id, CAST(floor((row_number() OVER (ORDER BY node_id) - 1) / 100) AS BIGINT) AS batch FROM d1) GROUP BY 1""",
    "io_export_tables": """
        SELECT 'seeds' AS table_name, count(*) AS n FROM seed_rows UNION ALL SELECT 'works', count(*) FROM works UNION ALL SELECT 'frontier_nodes', count(*) FROM frontier
        UNION ALL SELECT 'citation_edges', count(*) FROM edges UNION ALL SELECT 'run_metadata', 5""",
    "io_result_csv": "SELECT depth, topic_domain, topic_name, count(*) AS node_count FROM nodes WHERE depth > 0 GROUP BY 1, 2, 3",
    "io_notice_csv": """
        SELECT record_id, title, notice_type AS "RetractionNature", month(day) || '/' || day(day) || '/' || year(day) || ' 0:00' AS "RetractionDate",
               CASE WHEN k % 150 = 0 THEN 'Unavailable' ELSE 'https://doi.org/10.1000/W' || (k % 1000) END AS "OriginalPaperDOI", author AS "Author" FROM notices""",
    "io_parquet_roundtrip": "SELECT node_id, depth FROM frontier",
    "io_csv_roundtrip": "SELECT node_id, publication_date, publication_year, topic_name FROM works",
    "normalize_work": """
        SELECT node_id, doi, title, publication_date, publication_year, work_type, topic_name, topic_domain, coalesce(n, 0) AS n_refs
        FROM works LEFT JOIN (SELECT source_id, count(DISTINCT target_id) AS n FROM raw GROUP BY 1) ON source_id = node_id""",
    "parse_citations": """
        SELECT '10.1000/' || lower(source_id) AS citing_doi, nullif(substr(source_id, 2), '0') AS citing_pmid, '10.1000/' || lower(target_id) AS cited_doi,
               CAST(date_trunc('month', citation_date) AS DATE) AS creation_date, count(*) AS n FROM raw GROUP BY ALL""",
    "row_to_json": "SELECT '{\"node_id\":\"' || node_id || '\",\"depth\":' || depth || '}' AS json FROM frontier",
    "bulk_id_mapping": """
        SELECT DISTINCT 'doi:10.1000/' || lower(source_id) AS source_id, 'doi:10.1000/' || lower(target_id) AS target_id FROM raw
        WHERE CAST(substr(source_id, 2) AS BIGINT) % 3 <> 0 AND CAST(substr(target_id, 2) AS BIGINT) % 3 <> 0""",
    "graphml_lines": """
        WITH a(i, owner, name, type) AS (VALUES (1, 'node', 'depth', 'int'), (2, 'node', 'doi', 'string'), (3, 'node', 'title', 'string'), (4, 'node', 'publication_year', 'int'), (5, 'node', 'work_type', 'string'),
            (6, 'node', 'source_name', 'string'), (7, 'node', 'topic_domain', 'string'), (8, 'node', 'topic_name', 'string'), (9, 'edge', 'depth', 'int'), (10, 'edge', 'source_api', 'string'), (11, 'edge', 'citation_date', 'string'))
        SELECT 1 AS section, unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph id="G" edgedefault="directed">']) AS line
        UNION ALL SELECT 1, '<key id="' || owner[1] || '_' || name || '" for="' || owner || '" attr.name="' || name || '" attr.type="' || type || '"/>' FROM a
        UNION ALL SELECT 4, unnest(['</graph>', '</graphml>'])
        UNION ALL
        SELECT 2, '<node id="' || node_id || '"><data key="n_depth">' || depth || '</data><data key="n_doi">' || doi || '</data><data key="n_title">' || title || '</data>'
               || coalesce('<data key="n_publication_year">' || publication_year || '</data>', '') || coalesce('<data key="n_work_type">' || work_type || '</data>', '')
               || coalesce('<data key="n_source_name">' || source_name || '</data>', '') || coalesce('<data key="n_topic_domain">' || topic_domain || '</data>', '')
               || coalesce('<data key="n_topic_name">' || topic_name || '</data>', '') || '</node>'
        FROM nodes
        UNION ALL
        SELECT 3, '<edge id="e' || row_number() OVER (ORDER BY source_id, target_id) || '" source="' || source_id || '" target="' || target_id || '"><data key="e_depth">' || depth
               || '</data><data key="e_source_api">' || source_api || '</data><data key="e_citation_date">' || citation_date || '</data></edge>' FROM inside""",
    "graph_manifest": """
        SELECT (SELECT count(*) FROM nodes) AS expected_nodes, (SELECT count(*) FROM inside) AS expected_edges, (SELECT count(*) FROM nodes) AS written_nodes, (SELECT count(*) FROM inside) AS written_edges""",
    "seed_load": "SELECT record_id, title, notice_type, day AS notice_date, day AS original_paper_date, original_doi, original_pmid, author FROM loaded",
    "seed_partition": "SELECT record_id, original_doi, seed_class FROM classed",
    "seed_prepare": """
        SELECT record_id, 'doi:' || original_doi AS node_id, CASE seed_class WHEN 'canonical' THEN 'resolved' WHEN 'duplicate' THEN 'duplicate_doi' ELSE 'no_doi' END AS resolved_status FROM classed""",
    "seed_prepare_stats": """
        SELECT CASE seed_class WHEN 'canonical' THEN 'resolved' WHEN 'duplicate' THEN 'duplicate_doi' ELSE 'no_doi' END AS resolved_status, count(*) AS n FROM classed GROUP BY 1""",
    "seed_mark_duplicates": "SELECT record_id, node_id, notice_date, resolved_status FROM seed_rows",
    "canonical_seeds": "SELECT * FROM canonical",
    "seed_duplicate_counts": """
        SELECT count(*) AS resolved_seed_papers, CAST(sum(n - 1) AS BIGINT) AS duplicate_resolved_seed_records, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_seed_rows_in_duplicate_groups
        FROM (SELECT count(*) AS n FROM seed_rows GROUP BY node_id)""",
    "resolve_cascade": """
        SELECT record_id, coalesce(a, b, c) AS resolved_node, CASE WHEN a IS NOT NULL THEN 'doi' WHEN b IS NOT NULL THEN 'pmid' WHEN c IS NOT NULL THEN 'title_author' ELSE 'all' END AS resolved_by,
               CASE WHEN coalesce(a, b, c) IS NULL THEN 'not_found' ELSE 'resolved' END AS status FROM candidates""",
    "resolve_exact_only": """
        SELECT record_id, coalesce(a, b) AS resolved_node, CASE WHEN a IS NOT NULL THEN 'doi' WHEN b IS NOT NULL THEN 'pmid' ELSE 'exact' END AS resolved_by,
               CASE WHEN coalesce(a, b) IS NULL THEN 'pending_title_fallback' ELSE 'resolved' END AS status FROM candidates""",
    "resolve_stats": """
        SELECT count(*) FILTER (coalesce(a, b, c) IS NOT NULL) AS resolved, count(*) FILTER (coalesce(a, b, c) IS NULL) AS not_found, CAST(0 AS BIGINT) AS pending_title_fallback,
               count(original_doi) + count(original_pmid) FILTER (a IS NULL) + count(*) FILTER (a IS NULL AND b IS NULL) AS checked FROM candidates""",
    "resolve_title_author": "SELECT record_id, 'W' || k AS node_id FROM loaded WHERE k % 3 <> 0",
    "title_search": """
        WITH w AS (SELECT 'W' || o_orderkey AS node_id, string_split('order ' || o_orderkey, ' ') AS t, 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS who FROM orders WHERE o_orderkey % 3 <> 0),
        p AS (SELECT node_id, unnest(t) AS term, len(t) AS n FROM w), z AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM w),
        d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        i AS (SELECT node_id, term, (CAST(floor(1000 * ln(1 + (docs - df + 0.5) / (df + 0.5))) AS BIGINT) * 2200) // (1000 + 300 + (900 * n * docs) // total) AS impact FROM p JOIN d USING (term), z),
        q AS (SELECT record_id, author, unnest(string_split(lower(trim(title)), ' ')) AS term FROM loaded),
        s AS (SELECT record_id, any_value(author) AS author, node_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY record_id, node_id HAVING sum(impact) > 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM s)
        SELECT record_id, rank, node_id, score FROM r WHERE rank <= 5""",
    "resolve_ranked_titles": """
        WITH w AS (SELECT 'W' || o_orderkey AS node_id, string_split('order ' || o_orderkey, ' ') AS t, 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS who FROM orders WHERE o_orderkey % 3 <> 0),
        p AS (SELECT node_id, unnest(t) AS term, len(t) AS n FROM w), z AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM w),
        d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        i AS (SELECT node_id, term, (CAST(floor(1000 * ln(1 + (docs - df + 0.5) / (df + 0.5))) AS BIGINT) * 2200) // (1000 + 300 + (900 * n * docs) // total) AS impact FROM p JOIN d USING (term), z),
        q AS (SELECT record_id, author, unnest(string_split(lower(trim(title)), ' ')) AS term FROM loaded),
        s AS (SELECT record_id, any_value(author) AS author, node_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY record_id, node_id HAVING sum(impact) > 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM s)
        SELECT record_id, arg_min(node_id, (CASE WHEN contains(who, lower(string_split(author, ';')[1])) THEN 0 ELSE 1 END, rank)) AS node_id FROM r JOIN w USING (node_id) WHERE rank <= 5 GROUP BY 1""",
    "unresolved_seeds": "SELECT record_id FROM loaded WHERE original_doi IS NULL",
    "resolved_seed_ids": "SELECT DISTINCT node_id FROM seed_rows",
    "resolved_seeds_with_doi": "SELECT record_id, node_id, original_doi FROM seed_rows WHERE resolved_status = 'resolved'",
    "merge_last_wins": """
        SELECT node_id, source_api, citation_date, seq FROM (
            SELECT source_id AS node_id, CASE WHEN seq % 7 <> 0 THEN source_api END AS source_api, citation_date, seq, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC, citation_date DESC) AS i FROM raw) WHERE i = 1""",
    "metadata_kv": """
        SELECT key, coalesce(value, 'default') AS value FROM (SELECT DISTINCT 'user.' || user_id AS key FROM events)
        LEFT JOIN (SELECT key, CASE WHEN last % 11 <> 0 THEN type END AS value FROM (
            SELECT 'user.' || user_id AS key, arg_max(event_type, (event_id % 2, event_id)) AS type, arg_max(event_id, (event_id % 2, event_id)) AS last FROM events WHERE ('user.' || user_id) NOT LIKE '%0' GROUP BY 1)) USING (key)""",
    "source_provenance": """
        WITH o AS (SELECT max(o_orderdate) AS last FROM orders)
        SELECT 'pipeline_mode' AS key, 'opencitations' AS value UNION ALL SELECT 'rw_snapshot_date', strftime(last, '%Y%m%dT%H%M%SZ') FROM o
        UNION ALL SELECT 'oc_access_date', CAST(CAST(last AS DATE) AS VARCHAR) FROM o UNION ALL SELECT 'openalex_access_date', 'not used'""",
    "propagate_retracted": "SELECT node_id, is_retracted FROM works",
    "frontier_min_depth": "SELECT source_id AS node_id, min(depth) AS depth FROM observed GROUP BY 1",
    "edge_min_depth_merge": "SELECT * FROM merged",
    "bfs_frontier": "SELECT node_id, depth FROM frontier",
    "bfs_edges": "SELECT source_id, target_id, depth, source_api, citation_date FROM edges",
    "bfs_level_stats": """
        WITH k AS (SELECT node_id, CAST(substr(node_id, 2) AS BIGINT) AS n FROM d1), p AS (SELECT node_id FROM k WHERE n % 11 <> 0 AND n % 13 <> 0), h AS (SELECT * FROM raw WHERE target_id IN (SELECT node_id FROM p))
        SELECT (SELECT count(*) FROM k) AS parents, (SELECT count(*) FROM p) AS parents_queried, (SELECT count(*) FROM k WHERE n % 11 <> 0 AND n % 13 = 0) AS parents_failed,
               (SELECT count(*) FROM k WHERE n % 11 = 0) AS parents_without_doi, count(*) AS citations, count(DISTINCT (source_id, target_id)) AS edges,
               count(DISTINCT source_id) FILTER (source_id NOT IN (SELECT node_id FROM d0) AND source_id NOT IN (SELECT node_id FROM d1)) AS new_nodes FROM h""",
    "bfs_capped": """
        WITH o AS (SELECT source_id AS node_id, min(target_id) AS parent_id FROM raw WHERE target_id IN (SELECT node_id FROM d1) AND source_id IN (SELECT node_id FROM d2) GROUP BY 1),
        r AS (SELECT parent_id, coalesce(sum(count(*)) OVER (ORDER BY parent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o GROUP BY parent_id)
        SELECT node_id, parent_id FROM o JOIN r USING (parent_id) WHERE before < 500""",
    "citation_edges_build": """
        SELECT DISTINCT 'doi:10.1000/' || lower(source_id) AS source_id, target_id, 1 AS depth, citation_date FROM (
            SELECT source_id, 'doi:10.1000/' || lower(target_id) AS target_id, citation_date FROM raw
            UNION ALL SELECT source_id, 'doi:10.1000/parent', citation_date FROM raw WHERE seq % 5 = 0)""",
    "citation_nodes_build": """
        SELECT 'doi:10.1000/' || lower(source_id) AS node_id, 1 AS depth, '10.1000/' || source_id AS doi, min(citation_date) AS publication_date,
               source_id IN (SELECT node_id FROM canonical) AS is_retracted FROM raw GROUP BY source_id""",
    "hybrid_crawl": """
        SELECT node_id AS source_id, CAST(NULL AS VARCHAR) AS target_id, depth, 'node' AS source_api FROM frontier
        UNION ALL SELECT source_id, target_id, depth + 1, CASE WHEN bool_or(source_api = 'opencitations') THEN 'opencitations' ELSE 'openalex' END FROM raw JOIN frontier ON node_id = target_id WHERE depth < 2 GROUP BY source_id, target_id, depth""",
    "page_store": """
        SELECT source_id AS node_id, 1 AS depth, count(DISTINCT target_id) FILTER (target_id IN (SELECT node_id FROM d0)) AS n_edges FROM raw WHERE source_api = 'openalex' GROUP BY 1""",
    "pending_frontier": "SELECT node_id FROM d1 WHERE node_id NOT IN (SELECT target_id FROM raw)",
    "graph_build": """
        SELECT (SELECT count(*) FROM nodes) AS vertices, (SELECT count(*) FROM inside) AS edges,
               (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT source_id FROM inside UNION ALL SELECT target_id FROM inside)) AS isolated, CAST(0 AS BIGINT) AS dangling_ends""",
    "weak_components": """
        WITH RECURSIVE e AS (SELECT source_id AS a, target_id AS b FROM inside UNION SELECT target_id, source_id FROM inside),
        r(a, seed) AS (SELECT node_id, node_id FROM frontier WHERE depth = 0 UNION SELECT e.b, r.seed FROM r JOIN e ON e.a = r.a),
        m AS (SELECT x.seed AS s, y.seed AS t FROM r x JOIN r y ON x.a = y.a GROUP BY 1, 2)
        SELECT count(*) AS weak_components FROM (SELECT s FROM m GROUP BY s HAVING min(t) = s)""",
    "edges_from_refs": "SELECT DISTINCT source_id, target_id FROM raw WHERE target_id IN (SELECT node_id FROM d0 UNION ALL SELECT node_id FROM d1)",
    "hybrid_graph": """
        SELECT source_id, target_id, min(depth) AS depth, arg_min(source_api, (depth, CASE WHEN source_api = 'opencitations' THEN 0 ELSE 1 END, seq)) AS source_api FROM observed GROUP BY 1, 2""",
    "resolve_citers": "SELECT seq, node_id FROM raw LEFT JOIN (SELECT node_id FROM works WHERE publication_year IS NOT NULL) ON node_id = source_id",
    "frontier_with_doi": "SELECT node_id, '10.1000/' || lower(node_id) AS doi FROM d0",
    "frontier_status": "SELECT depth, count(*) AS node_count, count(*) FILTER (depth = 2) AS pending_count FROM frontier GROUP BY depth",
    "induced_edges": "SELECT source_id, target_id, depth FROM scoped WHERE source_id IN (SELECT node_id FROM frontier WHERE depth <= 1) AND target_id IN (SELECT node_id FROM frontier WHERE depth <= 1)",
    "induced_nodes": "SELECT node_id, depth, title, publication_date, topic_name, is_retracted FROM nodes WHERE depth <= 1",
    "edge_scope": """
        SELECT count(*) AS stored_edges, count(*) FILTER (source_id NOT IN (SELECT node_id FROM frontier)) AS missing_source, count(*) FILTER (target_id NOT IN (SELECT node_id FROM frontier)) AS missing_target,
               count(*) FILTER (source_id IN (SELECT node_id FROM frontier)) AS exported_edges FROM scoped""",
    "reconcile_counts": """
        WITH b AS (SELECT coalesce(n, 0) - coalesce(CAST(substr(node_id, 2) AS BIGINT) % 20, 0) AS d FROM d1 FULL JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) ON target_id = node_id)
        SELECT count(*) AS parents, count(*) FILTER (d = 0) AS exact, count(*) FILTER (d < 0) AS under, count(*) FILTER (d > 0) AS over, CAST(sum(d) AS BIGINT) AS net_delta FROM b""",
    "terminal_parents": "SELECT node_id FROM d2 WHERE node_id NOT IN (SELECT target_id FROM raw)",
    "stale_edges": "SELECT count(*) AS stale_edges, count(DISTINCT target_id) AS stale_targets FROM raw WHERE target_id NOT IN (SELECT node_id FROM frontier)",
    "ego_sample": """
        WITH t AS (SELECT node_id FROM metrics ORDER BY total_depth2_reach DESC, node_id LIMIT 1),
        a AS (SELECT source_id, target_id, 1 AS hop FROM edges WHERE depth = 1 AND target_id IN (SELECT node_id FROM t) ORDER BY sha256(source_id || '>' || target_id) LIMIT 120)
        SELECT * FROM a UNION ALL
        (SELECT source_id, target_id, 2 FROM edges WHERE depth = 2 AND target_id IN (SELECT source_id FROM a) ORDER BY sha256(source_id || '>' || target_id) LIMIT 350)""",
    "seed_metrics": "SELECT * FROM metrics",
    "seed_pairs": "SELECT seed, source_id, hop FROM dated",
    "bridge_papers": "SELECT * FROM bridge",
    "post_notice_timeline": "SELECT publication_year AS year, count(*) AS n FROM dated WHERE hop = 1 AND post AND publication_year IS NOT NULL GROUP BY 1",
    "event_study": "SELECT * FROM events_by_year",
    "headline_stats": """
        WITH g AS (SELECT round(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini FROM (SELECT total_depth2_reach AS x, row_number() OVER (ORDER BY total_depth2_reach) AS i FROM metrics)),
        q AS (SELECT count(*) AS seed_papers, count(*) FILTER (total_depth2_reach = 0) AS zero_reach_n, round(avg(total_depth2_reach), 6) AS reach_mean, round(quantile_cont(total_depth2_reach, 0.5), 6) AS reach_median,
                     round(quantile_cont(total_depth2_reach, 0.9), 6) AS reach_p90, round(quantile_cont(total_depth2_reach, 0.95), 6) AS reach_p95, round(quantile_cont(total_depth2_reach, 0.99), 6) AS reach_p99,
                     max(total_depth2_reach) AS reach_max, round(100 * count(*) FILTER (total_depth2_reach = 0) / count(*), 6) AS zero_reach_pct,
                     CAST(sum(post_notice_direct_citers) AS BIGINT) AS direct_relationship_sum, CAST(sum(post_notice_depth2_descendants) AS BIGINT) AS depth2_relationship_sum,
                     count(*) FILTER (post_notice_direct_citers > 0) AS seeds_with_post_direct, count(*) FILTER (post_notice_depth2_descendants > 0) AS seeds_with_post_depth2 FROM metrics),
        dup AS (SELECT count(*) AS resolved_seed_papers, CAST(sum(n - 1) AS BIGINT) AS duplicate_resolved_seed_records, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_seed_rows_in_duplicate_groups
                FROM (SELECT count(*) AS n FROM seed_rows GROUP BY node_id)),
        rec AS (SELECT coalesce(n, 0) - coalesce(CAST(substr(node_id, 2) AS BIGINT) % 20, 0) AS d FROM d1 FULL JOIN (SELECT target_id, count(*) AS n FROM edges WHERE depth = 2 GROUP BY 1) ON target_id = node_id),
        r AS (SELECT count(*) AS reconciled_parents, count(*) FILTER (d = 0) AS exact_parents, count(*) FILTER (d < 0) AS undercount_parents, count(*) FILTER (d > 0) AS overcount_parents, CAST(sum(d) AS BIGINT) AS net_delta_citations FROM rec),
        e AS (SELECT count(*) AS total_edges, count(*) FILTER (depth = 1) AS depth1_edges, count(*) FILTER (depth = 2) AS depth2_edges, count(DISTINCT source_id) FILTER (depth = 1) AS depth1_distinct_sources,
                     count(DISTINCT target_id) FILTER (depth = 1) AS depth1_distinct_targets, count(DISTINCT source_id) FILTER (depth = 2) AS depth2_distinct_sources, count(DISTINCT target_id) FILTER (depth = 2) AS depth2_distinct_targets FROM edges),
        n AS (SELECT count(*) FILTER (depth = 0) AS depth0_nodes, count(*) FILTER (depth = 1) AS depth1_nodes, count(*) FILTER (depth = 2) AS depth2_nodes, count(*) AS total_nodes,
                     count(*) FILTER (depth = 1 AND publication_date IS NULL) AS depth1_pubdate_null, count(*) FILTER (depth = 2 AND publication_date IS NULL) AS depth2_pubdate_null FROM nodes),
        p AS (SELECT count(DISTINCT source_id) FILTER (hop = 1) AS direct_unique_nodes, count(DISTINCT source_id) FILTER (hop = 2) AS depth2_unique_nodes FROM dated WHERE post),
        s AS (SELECT count(*) AS seed_records, count(node_id) AS linked_seed_records, count(*) FILTER (resolved_status = 'resolved') AS resolved_seed_records FROM seed_rows),
        o AS (SELECT CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS rw_snapshot_date, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS oc_access_date, CAST(count(*) AS VARCHAR) AS pipeline_mode FROM orders),
        z AS (SELECT count(*) AS zero_count_pruned FROM d1 WHERE node_id NOT IN (SELECT target_id FROM raw)),
        st AS (SELECT count(*) AS stale_edges_deleted, count(DISTINCT target_id) AS stale_missing_targets FROM raw WHERE target_id NOT IN (SELECT node_id FROM frontier)),
        nd AS (SELECT count(*) FILTER (seed_class = 'no_doi') AS no_doi_seeds FROM classed)
        SELECT q.*, gini AS reach_gini, dup.*, r.*, e.*, n.*, p.*, s.*, o.*, z.*, st.*, nd.* FROM q, g, dup, r, e, n, p, s, o, z, st, nd""",
    "depth_counts": "SELECT depth, count(*) AS node_count FROM frontier GROUP BY depth",
    "edge_depths": """
        SELECT depth, source_api, count(*) AS edge_count, count(DISTINCT source_id) AS distinct_sources, count(DISTINCT target_id) AS distinct_targets FROM edges GROUP BY 1, 2
        UNION ALL SELECT depth, 'all', count(*), count(DISTINCT source_id), count(DISTINCT target_id) FROM edges GROUP BY 1""",
    "topic_distribution": "SELECT depth, topic_domain, topic_name, count(*) AS node_count FROM nodes WHERE depth > 0 GROUP BY 1, 2, 3",
    "edges_by_api": "SELECT source_api, count(*) AS n FROM inside GROUP BY 1",
    "summary_metrics": """
        WITH RECURSIVE e AS (SELECT source_id AS a, target_id AS b FROM inside UNION SELECT target_id, source_id FROM inside),
        r(a, seed) AS (SELECT node_id, node_id FROM frontier WHERE depth = 0 UNION SELECT e.b, r.seed FROM r JOIN e ON e.a = r.a),
        m AS (SELECT x.seed AS s, y.seed AS t FROM r x JOIN r y ON x.a = y.a GROUP BY 1, 2),
        w AS (SELECT count(*) AS n FROM (SELECT s FROM m GROUP BY s HAVING min(t) = s)),
        u AS (SELECT count(*) AS n FROM seed_rows GROUP BY node_id)
        SELECT metric, CAST(value AS VARCHAR) AS value FROM (
            SELECT 'seed_records' AS metric, (SELECT count(*) FROM seed_rows) AS value UNION ALL SELECT 'resolved_seed_records', (SELECT count(*) FROM seed_rows WHERE resolved_status = 'resolved')
            UNION ALL SELECT 'linked_seed_records', (SELECT count(node_id) FROM seed_rows) UNION ALL SELECT 'resolved_seed_papers', (SELECT count(*) FROM u)
            UNION ALL SELECT 'duplicate_resolved_seed_records', (SELECT CAST(sum(n - 1) AS BIGINT) FROM u) UNION ALL SELECT 'duplicate_seed_rows_in_duplicate_groups', (SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM u)
            UNION ALL SELECT 'depth2_nodes', (SELECT count(*) FROM frontier) UNION ALL SELECT 'depth0_nodes', (SELECT count(*) FROM d0) UNION ALL SELECT 'depth1_nodes', (SELECT count(*) FROM d1)
            UNION ALL SELECT 'depth2_nodes_only', (SELECT count(*) FROM d2) UNION ALL SELECT 'depth2_edges', (SELECT count(*) FROM inside)
            UNION ALL SELECT 'opencitations_edges', (SELECT count(*) FROM inside WHERE source_api = 'opencitations') UNION ALL SELECT 'openalex_edges', (SELECT count(*) FROM inside WHERE source_api = 'openalex')
            UNION ALL SELECT 'stored_edges', (SELECT count(*) FROM scoped) UNION ALL SELECT 'missing_source', (SELECT count(*) FROM scoped WHERE source_id NOT IN (SELECT node_id FROM frontier))
            UNION ALL SELECT 'missing_target', 0 UNION ALL SELECT 'post_notice_direct_citers', (SELECT CAST(sum(post_notice_direct_citers) AS BIGINT) FROM metrics)
            UNION ALL SELECT 'weak_components', (SELECT n FROM w))""",
    "pubdate_coverage": "SELECT depth, count(*) AS nodes, count(*) FILTER (publication_date IS NULL) AS pubdate_null FROM nodes GROUP BY 1",
    "unique_post_direct": "SELECT count(DISTINCT source_id) AS n FROM dated WHERE hop = 1 AND post",
    "unique_post_depth2": "SELECT count(DISTINCT source_id) AS n FROM dated WHERE hop = 2 AND post",
    "post_notice_totals": """
        SELECT CAST(sum(post_notice_direct_citers) AS BIGINT) AS direct_sum, CAST(sum(post_notice_depth2_descendants) AS BIGINT) AS depth2_sum,
               count(*) FILTER (post_notice_direct_citers > 0) AS seeds_direct, count(*) FILTER (post_notice_depth2_descendants > 0) AS seeds_depth2 FROM metrics""",
    "duplicate_groups": "SELECT node_id, count(*) AS n FROM seed_rows GROUP BY 1 HAVING count(*) > 1",
    "top_seeds": "SELECT node_id, total_depth2_reach FROM metrics ORDER BY 2 DESC, 1 LIMIT 10",
    "top_bridges": "SELECT * FROM bridge ORDER BY cited_seeds DESC, depth2_citers DESC, node_id LIMIT 15",
    "top_labels": """
        SELECT lpad(CAST(row_number() OVER (ORDER BY total_depth2_reach DESC, node_id) AS VARCHAR), 2, '0') || ' ' || substr(title, 1, 55) AS label, total_depth2_reach
        FROM metrics ORDER BY total_depth2_reach DESC, node_id LIMIT 10""",
    "top_seeds_long": """
        WITH t AS (SELECT * FROM metrics ORDER BY total_depth2_reach DESC, node_id LIMIT 10)
        SELECT node_id, 'direct_citers' AS hop, direct_citers AS n FROM t UNION ALL SELECT node_id, 'depth2_descendants', depth2_descendants FROM t""",
    "edge_counts_by_depth": "SELECT depth, count(*) AS edge_count FROM edges GROUP BY 1",
    "reach_quantiles": """
        SELECT round(quantile_cont(total_depth2_reach, 0.5), 6) AS p50, round(quantile_cont(total_depth2_reach, 0.9), 6) AS p90, round(quantile_cont(total_depth2_reach, 0.95), 6) AS p95,
               round(quantile_cont(total_depth2_reach, 0.99), 6) AS p99, round(avg(total_depth2_reach), 6) AS mean, max(total_depth2_reach) AS max,
               round(count(*) FILTER (total_depth2_reach = 0) / count(*), 6) AS zero_share FROM metrics""",
    "reach_gini": """
        SELECT round(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini
        FROM (SELECT total_depth2_reach AS x, row_number() OVER (ORDER BY total_depth2_reach) AS i FROM metrics)""",
    "reach_ccdf": """
        SELECT v.x AS value, round((SELECT count(*) FROM metrics m WHERE m.total_depth2_reach >= v.x) / (SELECT count(*) FROM metrics), 6) AS share
        FROM (SELECT DISTINCT total_depth2_reach AS x FROM metrics WHERE total_depth2_reach > 0) v""",
    "reach_lorenz": """
        SELECT round((SELECT count(*) FROM metrics m WHERE m.total_depth2_reach <= v.x) / (SELECT count(*) FROM metrics), 6) AS p,
               round((SELECT sum(total_depth2_reach) FROM metrics m WHERE m.total_depth2_reach <= v.x) / (SELECT sum(total_depth2_reach) FROM metrics), 6) AS l
        FROM (SELECT DISTINCT total_depth2_reach AS x FROM metrics) v""",
    "reach_histogram": """
        WITH v AS (SELECT log10(total_depth2_reach + 1) AS x FROM metrics), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
        SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((x - lo) / (hi - lo) * 60) + 1, 60) END AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1""",
    "diff_histogram": """
        WITH v AS (SELECT round(share_diff, 9) AS x FROM paired), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
        SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((x - lo) / (hi - lo) * 40) + 1, 40) END AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1""",
    "event_share": "SELECT *, round(n / sum(n) OVER (PARTITION BY period), 6) AS share FROM events_by_year",
    "density_bins": """
        WITH g AS (SELECT node_id, depth, coalesce(n, 0) AS degree FROM frontier LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM inside UNION ALL SELECT target_id FROM inside) GROUP BY 1) ON id = node_id),
        b AS (SELECT node_id, depth, CAST(ntile(256) OVER (PARTITION BY depth ORDER BY degree DESC, node_id) AS INTEGER) AS bin FROM g)
        SELECT s.depth AS source_depth, s.bin AS source_bin, t.depth AS target_depth, t.bin AS target_bin, count(*) AS n
        FROM inside i JOIN b s ON s.node_id = i.source_id JOIN b t ON t.node_id = i.target_id GROUP BY 1, 2, 3, 4""",
    "control_seed_frame": "SELECT node_id, notice_date, year, indeg, post_in, round(seed_share, 6) AS seed_share, round(logdeg, 6) AS logdeg FROM seed_frame",
    "control_pool": "SELECT node_id, year, indeg, round(logdeg, 6) AS logdeg FROM control_pool",
    "control_match": "SELECT node_id, year, indeg, control_id, round(distance, 6) AS distance FROM matched",
    "control_pairs": """
        SELECT node_id, control_id, control_indeg, control_post_in, round(seed_share, 6) AS seed_share, round(control_share, 6) AS control_share, round(share_diff, 6) AS share_diff FROM paired""",
    "control_summary": f"""
        WITH d AS (SELECT round(share_diff, 9) AS d FROM paired WHERE round(share_diff, 9) <> 0),
        r AS (SELECT d, (rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2) AS rank, count(*) OVER (PARTITION BY abs(d)) AS c FROM d),
        s AS (SELECT coalesce(sum(rank) FILTER (d > 0), 0.0) AS v, count(*) AS n, sum(c * c - 1.0) AS ties FROM r),
        z AS (SELECT (v - n * (n + 1) / 4 - sign(v - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
        t AS (SELECT abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2.0)) AS t FROM z),
        o AS (SELECT CAST(count(*) AS DOUBLE) AS matched_pairs, CAST(count(DISTINCT control_id) AS DOUBLE) AS unique_controls, round(median(seed_share), 6) AS seed_share_median, round(median(control_share), 6) AS control_share_median,
               round(median(share_diff), 6) AS median_share_diff, round(avg(share_diff), 6) AS mean_share_diff, round(100 * avg(CASE WHEN share_diff > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_pairs_seed_higher,
               round(avg(seed_share), 6) AS seed_share_mean, round(avg(control_share), 6) AS control_share_mean, round((SELECT {P_OF_Z} FROM t), 6) AS wilcoxon_p FROM paired)
        SELECT metric, value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE value)""",
    "control_match_jitter": """
        SELECT m.node_id, m.year, m.indeg, CASE WHEN abs(a.logdeg - t) <= abs(b.logdeg - t) THEN a.node_id ELSE b.node_id END AS control_id, round(least(abs(a.logdeg - t), abs(b.logdeg - t)), 6) AS distance
        FROM jittered m JOIN numbered_pool a ON a.year = m.year AND a.i = greatest(m.lo, 1) JOIN numbered_pool b ON b.year = m.year AND b.i = greatest(m.hi, 1)""",
    "wilcoxon_signed_rank": f"""
        WITH d AS (SELECT round(share_diff, 9) AS d FROM paired WHERE round(share_diff, 9) <> 0),
        r AS (SELECT d, (rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2) AS rank, count(*) OVER (PARTITION BY abs(d)) AS c FROM d),
        s AS (SELECT coalesce(sum(rank) FILTER (d > 0), 0.0) AS v, count(*) AS n, sum(c * c - 1.0) AS ties FROM r),
        z AS (SELECT v, n, (v - n * (n + 1) / 4 - sign(v - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
        t AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2.0)) AS t FROM z)
        SELECT round(v, 6) AS v, n, round(z, 6) AS z, round({P_OF_Z}, 6) AS p FROM t""",
    "price_quantiles": """
        SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
               round(quantile_cont(l_extendedprice, 0.99), 6) AS p99, round(avg(l_extendedprice), 6) AS mean, round(max(l_extendedprice), 6) AS max,
               round(avg(CASE WHEN l_extendedprice = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM lineitem""",
    "wilcoxon_by_nation": f"""
        WITH RECURSIVE f(k, c) AS (
            SELECT 0, [CAST(1 AS BIGINT)] UNION ALL
            SELECT k + 1, list_transform(range(0, len(c) + k + 1), lambda i: coalesce(c[i + 1], 0) + CASE WHEN i > k THEN coalesce(c[i - k], 0) ELSE 0 END) FROM f WHERE k < 49),
        x AS (SELECT s_nationkey, round(s_acctbal - 4500, 2) AS d FROM supplier),
        y AS (SELECT s_nationkey, count(*) FILTER (d = 0) AS zeros FROM x GROUP BY 1),
        r AS (SELECT s_nationkey, d, (rank() OVER (PARTITION BY s_nationkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY s_nationkey, abs(d)) - 1) / 2) AS rank,
                     count(*) OVER (PARTITION BY s_nationkey, abs(d)) AS c FROM x WHERE d <> 0),
        s AS (SELECT s_nationkey, coalesce(sum(rank) FILTER (d > 0), 0.0) AS v, count(*) AS n, sum(c * c - 1.0) AS ties FROM r GROUP BY 1),
        z AS (SELECT s.*, zeros, (v - n * (n + 1) / 4 - sign(v - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s JOIN y USING (s_nationkey)),
        t AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2.0)) AS t FROM z)
        SELECT s_nationkey, round(v, 6) AS v, n, round(CASE WHEN n < 50 AND ties = 0 AND zeros = 0
               THEN least(1.0, 2 * list_sum(f.c[CAST(greatest(v, n * (n + 1) // 2 - v) AS BIGINT) + 1:]) / power(2.0, n)) ELSE {P_OF_Z} END, 6) AS p FROM t LEFT JOIN f ON f.k = t.n""",
    "control_event_overlay": """
        WITH b AS (
            SELECT w.publication_year - CAST(year(p.notice_date) AS INTEGER) AS offset_year, 'seeds' AS "group" FROM paired p JOIN edges e ON e.target_id = p.node_id AND e.depth = 1 JOIN works w ON w.node_id = e.source_id
            UNION ALL
            SELECT w.publication_year - CAST(year(p.notice_date) AS INTEGER), 'controls' FROM paired p JOIN edges e ON e.target_id = p.control_id AND e.depth = 2 JOIN works w ON w.node_id = e.source_id),
        c AS (SELECT offset_year, "group", count(*) AS n FROM b WHERE offset_year BETWEEN -15 AND 15 GROUP BY 1, 2)
        SELECT *, round(n / sum(n) OVER (PARTITION BY "group"), 6) AS share FROM c""",
    "metadata_check": """
        WITH need(i, key) AS (VALUES (0, 'rw_snapshot_date'), (1, 'oc_access_date'), (2, 'pipeline_mode'), (3, 'opencitations_seed_stats'), (4, 'last_crawl_summary'), (5, 'depth3_truncated'))
        SELECT key FROM need WHERE i NOT IN (SELECT count(*) % 6 FROM events GROUP BY event_type)""",
    "quality_report": """
        WITH s AS (SELECT count(*) AS a, count(*) FILTER (source_id IN (SELECT node_id FROM frontier)) AS b FROM scoped),
        g AS (SELECT (SELECT count(*) FROM nodes) || '/' || (SELECT count(*) FROM inside) AS m),
        t AS (SELECT count(*) AS n FROM (SELECT DISTINCT depth, topic_domain, topic_name FROM nodes WHERE depth > 0)), u AS (SELECT count(*) AS n FROM bridge),
        d AS (SELECT count(*) FILTER (resolved_status = 'resolved') AS r, count(DISTINCT node_id) AS p, count(*) FILTER (resolved_status <> 'resolved') AS l FROM seed_rows)
        SELECT 'required_metadata' AS check_name, 'major' AS severity, 'fail' AS status, 'oc_access_date;opencitations_seed_stats;pipeline_mode;rw_snapshot_date' AS observed,
               'rw_snapshot_date;oc_access_date;pipeline_mode;opencitations_seed_stats;last_crawl_summary;depth3_truncated' AS expected, 'Missing: last_crawl_summary;depth3_truncated' AS details
        UNION ALL SELECT 'duplicate_canonical_seed_records', 'major', 'pass', '0', '0', 'resolved records ' || r || ', resolved papers ' || p || ', linked duplicates ' || l FROM d
        UNION ALL SELECT 'stored_vs_exported_edges', 'major', CASE WHEN a = b THEN 'pass' ELSE 'fail' END, CAST(b AS VARCHAR), CAST(a AS VARCHAR), 'without a source ' || (a - b) || ', without a target 0' FROM s
        UNION ALL SELECT 'frontier_processed_for_depth2_claim', 'major', 'pass', '0', '0', 'parents of depth below 2 that wait'
        UNION ALL SELECT 'opencitations_failed_parents', 'moderate', 'fail', '1', '0', 'parents whose citations could not be had'
        UNION ALL SELECT 'topic_labels_present', 'moderate', 'pass', 'true', 'true', n || ' of ' || n || ' rows' FROM t
        UNION ALL SELECT 'bridge_titles_present', 'moderate', 'pass', 'true', 'true', n || ' of ' || n || ' rows' FROM u
        UNION ALL SELECT 'full_graph_export', 'major', 'pass', m, m, 'nodes and edges of the written graph' FROM g
        UNION ALL SELECT 'output_exists:' || name, 'major', CASE WHEN there THEN 'pass' ELSE 'fail' END, CAST(there AS VARCHAR), 'true', 'the table is there and has rows'
            FROM (VALUES ('bridge_papers', TRUE), ('topic_distribution', TRUE), ('missing_table', FALSE)) x(name, there)""",
    "streaming_edge_merge": "SELECT * FROM merged",
    "streaming_failures": """
        SELECT DISTINCT target_id AS node_id, 'no answer for ' || target_id AS error FROM raw
        WHERE CAST(target_id[2:] AS BIGINT) % 7 = 0 AND CAST(target_id[2:] AS BIGINT) % 2 = 1""",
    "crawl_resumed": "SELECT node_id, depth, depth < 2 AS processed FROM frontier",
    "crawl_edges": "SELECT * FROM edges",
    "crawl_expansions": """
        WITH early AS (SELECT DISTINCT source_id FROM raw WHERE (seq // 1000000) % 3 < 2 AND target_id IN (SELECT node_id FROM d0) AND source_id NOT IN (SELECT node_id FROM d0))
        SELECT 'before' AS phase, (SELECT count(*) FROM d0) + (SELECT count(*) FROM early) AS parents
        UNION ALL SELECT 'last batch', (SELECT count(*) FROM d1) - (SELECT count(*) FROM early)""",
    "dump_citations": "SELECT source_id AS citing, target_id AS cited, CAST(citation_date AS VARCHAR) AS creation FROM raw WHERE target_id IN (SELECT node_id FROM frontier WHERE depth < 2)",
    "growing_components": """
        WITH RECURSIVE e AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
        r(a, seed) AS (SELECT node_id, node_id FROM frontier WHERE depth = 0 UNION SELECT e.b, r.seed FROM r JOIN e ON e.a = r.a),
        k AS (SELECT a AS node, min(seed) AS s FROM r WHERE a IN (SELECT a FROM e) GROUP BY 1)
        SELECT min(node) AS component, count(*) AS n FROM k GROUP BY s""",
    "stored_upserts": """
        SELECT node_id, source_api, citation_date, seq FROM (
            SELECT source_id AS node_id, CASE WHEN seq % 7 <> 0 THEN source_api END AS source_api, citation_date, seq, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS r FROM raw)
        WHERE r = 1 AND node_id NOT LIKE '%9'""",
}

#: The whole analysis is given the merged edges alone, so none is out of scope, and all of its tables are there.
_merged_only = lambda body: re.sub(r"\bscoped\b", "edges", body)
BODIES["analysis_summary"] = _merged_only(BODIES["summary_metrics"])
BODIES["analysis_control_summary"] = BODIES["control_summary"]
BODIES["analysis_checks"] = _merged_only(BODIES["quality_report"]).replace(
    "('bridge_papers', TRUE), ('topic_distribution', TRUE), ('missing_table', FALSE)",
    "('bridge_papers', TRUE), ('topic_distribution', TRUE), ('seed_metrics', TRUE), ('depth_counts', TRUE), ('summary', TRUE)",
)


def with_tables(body: str) -> str:
    """``body`` after the tables that it and they use, in their order."""
    need: set[str] = set()

    def add(sql: str) -> None:
        for name in TABLES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|, {name}\b", sql):
                need.add(name)
                add(TABLES[name])

    add(body)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*)", body, re.S)
    shared = ", ".join(f"{n} AS ({TABLES[n].strip()})" for n in TABLES if n in need)
    if not shared:
        return body.strip()
    return f"WITH {own[1] or ''}{shared}, {own[2]}" if own else f"WITH {shared} {body.strip()}"


SQL = {name: with_tables(body) for name, body in BODIES.items()}
