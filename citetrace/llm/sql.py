"""DuckDB SQL of the numbered queries whose rows SQL can give."""

from __future__ import annotations

from citetrace.llm import licences, quality

WORDS = r"SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents"
LOWER = r"""SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents"""

TERMS = r"SELECT {0}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {1}"


def verdict(thresholds=quality.THRESHOLDS) -> str:
    """The rules as one condition over the counts."""
    parts = []
    for _, over, under, low, high in thresholds:
        b = under or "1"
        if low is not None:
            parts.append(f"1000 * {over} >= {low} * {b}")
        if high is not None:
            parts.append(f"1000 * {over} <= {high} * {b}")
    return " AND ".join(parts)




def values(rows) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)


KNOWN = values((i, licences.plain(t), len(licences.plain(t).split())) for i, t in licences.ALL_SENTENCES)
RULES = values((n, name, licences.pattern(rule)) for n, (name, rule) in enumerate(licences.ALL_RULES))
BEATEN = values((n, m) for n in range(len(licences.ALL_RULES)) for m in licences.beaten_by(n))
HEADS = ", ".join(f"'{x}'" for x in licences.HEADS)

STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))

SQL = {
    "op2_ngram_jaccard_join": f"""
        WITH RECURSIVE b AS ({LOWER}),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k, 5 AS n FROM b, unnest(range(1, len(w) - 3)) r(i) WHERE len(w) >= 5
              UNION ALL SELECT doc_id, array_to_string(w, ' '), len(w) FROM b WHERE len(w) BETWEEN 1 AND 4),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, c.doc_id AS b, count(*) AS n FROM s a JOIN s c ON a.k = c.k AND a.n = c.n AND a.doc_id < c.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
        FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY 1) c ON c.x = d.doc_id""",
    "op3_substring_dedup": f"""
        WITH b AS ({WORDS}),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM b, unnest(range(1, len(w) - 11)) r(i) WHERE len(w) >= 13),
        f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY 1),
        g AS (SELECT DISTINCT k.doc_id, j FROM k JOIN f ON f.k = k.k AND f.first < k.doc_id, unnest(range(k.i, k.i + 13)) q(j)),
        x AS (SELECT doc_id, i, w[i] AS word FROM b, unnest(range(1, len(w) + 1)) r(i)),
        y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) FILTER (g.j IS NULL) AS kept, count(g.j) AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.i GROUP BY 1)
        SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM b LEFT JOIN y ON y.doc_id = b.doc_id""",
    "op5_license_scan": rf"""
        WITH known(id, s, n) AS ({KNOWN}), rules(rule, name, pattern) AS ({RULES}), beaten(rule, longer) AS ({BEATEN}),
        t AS (SELECT doc_id, row_number() OVER () AS r, regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g') AS t FROM documents),
        p AS (SELECT doc_id, r, list_filter(list_transform(string_split(t, chr(10)),
                     lambda x: trim(regexp_replace(translate(x, '{licences.CAPITALS}', '{licences.CAPITALS.lower()}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS p FROM t),
        c AS (SELECT r, p, id, s, n FROM (SELECT r, p, ' ' || array_to_string(p, ' ') || ' ' AS whole FROM p) JOIN known ON contains(whole, ' ' || s || ' ')),
        f AS (SELECT r, i, arg_max(id, n) AS id FROM c, unnest(range(1, len(p) + 1)) q(i)
              WHERE list_contains(list_transform(range(i, least(len(p), i + n) + 1), lambda j: array_to_string(p[i:j], ' ')), s) GROUP BY 1, 2),
        l AS (SELECT r, list(id ORDER BY i) AS ids FROM f GROUP BY 1),
        g AS (SELECT r, unnest(string_split(' ' || array_to_string(list_transform(ids, lambda x: CASE WHEN x IN ({HEADS}) THEN '| ' || x ELSE x END), ' ') || ' ', '|')) AS stretch FROM l),
        m AS (SELECT r, k, rule, name FROM (SELECT r, stretch, row_number() OVER () AS k FROM g) JOIN rules ON regexp_matches(stretch, pattern)),
        h AS (SELECT r, string_agg(DISTINCT name, ' ' ORDER BY name) AS licences FROM m
              WHERE NOT EXISTS (SELECT 1 FROM beaten b JOIN m o ON o.rule = b.longer WHERE b.rule = m.rule AND o.k = m.k) GROUP BY 1)
        SELECT p.doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(licences, '') AS licences
        FROM p LEFT JOIN l ON l.r = p.r LEFT JOIN h ON h.r = p.r""",
    "op8_quality_rules": rf"""
        WITH b AS ({WORDS}),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM b, unnest(range(1, len(w) - 1)) r(i) WHERE len(w) >= 3),
        v AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) x(o) WHERE c > 1 GROUP BY 1),
        l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM b) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
        c AS (SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
                     coalesce(n_lines, 0) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({STOPS}))) AS n_stop_words
              FROM b LEFT JOIN v ON v.doc_id = b.doc_id LEFT JOIN l ON l.doc_id = b.doc_id),
        d AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict()} AS kept FROM d""",
    "op11_shared_lexical_search": rf"""
        WITH b AS ({TERMS.format("doc_id", "documents")}), i AS ({TERMS.format("item_id", "benchmark")}),
        d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM b WHERE len(w) > 0),
        q AS (SELECT item_id, unnest(list_distinct(w)) AS t FROM i),
        z AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
        f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
        x AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, z GROUP BY t, n_docs),
        m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM d, z),
        s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN x USING (t) JOIN m USING (r) GROUP BY 1, 2, 3)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
        (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
    "op12_fill_in_middle": """
        WITH b AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        c AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
                     CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM b),
        d AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
        e AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, z - a) AS m, substring(t, z + 1) AS s FROM d)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM e""",
    "op13_block_search": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op10_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM q""",
}
