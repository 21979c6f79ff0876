"""DuckDB twins of the registered queries that SQL can express."""

ORACLE = {
    "op4_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id)
                 OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
    "op5_decontamination": r"""
        WITH iw AS MATERIALIZED (
          SELECT CAST(item_id AS VARCHAR) AS item_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE text IS NOT NULL),
        win AS MATERIALIZED (
          SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
          FROM iw, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS u(i)),
        dw AS MATERIALIZED (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        occ AS MATERIALIZED (
          SELECT d.doc_id, d.i, win.n, win.item_id
          FROM (SELECT doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS win
                FROM dw, (SELECT DISTINCT n FROM win) AS s,
                     unnest(range(1, len(w) - s.n + 2)) AS u(i)) AS d
          JOIN win USING (win, n)),
        hits AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
        items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
               CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_warc": r"""
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex,
                 min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
          FROM pages),
        bits AS (
          SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c:
                   bin(strpos('0123456789abcdef', c) + 15)[2:5]), '') AS b
          FROM p)
        SELECT page_id, strlen(h) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(
                   range(0, 5), lambda k: (1 << (4 - k)) * CAST(b[5 * i + k + 1] AS INT))) AS BIGINT), 1)),
                 '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM bits""",
    "op10_line_dedup": r"""
        WITH l AS MATERIALIZED (
          SELECT doc_id, i, s[i] AS line, len(s) AS n
          FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents
                WHERE text IS NOT NULL),
               unnest(range(1, len(s) + 1)) AS u(i)),
        w AS (
          SELECT doc_id, i, line, lead(line) OVER d AS l1, lead(line, 2) OVER d AS l2
          FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        later AS (
          SELECT doc_id, i FROM (
            SELECT doc_id, i,
                   row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, i) AS k
            FROM w WHERE l2 IS NOT NULL) WHERE k > 1),
        gone AS (
          SELECT DISTINCT doc_id, i + k AS i FROM later, unnest([0, 1, 2]) AS u(k)),
        kept AS (
          SELECT doc_id, max(n) AS n, count(g.i) AS n_removed,
                 coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.i IS NULL), '') AS text
          FROM l LEFT JOIN gone AS g USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines,
               CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM documents LEFT JOIN kept USING (doc_id)""",
    "op13_hard_negatives": r"""
        WITH r AS MATERIALIZED (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
          SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
                 CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
          FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
          SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
                   AS INT) AS rank
          FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
            AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= 10""",
}
