"""DuckDB statements of the numbered operators that SQL can express."""

_NORMAL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

STATEMENTS = {
    "op1_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, k, w[k:k + 19] AS g
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
        again AS (SELECT doc_id, k FROM win
                  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM again),
        cut AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM gone GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body
                 FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
                 ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
        i AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS m, w[k:k + least(len(w), 13) - 1] AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        pos AS (
            SELECT doc_id, k, m, w[k:k + m - 1] AS g
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k
                  FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
        hit AS (SELECT doc_id, k, m, item_id FROM pos JOIN win USING (m, g)),
        covered AS (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS p FROM hit),
        n AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
        ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
                FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * n_hit >= coalesce(len(w), 0) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        win AS (SELECT doc_id, k, md5(substr(h, 2 * k - 1, 200)) AS g
                FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS k FROM d WHERE length(h) >= 200)),
        again AS (SELECT doc_id, k FROM win
                  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1),
        steps AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM again),
        runs AS (SELECT doc_id, k, sum((before IS NULL OR k > before + 100)::INT) OVER
                     (PARTITION BY doc_id ORDER BY k) AS run FROM steps),
        spans AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS b FROM runs GROUP BY doc_id, run),
        kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
                     list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(
                   range(1, n_spans + 2), lambda i: substr(h, 2 * coalesce(ends[i - 1], 1) - 1,
                   2 * (coalesce(starts[i], length(h) // 2 + 1) - coalesce(ends[i - 1], 1)))), '') END)) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS alike,
                     coalesce(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])), 0)::BIGINT AS score
              FROM v AS a JOIN v AS r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
        pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM pos JOIN s USING (anchor_id)
        WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
        QUALIFY row_number() OVER w <= 5""",
}
