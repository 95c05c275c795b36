"""The registered queries as SQL for DuckDB, where SQL can express them.

Every constant stands written out here, not imported: a wrong one on either side shows.
"""

QUALITY_RULES = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
),
places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
grams AS (
    SELECT doc_id, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' '
                      || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS gram
    FROM places WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
again AS (
    SELECT doc_id, i FROM grams WHERE gram IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS place FROM again) GROUP BY doc_id
),
judged AS (
    SELECT doc_id, text, words, lines, list_filter(lines, lambda l: NOT CASE
        WHEN NOT regexp_matches(l, '[^\x20\x09-\x0D]') THEN false
        WHEN len(regexp_extract_all(l, '[|»›·•]')) >= 2 AND len(regexp_extract_all(l, '[|»›·•]'))
             > 0.25 * (1 + length(l) - length(replace(l, ' ', ''))) THEN true
        WHEN len(regexp_extract_all(l, '[#*$%&|<>!]{2,}'))
             > 0.3 * (1 + length(l) - length(replace(l, ' ', ''))) THEN true
        WHEN NOT regexp_matches(right(rtrim(l), 4), '[.!?…:;。！？]["''”’)\]]*\z')
             AND 1 + length(l) - length(replace(l, ' ', '')) < 8 THEN true
        WHEN 1 + length(l) - length(replace(l, ' ', '')) <= 12 AND (
             contains(lower(l), 'all rights reserved') OR contains(lower(l), 'cookie policy')
             OR contains(lower(l), 'privacy policy') OR contains(lower(l), 'terms of use')
             OR contains(lower(l), 'terms of service') OR contains(lower(l), 'click here')
             OR contains(lower(l), 'sign up') OR contains(lower(l), 'log in')
             OR contains(lower(l), 'subscribe') OR contains(lower(l), 'enable javascript')
             OR contains(lower(l), 'lorem ipsum') OR contains(lower(l), 'skip to content')
             OR contains(lower(l), 'back to top') OR contains(lower(l), 'share this')) THEN true
        ELSE false END) AS stay
    FROM d
),
counted AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
           len(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
           length(regexp_replace(array_to_string(stay, chr(10)), '[\x20\x09-\x0D]', '', 'g')) AS kept_chars
    FROM judged
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words)
       AND kept_chars >= 0.5 * word_chars AND word_chars > 0 AS kept
FROM counted LEFT JOIN covered USING (doc_id)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM d
),
ends AS (
    SELECT doc_id, line, i, i = n OR left(md5(coalesce(lag(md5(line)) OVER p, '') || md5(line)), 1)
           IN ('0', '1', '2', '3', '4') AS is_end
    FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (
    SELECT doc_id, line, i, coalesce(sum(is_end::INT) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
    FROM ends
),
chunks AS (
    SELECT doc_id, c, min(i) AS start, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body
    FROM numbered GROUP BY doc_id, c
),
removed AS (
    SELECT doc_id, c, n_lines FROM chunks WHERE n_lines >= 2
    QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1
),
kept AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS clean_text
    FROM numbered LEFT JOIN removed USING (doc_id, c) WHERE n_lines IS NULL GROUP BY doc_id
),
sums AS (SELECT doc_id, count(*) AS chunks, sum(n_lines) AS lines FROM removed GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(s.chunks, 0)::BIGINT AS n_chunks_removed,
       coalesce(s.lines, 0)::BIGINT AS n_lines_removed,
       CASE WHEN text IS NOT NULL THEN coalesce(clean_text, '') END AS clean_text
FROM d LEFT JOIN sums s USING (doc_id) LEFT JOIN kept USING (doc_id)
"""



def _clustering() -> str:
    """Three rounds written out: the vectors, the start, and per round who is nearest and where
    the means lie."""
    far = "list_sum(list_transform(list_zip(v.c, t.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"SELECT v.r, min({{'d': {far}, 'k': t.k}}) AS best FROM v, t%d t GROUP BY v.r"
    parts = [
        """v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT::HUGEINT) AS c
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL
         OR NOT isfinite(x))) = 0
)""",
        """t0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST) - 1 AS k, c
    FROM v ORDER BY k LIMIT 16
)""",
    ]
    for i in range(3):
        parts.append(f"a{i} AS MATERIALIZED ({nearest % i})")
        parts.append(f"""t{i + 1} AS MATERIALIZED (
    SELECT t.k, coalesce(m.c, t.c) AS c FROM t{i} t LEFT JOIN (
        SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c
        FROM (SELECT k, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
              FROM (SELECT best.k AS k, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM a{i} JOIN v USING (r))
              GROUP BY k, j)
        GROUP BY k) m ON m.k = t.k
)""")
    parts.append(f"a3 AS MATERIALIZED ({nearest % 3})")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, best.k::INTEGER AS cluster, best.d::BIGINT AS distance,
       (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(t3.c, ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN t3 ON t3.k = best.k
"""


LEXICAL_SEARCH = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
q AS (
    SELECT r, item_id, unnest(list_distinct(terms)) AS term FROM (
        SELECT row_number() OVER () AS r, item_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM benchmark)
),
whole AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY r, term
),
w AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole
),
m AS (SELECT r, doc_id, 10 + (90 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, whole WHERE len(terms) > 0),
scored AS (
    SELECT q.r AS item_row, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.r = tf.r
    GROUP BY q.r, item_id, tf.r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id))::INTEGER AS rank,
       doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) <= 10
"""

ORACLE = {
    "op5_line_dedup": LINE_DEDUP, "op9_quality_rules": QUALITY_RULES, "op11_centroid_clustering": _clustering(),
    "op12_lexical_search": LEXICAL_SEARCH,
}
