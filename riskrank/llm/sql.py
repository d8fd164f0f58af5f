"""SQL twins of the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

# Boilerplate: a line counts once per page; white space at its ends does not matter.
_TRIMMED = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
# Terms: runs of ASCII letters and digits and all that is not ASCII, A-Z lower-cased.
_TERMS = (r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

SQL: dict[str, str] = {
    "op7_boilerplate_lines": f"""
        WITH lines AS (
            SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS parts
            FROM documents),
        placed AS (
            SELECT doc_id, host, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM lines),
        keyed AS (SELECT *, {_TRIMMED} AS bare FROM placed),
        pages AS (SELECT host, count(*) AS n FROM lines GROUP BY 1),
        marked AS (
            SELECT host, bare FROM keyed JOIN pages USING (host) WHERE bare <> ''
            GROUP BY host, bare HAVING count(DISTINCT doc_id) >= 3
               AND count(DISTINCT doc_id) >= 0.1 * any_value(n)),
        kept AS (
            SELECT doc_id, count(*) FILTER (WHERE m.bare IS NOT NULL) AS n_removed,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE m.bare IS NULL), '') AS text
            FROM keyed k LEFT JOIN marked m ON k.host = m.host AND k.bare = m.bare GROUP BY doc_id)
        SELECT doc_id, n_removed, length(text) AS n_chars_kept, sha256(text) AS text_sha256 FROM kept""",
    "op8_chat_format": r"""
        WITH said AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        placed AS (
            SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
            FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        prefixes AS (
            SELECT conv_id, pos, n, string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '|')
                   OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
            FROM placed),
        ends AS (SELECT prefix, min(conv_id) AS conv_id FROM prefixes WHERE pos = n GROUP BY 1),
        maximal AS (
            SELECT conv_id FROM ends e
            WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n AND p.prefix = e.prefix))
        SELECT conv_id, count(*) AS n_turns,
               string_agg('<|' || replace(role, '|', '') || '|>' || chr(10) || replace(text, '<|', '< |')
                          || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
        FROM placed JOIN maximal USING (conv_id) GROUP BY conv_id""",
    "op12_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
                   CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        ranked AS (
            SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT alike AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 5""",
    "op13_lexical_search": rf"""
        WITH said AS (
            SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents WHERE text IS NOT NULL),
        counted AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
        lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY 1),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT)
                   AS w FROM counted, totals GROUP BY 1),
        asked AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE text IS NOT NULL),
        scored AS (
            SELECT item_id, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // terms))))) AS score
            FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id), totals
            GROUP BY ALL),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 10""",
}
