"""The thin queries over these operators, by name; SQL where SQL can express the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, collocations, embedding_dedup, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, suffix_tree, tokens, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_quality_classifier": quality_classifier.query,
        "op3_embedding_near_dedup": embedding_dedup.query,
        "op4_mix_sources": mixing.query,
        "op5_best_fit_packing": packing.query,
        "op10_minhash_near_dedup": near_dedup.query,
        "op6_lm_scoring": suffix_tree.query,
        "op7_secret_scan": secret_scan.query,
        "op8_token_counts": tokens.query,
        "op9_quality_rules": quality_rules.query,
        "op11_warc": warc.query,
        "op12_collocations": collocations.query,
        "op13_token_alignment": alignment.query,
    }


#: Components come from a closure over the links, which needs links that are few, as on the small tables.
_CLOSURE = """
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
"""

ORACLES = {
    "op12_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, d, array_to_string(w[k:k + d - 1], ' ') AS phrase FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS k FROM w, range(1, 5) t(d) WHERE len(w) >= d)),
        f AS (SELECT lang, d, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30 OR d = 1),
        words AS (SELECT lang, sum(a) AS n FROM f WHERE d = 1 GROUP BY lang),
        cuts AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, d)) AS k FROM f WHERE d > 1) c),
        scored AS (SELECT cuts.*, l.a AS l, r.a AS r, (2000000::HUGEINT * cuts.a) // (l.a + r.a) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.d > 2 AND f.lang = b.lang AND len(f.phrase) > len(b.phrase) AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * f.a >= 80 * b.a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
    """,
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), q AS (SELECT *, octet_length(encode(payload)) AS bytes, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
        r AS (SELECT *, bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM q)
        SELECT page_id, bytes::BIGINT AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
    """,
    "op3_embedding_near_dedup": f"""
        WITH RECURSIVE sound AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
          WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
        links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
        {_CLOSURE}
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id))::BIGINT AS component_id, e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = e.vec_id
    """,
    "op10_minhash_near_dedup": f"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] END AS s
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        {_CLOSURE}
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::BIGINT AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
        FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
