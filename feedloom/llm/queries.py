"""Registered queries of this package and their oracles."""

from feedloom.llm.bpe import op2_byte_bpe
from feedloom.llm.language import op1_language_id
from feedloom.llm.merkle import op11_merkle
from feedloom.llm.packing import op9_best_fit
from feedloom.llm.ppm import op5_ppm
from feedloom.llm.quality import op8_quality_rules
from feedloom.llm.secret_scan import op13_secrets
from feedloom.llm.simhash import op6_simhash
from feedloom.llm.suffixes import op10_suffix_array
from feedloom.llm.token_counts import op7_token_counts
from feedloom.llm.toxicity import op4_toxicity
from feedloom.llm.vectors import op3_near_vectors
from feedloom.llm.whitening import op12_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_byte_bpe, op3_near_vectors, op4_toxicity, op5_ppm, op6_simhash, op7_token_counts, op8_quality_rules, op9_best_fit,
        op10_suffix_array, op11_merkle, op12_whitening, op13_secrets,
    )
}
ORACLES: dict[str, str] = {
    "op3_near_vectors": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      ok AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
      l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
      r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
      SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
      FROM v LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY 1) n ON n.x = v.vec_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) c ON c.x = v.vec_id""",
    "op11_merkle": """WITH RECURSIVE d AS MATERIALIZED (
        SELECT *, coalesce(n_chars + CASE WHEN xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
            lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 7 = 0
            THEN 1 ELSE 0 END, NULL) AS n_new FROM documents),
      p AS MATERIALIZED (
        SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
          coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b, coalesce(strlen(n_new::VARCHAR) || ':' || n_new, '-') AS c, coalesce(strlen(text) || ':' || text, '-') AS e FROM d),
      l AS MATERIALIZED (
        SELECT doc_id, lang, sha256(a || b || e) AS leaf, sha256(a || c || e) AS cur, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM p),
      t(lang, k, i, n, h) AS (
        SELECT lang, 0, i, n, leaf FROM l
        UNION ALL SELECT lang, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, k, i // 2, n),
      s AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
      u(k, i, n, h) AS (
        SELECT 0, i, n, subroot FROM s
        UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 2, n),
      w(doc_id, lang, k, i, n, leaf, cur, proof) AS (
        SELECT doc_id, lang, 0, i, n, leaf, cur, '' FROM l
        UNION ALL SELECT w.doc_id, w.lang, w.k + 1, w.i // 2, (w.n + 1) // 2, w.leaf,
          sha256(CASE WHEN w.i % 2 = 1 THEN t.h || w.cur ELSE w.cur || coalesce(t.h, '') END), w.proof || coalesce(t.h, '')
        FROM w LEFT JOIN t ON t.lang IS NOT DISTINCT FROM w.lang AND t.k = w.k AND t.i = xor(w.i, 1) WHERE w.n > 1),
      v(doc_id, lang, k, i, n, leaf, subroot, cur, proof) AS (
        SELECT w.doc_id, w.lang, 0, s.i, s.n, w.leaf, s.subroot, w.cur, w.proof FROM w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
        UNION ALL SELECT v.doc_id, v.lang, v.k + 1, v.i // 2, (v.n + 1) // 2, v.leaf, v.subroot,
          sha256(CASE WHEN v.i % 2 = 1 THEN u.h || v.cur ELSE v.cur || coalesce(u.h, '') END), v.proof || coalesce(u.h, '')
        FROM v LEFT JOIN u ON u.k = v.k AND u.i = xor(v.i, 1) WHERE v.n > 1)
      SELECT v.doc_id, v.leaf, v.subroot, u.h AS root, sha256(v.proof) AS proof_sha256, v.cur AS folded_root, v.cur = u.h AS verified FROM v JOIN u ON u.n = 1 WHERE v.n = 1""",
}
