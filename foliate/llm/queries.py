"""Queries opN_<name> over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name and the module whose function opN it is.
_HOMES = {
    "op1_media": ("media", "op1"),
    "op2_token_store": ("token_store", "op2"),
    "op3_warc": ("warc", "op3"),
    "op4_toxicity": ("toxicity", "op4"),
    "op5_private": ("private", "op5"),
    "op6_language": ("language", "op6"),
    "op7_ngram_join": ("ngram_join", "op7"),
    "op8_piece_scan": ("piece_scan", "op8"),
    "op9_decontaminate": ("decontaminate", "op9"),
    "op10_main_text": ("main_text", "op10"),
    "op11_collocations": ("collocations", "op11"),
    "op12_simhash": ("simhash", "op12"),
    "op13_spelling": ("spelling", "op13"),
}

QUERIES = {name: getattr(importlib.import_module(f"foliate.llm.{home}"), function) for name, (home, function) in _HOMES.items()}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS INT), 1)), '')"

#: SQL for those queries that it can express on whole tables.
ORACLES: dict[str, str] = {
    "op3_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
 SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS intact FROM f""",
    "op7_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED_WORDS} AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c.c >= 85 * (a.n + b.n - c.c)),
 r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM r WHERE x = w.doc_id), w.doc_id)) AS component_id, (SELECT count(*) FROM l WHERE x = w.doc_id) AS n_links FROM w LEFT JOIN n ON n.doc_id = w.doc_id""",
    "op9_decontaminate": f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
 i AS (SELECT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
 o AS (SELECT doc_id, k, p, item_id FROM (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM i) WHERE len(ws) >= k)) JOIN i USING (k, g)),
 h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM o) GROUP BY doc_id),
 t AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
 FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op11_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p), n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
 g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(ws) >= k)),
 c AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
 t AS (SELECT lang, k, phrase, f, ws, unnest(range(1, k)) AS cut FROM c WHERE k > 1),
 s AS (SELECT t.*, a.f AS l, b.f AS r, CAST(2000000 AS HUGEINT) * t.f // (a.f + b.f) AS score FROM t JOIN c a ON a.lang = t.lang AND a.phrase = array_to_string(t.ws[1 : t.cut], ' ') JOIN c b ON b.lang = t.lang AND b.phrase = array_to_string(t.ws[t.cut + 1 :], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 i AS (SELECT lang, array_to_string(ws[i : i + size - 1], ' ') AS phrase, max(f) AS f FROM (SELECT lang, ws, f, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT lang, ws, f, k, unnest(range(2, k)) AS size FROM c WHERE k > 2)) GROUP BY 1, 2),
 x AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 80 * b.f)
 SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n.n, CAST(score AS BIGINT) AS score FROM x JOIN n ON n.lang = x.lang QUALIFY rank <= 2000""",
}
