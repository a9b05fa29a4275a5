"""DuckDB equivalents of the training-data queries that SQL can express on whole tables.

The others have none: fingerprints and token ids need hashes and a tokenizer that SQL lacks, learned
scores and approximate search aren't SQL, and byte windows of whole texts are too slow there. Tests
hold those against brute force.
"""

from __future__ import annotations

from corvane.llm.queries import url_rules
from corvane.llm.url_filter import BLOCK

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_rules())

_URLS = f"""
WITH rules AS (SELECT * FROM (VALUES {_RULES}) t(verdict, rhost, rpath)),
cut AS (
  SELECT page_id,
         translate(COALESCE(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         COALESCE(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, COALESCE(verdict, CASE WHEN contains(host, 'casino') OR contains(host, 'adult-') OR contains(host, 'ads-track') THEN '{BLOCK}' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN fits USING (page_id)
"""

_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.j, r.root FROM reach r JOIN links l ON l.i = r.vec_id),
least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, CAST(count(l.j) AS BIGINT) AS n_links, any_value(component_id) AS component_id, e.vec_id = any_value(component_id) AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN links l ON l.i = e.vec_id GROUP BY e.vec_id
"""

_WORDS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS window_words FROM w, LATERAL (SELECT unnest(range(len(words) - 19)) AS s) WHERE len(words) >= 20),
marked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY window_words ORDER BY doc_id, s) > 1 AS again FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM marked WHERE again),
kept AS (
  SELECT doc_id, k, word, gone.k IS NOT NULL AS removed
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS k FROM w) LEFT JOIN gone USING (doc_id, k))
SELECT w.doc_id, CAST(len(any_value(w.words)) AS BIGINT) AS n_words, CAST(COALESCE(count(*) FILTER (removed), 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(string_agg(word, ' ' ORDER BY k) FILTER (NOT removed), '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) GROUP BY w.doc_id
"""


#: Fixed value: the owners of the 25 slots of one period, earliest deadline first, simulated apart from the operator.
PERIOD = "src0 src1 src2 src10 src11 src12 src0 src13 src14 src15 src16 src17 src0 src1 src18 src19 src2 src3 src0 src4 src5 src6 src7 src8 src9"
_SLOTS = ", ".join(f"({t}, '{s}')" for t, s in enumerate(PERIOD.split()))

_MIXING = f"""
WITH period AS (SELECT * FROM (VALUES {_SLOTS}) t(t, source)),
plan AS (SELECT source, count(*) AS n, list(t ORDER BY t) AS slots FROM period GROUP BY source),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents),
placed AS (SELECT doc_id, source, r, r // 64 AS block, (r // 64) // n * (SELECT count(*) FROM period) + slots[CAST(r // 64 % n + 1 AS INTEGER)] AS slot FROM ranked JOIN plan USING (source))
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, row_number() OVER (ORDER BY slot, r) - 1 AS position FROM placed
"""


SQL = {
    "op2_url_filters": _URLS.strip(),
    "op7_substring_dedup": _WORDS.strip(),
    "op8_embedding_near_dedup": _LINKS.strip(),
    "op9_mixing": _MIXING.strip(),
}
