"""The corpus queries that SQL can express, in DuckDB's SQL over the whole tables. The others rest on models, on a
vocabulary's merges or on XXH64, which that SQL lacks: tests hold them against brute force."""

from __future__ import annotations

LAST = 2**63 - 1  # a null doc_id counts as larger than every other

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
earliest AS (SELECT g, min(k) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM win JOIN earliest USING (g) WHERE f < k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
left_over AS (SELECT r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS kept FROM words LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (r)
"""

#: list_reduce adds from left to right, as the operator does, so that scores are equal to the last bit.
NEAREST = """
WITH v AS (
  SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS n
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(list_zip(c.e, q.e), lambda t: t[1] * t[2]), lambda a, b: a + b) / (c.n * q.n) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

ORACLES = {"op5_substring_dedup": SUBSTRINGS, "op10_nearest": NEAREST}
