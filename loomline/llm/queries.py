"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from loomline.llm.decontaminate import op2_decontamination
from loomline.llm.gif import op8_media_gif
from loomline.llm.lines import op7_line_dedup
from loomline.llm.minhash import op6_minhash_near_dedup
from loomline.llm.mixing import op4_mixing
from loomline.llm.quality import op1_quality_classifier
from loomline.llm.substring import op3_substring_dedup
from loomline.llm.suffixes import op10_suffix_array_dedup
from loomline.llm.token_counts import op5_token_counts
from loomline.llm.token_files import op9_token_ids

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_media_gif": op8_media_gif,
    "op9_token_ids": op9_token_ids,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

SQL = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS i)),
f AS (SELECT g, min(doc_id) AS m FROM s GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM s JOIN f USING (g) WHERE m < doc_id),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, k: NOT list_contains(coalesce(ps, []), k)), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS v, doc_id AS r FROM w UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.v WHERE c.r < u.b),
m AS (SELECT v, min(r) AS r FROM c GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r AS component_id, r = w.doc_id AS kept
FROM w JOIN m ON m.v = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
""",
}
