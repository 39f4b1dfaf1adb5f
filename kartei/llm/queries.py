"""The operators over their whole tables, as named queries, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kartei.llm import bpe, decontaminate, filter_audit, jaccard_join, language, licenses, line_dedup, mtree, quality, simhash, token_counts, toxicity, va_kmeans

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def llm_queries() -> dict[str, Query]:
    return {
        "op1_topk_search": lambda s, d: mtree.embedding_top_k(_table(s, d, "embeddings")),
        "op2_toxicity": lambda s, d: toxicity.toxicity_scores(_table(s, d, "documents"), _table(s, d, "labels")),
        "op3_decontamination": lambda s, d: decontaminate.contamination_digests(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op4_token_counts": lambda s, d: token_counts.token_counts(_table(s, d, "documents")),
        "op5_line_dedup": lambda s, d: line_dedup.line_digests(_table(s, d, "documents")),
        "op6_language_id": lambda s, d: language.language_digests(_table(s, d, "documents")),
        "op7_simhash": lambda s, d: simhash.simhash_digests(_table(s, d, "documents")),
        "op8_quality": lambda s, d: quality.quality_grades(_table(s, d, "documents"), _table(s, d, "labels")),
        "op9_licenses": lambda s, d: licenses.license_digests(_table(s, d, "documents")),
        "op10_bpe": lambda s, d: bpe.bpe_digests(_table(s, d, "documents")),
        "op11_filter_audit": lambda s, d: filter_audit.audit(_table(s, d, "documents"), _table(s, d, "labels")),
        "op12_centroids": lambda s, d: va_kmeans.cluster_digests(_table(s, d, "embeddings")),
        "op13_jaccard_join": lambda s, d: jaccard_join.near_duplicates(_table(s, d, "documents")),
    }


_TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0
),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

_LINES = r"""
WITH raw_line AS (
  SELECT doc_id, place, parts[place] AS line, len(parts) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS place)
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM raw_line
),
twice AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
kept AS (
  SELECT keyed.*, keeper IS NULL OR keeper = doc_id AS stays FROM keyed LEFT JOIN twice USING (key)
)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

_WINDOWS = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram
  FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s)
  WHERE len(w) > 0
),
doc_window AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
  FROM doc, (SELECT DISTINCT n FROM item_window), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)
  WHERE len(w) >= n
),
hit AS (
  SELECT doc_id, item_id, s, item_window.n FROM doc_window JOIN item_window USING (n, gram)
),
word AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM hit
),
counted AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_AUDIT = r"""
WITH word AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
labelled AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 200,
    100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)
  ] AS f
  FROM word LEFT JOIN labelled USING (doc_id)
),
cell AS (SELECT part, good, toxic, f, count(*) AS n FROM failing GROUP BY ALL),
letter AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letter a JOIN letter b ON b.i <> a.i JOIN letter c ON c.i NOT IN (a.i, b.i)
  JOIN letter d ON d.i NOT IN (a.i, b.i, c.i) JOIN letter e ON e.i NOT IN (a.i, b.i, c.i, d.i)
),
met AS (
  SELECT part, o, step, good, toxic, n, f[o[step]] AS own,
    len([x FOR x IN o[1 : step - 1] IF f[x]]) > 0 AS earlier, len([x FOR x IN f IF x]) AS n_fails
  FROM orders, (SELECT unnest(range(1, 6)) AS step), cell
),
counted AS (
  SELECT part, o, step,
    CAST(coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (own AND earlier), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (own AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (own AND NOT earlier AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (own AND NOT earlier AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, o, step
)
SELECT part, array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order, CAST(step AS INTEGER) AS step,
  kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM counted
"""


def _k_means(rounds: int = 5, clusters: int = 40, dims: int = 64) -> str:
    """The rounds of the clustering, one common table after the other."""
    square = f"CAST(list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, {dims + 1})]) AS BIGINT)"
    parts = [
        f"""v0 AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM v0 WHERE vec_id IS NOT NULL
  ORDER BY sha256('2:' || vec_id), v LIMIT {clusters}
)""",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': {square}, 'c': c}}) AS b FROM v0, c{k} GROUP BY r
)""")
        if k < rounds:
            parts.append(f"""s{k} AS (
  SELECT b.c AS c, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL
),
c{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(f, m) AS m FROM c{k}
  LEFT JOIN (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS f FROM s{k} GROUP BY c) USING (c)
)""")
    last = f"""
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance,
  CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON b.c = c
"""
    return "WITH " + ",\n".join(parts) + last


def llm_statements() -> dict[str, str]:
    """SQL for the queries that SQL can say; the others are tested against brute force."""
    return {"op1_topk_search": _TOP_K, "op3_decontamination": _WINDOWS, "op5_line_dedup": _LINES, "op11_filter_audit": _AUDIT, "op12_centroids": _k_means()}
