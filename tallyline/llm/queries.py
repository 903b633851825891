"""The corpus queries and their SQL, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, contamination, filter_audit, length_histogram, licenses, line_templates, mixing, near_dups, quality, secrets, token_files, vector_search, warc
from .cluster import fresh_dir, small_batches
from .vectors import grid_vectors


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("mult").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("clean_text"), 256).alias("clean_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "tokens")
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_files.read_token_digests(manifest, path)


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.length_histogram(_table(spark, sf_dir, "documents"), tokenizer_file())


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(warc.archive_files(spark, path), path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest = quality.fit_forest(docs, _table(spark, sf_dir, "labels"))
    out = quality.judge_quality(docs, forest)
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly_score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.train_secret_field(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = grid_vectors(_table(spark, sf_dir, "embeddings"), 256)
    return vector_search.exact_top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = grid_vectors(_table(spark, sf_dir, "embeddings"), 64, dims=64)
    out = clustering.with_inertia(*clustering.cluster_vectors(vectors, 16, 3, 1))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_report(*filter_audit.failure_cells(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mix, op2_near_duplicates, op3_recurring_lines, op4_token_files, op5_contamination, op6_token_counts, op7_licenses, op8_warc, op9_quality, op10_secrets, op11_vector_search, op12_clusters, op13_filter_audit)}


_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_OP5 = r"""
WITH item AS (
  SELECT item_id, [x for x in regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM benchmark WHERE item_id IS NOT NULL),
doc AS (
  SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents WHERE doc_id IS NOT NULL),
item_sh AS (
  SELECT DISTINCT item_id, s FROM (
    SELECT item_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s
    FROM item WHERE len(w) > 0)),
doc_sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s
    FROM doc WHERE len(w) > 0)),
n AS (SELECT item_id, CAST(count(*) AS BIGINT) AS item_shingles FROM item_sh GROUP BY item_id)
SELECT d.doc_id, i.item_id, n.item_shingles, CAST(count(*) AS BIGINT) AS shared
FROM doc_sh d JOIN item_sh i USING (s) JOIN n ON n.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n.item_shingles
HAVING 100 * count(*) >= 80 * n.item_shingles
"""

_OP8 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT html, max(page_id) AS main FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN main IS NOT NULL AND page_id <> main THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> main THEN main END AS refers_to
FROM p LEFT JOIN m USING (html)
"""


_OP11 = r"""
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS g FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, q.g AS query, c.vec_id, CAST(list_inner_product(q.g, c.g) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id OR q.g <> c.g WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS n FROM pairs)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""


def _op12(rounds: int = 3) -> str:
    """k-means by full scans, a pair of steps per round."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT rid, vec_id, g, min(CAST(list_inner_product(g, g) - 2 * list_inner_product(g, cg) + list_inner_product(cg, cg) AS BIGINT) * 16 + c) AS m
  FROM v, c{r} GROUP BY rid, vec_id, g)"""
    moved = """c{s} AS MATERIALIZED (
  SELECT c, coalesce(mg, cg) AS cg FROM c{r} LEFT JOIN (
    SELECT c, list(f ORDER BY i) AS mg FROM (SELECT m % 16 AS c, i, floor(sum(g[i]) / count(*)) AS f FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY c) USING (c))"""
    steps = ",\n".join(nearest.format(r=r) + ("" if r == rounds else ",\n" + moved.format(r=r, s=r + 1)) for r in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS g FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, g) - 1 AS c, g AS cg FROM v QUALIFY c < 16),
{steps},
done AS (SELECT vec_id, m % 16 AS c, m // 16 AS d FROM a{rounds})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(x AS BIGINT) for x in cg], ',')) AS centroid_sha256
FROM done JOIN c{rounds} USING (c)
"""


_OP13 = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
masks AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY 1, 2),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p, f q, f r, f s, f t
  WHERE (p.b | q.b | r.b | s.b | t.b) = 31),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS early FROM orders, range(1, 6) x(step)),
counts AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (early | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & early = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & early <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & early = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & early = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counts
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": _OP2, "op5_contamination": _OP5, "op8_warc": _OP8, "op11_vector_search": _OP11, "op12_clusters": _op12(), "op13_filter_audit": _OP13}


__all__ = ["oracle_sql", "queries", "tokenizer_file"]
