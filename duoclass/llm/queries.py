"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.llm.common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.langid import predict_language, train

    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = train(docs.where(~F.col("held_out")), "text", "lang")
    out = predict_language(docs.select("doc_id", "held_out", "text"), model, "text")
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.urlfilter import RULES, judge_urls, page_edges

    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    out = judge_urls(pages.select("page_id", "url"), RULES, page_edges(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.tokencount import count_tokens

    return count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), "text").select("doc_id", "n_tokens")


def op4_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.itq import embedding_groups

    return embedding_groups(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.suffix import dedup_passages

    out = dedup_passages(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.col("sa_bytes").alias("n_bytes"), F.col("sa_removed").alias("n_removed"),
                      F.col("sa_spans").alias("n_spans"), F.sha2("sa_kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.warc import archive_pages

    out = archive_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", "url", "html")
    return out.select(F.col("row_id").alias("page_id"), F.col("n_payload").alias("payload_bytes"),
                      F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
                      F.col("refers_id").alias("refers_to"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.minhash import near_duplicate_groups

    return near_duplicate_groups(read(spark, sf_dir, "documents", "doc_id", "text"), shingle_words=4, percent=80)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.styletree import extract_main_text

    out = extract_main_text(read(spark, sf_dir, "pages", "page_id", "url", "html"), "url", "html")
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.contain import contained_items

    return contained_items(read(spark, sf_dir, "documents", "doc_id", "text"),
                           read(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.bpe import digests, encode_decode

    return digests(encode_decode(read(spark, sf_dir, "documents", "doc_id", "text"), "text"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.align import align_documents

    out = align_documents(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.packing import pack, token_pieces

    pieces = token_pieces(read(spark, sf_dir, "documents", "doc_id", "text"))
    out = pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duoclass.llm.centroids import centroid_digests, cluster_vectors

    out, centroids = cluster_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    digests = spark.createDataFrame(list(enumerate(centroid_digests(centroids))), "cluster int, centroid_sha256 string")
    return (out.withColumnRenamed("id", "vec_id").join(F.broadcast(digests), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_itq_dedup": op4_itq_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe": op10_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_packing": op12_packing,
    "op13_centroids": op13_centroids,
}


def _centroids_sql(dims: int = 64, clusters: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> str:
    """Assignment and exact means, one pair of steps for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, min(dk) AS dk FROM (
  SELECT n, vec_id, v, {{'d': CAST(list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT), 'k': k}} AS dk
  FROM v, c{r}) GROUP BY n, vec_id, v)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, list(CAST((s - (s % n + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM (
  SELECT dk.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY dk.k, i) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    last = f"a{rounds}"
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (
  SELECT sha256('{seed}:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {clusters})),
{(","+chr(10)).join(steps)}
SELECT vec_id, CAST(dk.k AS INTEGER) AS cluster, dk.d AS distance, CAST(sum(dk.d) OVER (PARTITION BY dk.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(dk.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON dk.k = c{rounds}.k"""


_REST = "CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END"

ORACLE: dict[str, str] = {
    # Pages of the given tables have no canonical links and no refreshes, so aliases are
    # left to the tests; rules and default verdict are the query's.
    "op2_url_filter": f"""
WITH p AS (SELECT page_id, url, {_REST} AS rest FROM pages),
h AS (SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
      FROM h JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM h LEFT JOIN f USING (page_id)""",
    "op4_itq_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(low, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(low, v.vec_id) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, CAST(p AS BIGINT) AS p, md5(substr(h, 2 * p + 1, 200)) AS w
      FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p FROM d)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, p, sum(CASE WHEN p <= prev + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
         FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM gone)),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev_e FROM spans),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * prev_e + 1, 2 * (s - prev_e)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS k,
                sum(e - s) AS n_removed, count(*) AS n_spans
         FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS top,
        list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)),
          'string_agg', '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM d""",
    "op9_decontaminate": """
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM t WHERE id IS NOT NULL),
ks AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE kind = 1 AND len(w) > 0),
g AS (SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g
      FROM w JOIN ks ON len(w) >= k AND (kind = 0 OR k = least(len(w), 5))),
n AS (SELECT id AS item_id, count(*) AS n_item FROM g WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, item_id, n_item, count(*) AS n_shared
FROM g d JOIN g b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 JOIN n ON n.item_id = b.id
GROUP BY d.id, item_id, n_item HAVING count(*) * 100 >= n_item * 80""",
    "op7_minhash_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
        ELSE list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3)) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op13_centroids": _centroids_sql(),
}
