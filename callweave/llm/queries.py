"""The operators' queries over the tables of a folder, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, codes, dedup, packing, pii, quality, sharding, simhash, token_output, topk, toxicity, warc
from .common import scratch, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens.orc")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_output.token_digests(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), size=3, radius=2)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    return warc.read_archives(warc.captures_of(warc.keys_of(pages), path), path)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.judge(docs, model, F.col("source"), F.col("lang"), carry=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "doc_score", "host_quality", "path_quality", "score", "kept")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, layout = table(spark, sf_dir, "documents"), scratch(spark, "shards"), sharding.grid(regions=5, racks=4, each=2)
    sharding.write_shards(docs, path, layout)
    return sharding.digests(spark, path, docs.schema, grown=sharding.joined(layout, "region-0", "rack-0"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.lloyd(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, size=64, scale=256.0)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_topk, op3_exact_dedup, op4_token_output, op5_packing, op6_pii, op7_byte_bpe, op8_simhash, op9_warc, op10_quality, op11_sharding, op12_clusters, op13_codes)}
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_sql(rounds: int) -> str:
    """Every vector against every centroid, a pair of tables for each round."""
    out = f"""WITH t AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
    c0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v
      FROM (SELECT sha256(concat('2:', CAST(vec_id AS VARCHAR))) AS h, v FROM t ORDER BY h LIMIT 40))"""
    for i in range(rounds + 1):
        out += f""",
    a{i} AS MATERIALIZED (
      SELECT t.vec_id, any_value(t.v) AS v,
             min(struct_pack(d := list_dot_product(t.v, t.v) - 2 * list_dot_product(t.v, c.v) + list_dot_product(c.v, c.v), c := c.cluster)) AS m
      FROM t CROSS JOIN c{i} c GROUP BY t.vec_id)"""
        if i < rounds:
            out += f""",
    c{i + 1} AS MATERIALIZED (
      SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT cluster, list(x ORDER BY k) AS v FROM (
          SELECT cluster, k, floor(sum(x) / count(*)) AS x FROM (SELECT m.c AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{i}) GROUP BY cluster, k)
        GROUP BY cluster) n ON n.cluster = c.cluster)"""
    return f"""{out}
    SELECT a.vec_id, a.m.c AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.m.c"""


def _codes_sql(rounds: int) -> str:
    """Every part against every entry of its codebook."""
    out = f"""WITH t AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE}),
    p AS MATERIALIZED (SELECT vec_id, part, v[part * 4 + 1 : part * 4 + 4] AS v FROM t CROSS JOIN range(16) r(part)),
    b0 AS MATERIALIZED (
      SELECT p.part, f.entry, p.v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM t ORDER BY vec_id LIMIT 64) f ON f.vec_id = p.vec_id)"""
    for i in range(rounds + 1):
        out += f""",
    a{i} AS MATERIALIZED (
      SELECT p.vec_id, p.part, any_value(p.v) AS v,
             min(struct_pack(d := list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v), e := b.entry)) AS m
      FROM p JOIN b{i} b ON b.part = p.part GROUP BY p.vec_id, p.part)"""
        if i < rounds:
            out += f""",
    b{i + 1} AS MATERIALIZED (
      SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN (
        SELECT part, entry, [floor(sum(v[1]) / count(*)), floor(sum(v[2]) / count(*)), floor(sum(v[3]) / count(*)), floor(sum(v[4]) / count(*))] AS v
        FROM (SELECT part, m.e AS entry, v FROM a{i}) GROUP BY part, entry) n ON n.part = b.part AND n.entry = b.entry)"""
    return f"""{out},
    e AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
    s AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
    SELECT e.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY t.label) AS BIGINT) AS label_error, s.h AS codebooks_sha256
    FROM e JOIN t ON t.vec_id = e.vec_id CROSS JOIN s"""


SQL: dict[str, str] = {
    "op12_clusters": _lloyd_sql(5),
    "op13_codes": _codes_sql(2),
    "op2_topk": """
        WITH t AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM t q JOIN t c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (
          SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
          FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    "op9_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
                     min(page_id) OVER (PARTITION BY html) AS least FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND least <> page_id THEN least END AS refers_to
        FROM s""",
}
