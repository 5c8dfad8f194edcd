"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

SHARDS = 24
HELD_OUT = 2
WORDS_PER_EDIT = 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leaks import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import duplicate_lines

    return duplicate_lines(table(spark, sf_dir, "documents"), words_per_edit=WORDS_PER_EDIT).withColumnsRenamed({"id": "doc_id", "keep_id": "keep_doc_id"})


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archives import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import quantise_log, quantise_name, shard_rows

    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("text_hash")
    )
    dims = [quantise_log(F.col("size")), quantise_name(F.col("source")), quantise_name(F.col("lang"))]
    dealt = shard_rows(rows, dims, [F.col("text_hash"), F.col("doc_id"), F.col("text_crc32")], SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan_secrets, span_text

    def digests(batch: pa.RecordBatch):
        sides = [[[(s["start"], s["end"], s["kind"]) for s in row] for row in batch.column(i).to_pylist()] for i in (1, 2)]
        counts = [pa.array([sum(s[2] == k for s in row) for row in sides[0]], pa.int64()) for k in ("assign", "access", "hex")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array(map(digest, sides[0]), pa.string()), pa.array(map(span_text, sides[1]), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        )

    found = scan_secrets(table(spark, sf_dir, "documents"))
    return arrow_map(found, digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_urls": op2_urls,
    "op3_leaks": op3_leaks,
    "op4_neighbours": op4_neighbours,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_archives": op8_archives,
    "op9_sharding": op9_sharding,
    "op10_secrets": op10_secrets,
}
SQL: dict[str, str] = {
    "op8_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
q AS (SELECT page_id, strlen(h) AS n, s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(s, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
""",
    "op5_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
""",
}
