"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, fingerprint, langid, lm, mixing, quality, sharding, simhash, warc
from .common import Workspace, id_crc, table


def tokenizer_files() -> tuple[str, str]:
    """(path of the rank file, pre-token pattern): where the public vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), id_crc() % 7 != 2, Workspace(spark))


def op2_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    path = work.path("warc")
    warc.write(table(spark, sf_dir, "pages"), path, work)
    got = warc.read(spark, path, work)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    again = F.col("type") == "revisit"  # it has no block: length and digest are what its header says of the payload
    return got.select(
        page("id").alias("page_id"),
        F.when(again, F.col("said_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("said_digest", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers").alias("refers_to"),
    )


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark))


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"), Workspace(spark))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_crc() % 5 == 0
    out = langid.identify(docs.select("doc_id", "text"), langid.learn(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), Workspace(spark), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer_files())


def op8_pivot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), Workspace(spark))


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), Workspace(spark))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_warc_chain": op2_warc_chain,
    "op3_importance": op3_importance,
    "op4_canonical_digest": op4_canonical_digest,
    "op5_byte_cnn": op5_byte_cnn,
    "op6_byte_shards": op6_byte_shards,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pivot_join": op8_pivot_join,
    "op9_entropy_mixing": op9_entropy_mixing,
    "op10_simhash": op10_simhash,
}

#: The CRC-32 table is made from its polynomial; fixed value: 3988292384, the reversed polynomial of ISO 3309.
_SHARDS_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS BIGINT), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: xor(x >> 8, t.crc[xor(x & 255, y) + 1])), 4294967295) AS text_crc32 FROM d, t),
s AS (SELECT *, CAST(least(15, (2 * (sum(size) OVER (ORDER BY doc_id) - size) + size) * 16 // (2 * sum(size) OVER ())) AS INTEGER) AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

#: Base 32 of 160 bits: digit i has 5 of the 20 bits of the hexadecimal digits from 5 * (i // 4).
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""

_LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NOT NULL AND isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0
    AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m ON m.id = v.vec_id
"""

ORACLE_SQL: dict[str, str] = {"op2_warc_chain": _WARC_SQL, "op6_byte_shards": _SHARDS_SQL, "op8_pivot_join": _LINKS_SQL}
