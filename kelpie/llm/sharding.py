"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every record scores each shard by ``-ln(u) / weight``, u a hash of the record's key and the shard in (0, 1), and goes to
the least score. A shard's share is its weight's share; a shard that is added takes only the records that it wins, and one
that is taken away gives up only its own. Which shard a record is in depends on its key and the shards, never on other rows
(law ``key``), so nothing is gathered to decide it.

``slot`` numbers the rows of a shard from 0 without gaps. Rows are cut by hash into ``PARTS`` parts of each shard; rows are
numbered within (shard, part), and the sizes of the parts before (at most shards x PARTS rows, whatever the input)
are added. No task holds a whole shard.

Defined cases
    Null doc_id: the key is the word ``null``, so rows without an id share a shard, whose slots are still gapless. Null text: no bytes,
    CRC of nothing (0). Rows of one doc_id: one shard, slots by size and hash of their texts; equal rows have slots in an order that
    does not matter. Equal texts need not share a shard: the key decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm import common as c

#: Parts of a shard that are numbered on their own.
PARTS = 256


def hashed(text: Column, digits: int = 13) -> Column:
    """The first hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: that of least -ln(u)/weight, the first of equal ones."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [F.struct((-F.log((hashed(F.concat_ws(":", key, F.lit(str(i)))) + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.least(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, name: str = "shard") -> DataFrame:
    """docs with a column of the shard."""
    return docs.withColumn(name, rendezvous(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), weights))


def number_slots(rows: DataFrame, n_shards: int, key: str = "doc_id", ties: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """rows (with a column shard) with a gapless ``slot`` in each shard; rows of one key are in the order of ``ties``."""
    part = F.pmod(hashed(F.concat(F.lit("slot:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 6), F.lit(parts)).cast("int")
    rows = rows.withColumn("_part", part)
    sizes = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_part").orderBy(F.col(key).asc_nulls_last(), *ties)
    numbered = rows.withColumn("_row", F.row_number().over(within) - 1)
    # At most n_shards x parts rows, so this side is broadcast.
    return numbered.join(F.broadcast(starts), ["shard", "_part"]).withColumn("slot", (F.col("_start") + F.col("_row")).cast("long")).drop("_part", "_row", "_start")


def shard_rows(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16) -> DataFrame:
    """The rows of docs with their columns, ``shard`` and ``slot``; columns of these two names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = c.packed(docs, F.col("doc_id"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("tie"))
    placed = rows.withColumn("shard", rendezvous(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), weights).cast("int"))
    numbered = number_slots(placed, len(weights), ties=("size", "tie"))
    old = [F.col(f"row.`{x}`") for x in docs.columns if x.lower() not in ("shard", "slot")]
    return numbered.select(*old, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, [1.0] * n_shards).cast("int").alias("shard"),
        rendezvous(key, [1.0] * (n_shards + 1)).cast("int").alias("grown_shard"),
    )
    return number_slots(rows, n_shards, ties=("size", "text_crc32")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


_SCORE = "-ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"

ORACLE_SQL = f"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k, strlen(coalesce(text, '')) AS n FROM documents),
crc AS (
  SELECT text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT text, hex(encode(text)) AS h FROM docs), polynomial),
scores AS (SELECT DISTINCT k, s, {_SCORE} AS score FROM docs, range(17) t(s)),
placed AS (
  SELECT k, arg_min(s, (score, s)) FILTER (WHERE s < 16) AS shard, arg_min(s, (score, s)) AS grown FROM scores GROUP BY k)
SELECT doc_id, (n + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || k), 1, 6))::BIGINT % {PARTS}, doc_id) - 1)::BIGINT AS slot,
  grown::INT AS grown_shard
FROM docs JOIN placed USING (k) JOIN crc USING (text)
"""
