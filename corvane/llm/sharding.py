"""Sharding by weighted rendezvous hashing.

A row's key and a shard's number give a hash u in (0, 1); the row goes to the shard with the least -ln(u) / weight. So the
key and the shards alone decide, shards get rows by weight, and one more shard takes rows only into itself. One map over
the rows with built-in functions; nothing is gathered. Slots number a shard's rows without a gap: rows are counted by
(shard, salt), the salt being a range of the key's hash, and numbered inside it, so that no task holds a whole shard.

Law: ``key``. Defined results: a null key hashes as the text "null"; null text has size OVERHEAD and the CRC of nothing;
repeated rows go to one shard, each with a slot of its own; an empty table gives an empty result; extra columns are
passed on, but for those named like an added column (capitals aside), which are dropped; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, shuffle_partitions, table, without

SHARDS, OVERHEAD = 40, 16
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _cost(key, i: int, weight: float):
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{i}"))), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(i).alias("shard"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = SHARDS, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """The columns of docs and those of ADDED; grown_shard is the shard with one more of weight grown_weight."""
    weights = weights or [1.0] * shards
    docs = without(docs, ADDED)
    columns = docs.columns
    hashed, salt, best_, k = (free_name(c, [*columns, *ADDED]) for c in ("__hash", "__salt", "__best", "__k"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sized = docs.withColumn("size", (F.octet_length(text) + OVERHEAD).cast("long")).withColumn("text_crc32", F.crc32(text)).withColumn(hashed, F.md5(key))
    best = sized.withColumn(best_, F.array_min(F.array(*(_cost(key, i, w) for i, w in enumerate(weights)))))
    grown = F.least(best_, _cost(key, len(weights), grown_weight))["shard"]
    put = best.withColumn("shard", F.col(best_)["shard"]).withColumn("grown_shard", grown).drop(best_)
    digits = max(2, len(f"{shuffle_partitions(docs.sparkSession):x}"))  # of the key's hash: 256 salts a shard at least
    salted = put.withColumn(salt, F.substring(hashed, 1, digits))
    before = salted.groupBy(F.col("shard").alias("s"), F.col(salt).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    before = before.select("s", "x", (F.sum("n").over(Window.partitionBy("s").orderBy("x")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", salt).orderBy(hashed, "text_crc32", "size")
    numbered = salted.withColumn(k, F.row_number().over(order) - 1).alias("l")
    both = numbered.join(before.alias("r"), (F.col("l.shard") == F.col("r.s")) & (F.col(f"l.{salt}") == F.col("r.x")))
    slot = (F.col("r.before") + F.col(f"l.{k}")).cast("long").alias("slot")
    named = [F.col(f"l.`{c}`") for c in columns]
    return both.select(*named, "l.size", "l.text_crc32", F.lit("key").alias("law"), "l.shard", slot, "l.grown_shard")


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the text stays where it is: only its size and CRC go on
    return shard(docs).drop("text")


def _sql_cost(i: str) -> str:
    return f"-ln((CAST(('0x' || substr(md5(k || '/' || {i}), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0)"


SQL = f"""
WITH bits AS (SELECT range AS b FROM range(256)),
step AS (
  SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM bits),
t AS (SELECT list(v ORDER BY b) AS v FROM step),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, k, len(h) // 2 + 16 AS size,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda a, b: xor(a >> 8, t.v[xor(a & 255, b) + 1]))) AS crc FROM d, t),
s AS (SELECT c.*, i, {_sql_cost('i')} AS cost FROM c, range(41) AS r(i)),
a AS (
  SELECT doc_id, k, size, crc, arg_min(i, cost) FILTER (i < 40) AS shard, arg_min(i, cost) AS grown FROM s GROUP BY ALL)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k), crc, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM a
"""
