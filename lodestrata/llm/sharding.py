"""Sharding (operator 3): a two-pass external shuffle, in DataFrame functions only.

Law ``key``: a document's shard follows from its id and the number of shards alone, by rendezvous hashing: the shard
with the highest seeded hash of (id, shard). With one more shard, rows move only into the new one. Rows of equal ids
stay together.

Pass one scatters whole records uniformly over buckets of a size that memory holds, by a seeded hash; every bucket
belongs to one shard, and a shard has as many as its bytes need. Pass two shuffles each bucket by itself (Fisher and
Yates, Spark's ``shuffle`` of an array that was put in order first) and writes it. Buckets are dealt to tasks by their
number, one task each, so the seed and the bucket's number decide the order whatever task or attempt runs it. A shard's
slots go through its buckets in turn.

A null id is a key like any other. The place of a row in the input is part of the scattering hash, so rows that repeat
one id, or one text, still spread over their shard's buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, work_path

SHARDS = 8
SEED = 7919
#: Bytes of text that one bucket holds on average. A task holds one bucket, as rows and as a shuffled array.
BUCKET_BYTES = 16 << 20
#: Up to so many buckets (one row of three numbers each) their places are broadcast; beyond, they are joined by a shuffle.
BROADCAST = 50_000


def shard_of(id_col: Column, shards: int, seed: int = SEED) -> Column:
    """Number of the shard with the highest hash; of equal hashes, the highest number."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.coalesce(id_col.cast("string"), F.lit("null"))).alias("h"), F.lit(s).alias("s")) for s in range(shards)])["s"] if shards > 1 else F.lit(0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Write the records as Parquet under ``folder``, one directory for each shard, and return what was written.

    Columns of the result: ``rec`` (a struct of the columns in ``keep``, by default all), shard, bucket and slot, the
    row's place in its shard, gapless from 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(keep or ["*"])).alias("rec"), shard_of(F.col(id_col), shards, seed).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col(id_col).cast("string"), F.monotonically_increasing_id()).alias("lot"), size_of(F.col(text_col)).alias("bytes"))
    sizes = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    starts, total = [], 0
    for s in range(shards):
        starts.append(total)
        total += max(1, -(-sizes.get(s, 0) // bucket_bytes))
    ends = [*starts[1:], total]
    first, count = F.array(*map(F.lit, starts)), F.array(*[F.lit(b - a) for a, b in zip(starts, ends, strict=True)])
    rows = rows.select("rec", "lot", "shard", (first[F.col("shard")] + F.pmod("lot", count[F.col("shard")])).cast("int").alias("bucket"))
    dealt = rows.repartitionById(total, F.col("bucket")).sortWithinPartitions("bucket", "lot")
    buckets = dealt.groupBy("bucket", "shard").agg(F.collect_list(F.struct("rec")).alias("rows"))
    shuffled = buckets.select("shard", "bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "row")).select("shard", "bucket", "at", "row.rec")
    shuffled.write.partitionBy("shard").parquet(folder)
    written = spark.read.schema(shuffled.schema).parquet(folder)
    # one small row for each bucket, not for each document
    held = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = held.select("shard", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = F.broadcast(before) if total <= BROADCAST else before
    return written.join(before, ["shard", "bucket"]).select("rec", "shard", "bucket", (F.col("before") + F.col("at")).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from the shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = write_shards(load(spark, sf_dir, "documents"), work_path(spark, "shards"))
    doc_id, text = F.col("rec.doc_id"), F.col("rec.text")
    return out.select(doc_id.alias("doc_id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", shard_of(doc_id, SHARDS + 1).cast("int").alias("grown_shard"))
