"""Chunks from a stream of documents: each new id is stored once, however often the stream brings it.

An extension of the batch engine. The state is the set of ids within the watermark; ids beyond it are caught by the
anti-join with the store in each micro-batch, so a batch that is run again after a failure stores nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import encode_chunk, tag_of
from ..functions.ids import chunk_id, shard
from ..operators.chunking import chunked


def new_ids(documents: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream (path, content, time) as a stream of ids not seen within the watermark: chunk_id, size, time."""
    rows = documents.select(time, F.octet_length("content").cast("long").alias("size"), chunk_id(F.col("content")).alias("chunk_id"))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["chunk_id"])


def store_stream(documents: DataFrame, folder: str, checkpoint: str, codec: str = "zstd", average: int = 0) -> StreamingQuery:
    """Start storing a stream (path, content) below ``folder``; rows of chunks as a vault holds them."""
    tag = tag_of(codec)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = chunked(batch, average, with_data=True).dropDuplicates(["chunk_id"])
        jvm = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            rows = rows.join(spark.read.parquet(folder).select("chunk_id"), "chunk_id", "left_anti")
        out = rows.select("chunk_id", encode_chunk(F.col("data"), codec).alias("blob"), F.col("size").alias("raw_size"))
        out = out.select("chunk_id", "blob", "raw_size", F.octet_length("blob").cast("long").alias("stored_size"), F.lit(tag).alias("codec"), shard(F.col("chunk_id"), 1).alias("shard"))
        out.write.mode("append").option("compression", "none").partitionBy("shard").parquet(folder)

    return documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
