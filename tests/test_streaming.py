from pyspark.sql import functions as F

from lodestrata.functions.codec import decode_chunk
from lodestrata.streaming.ingest import new_ids, store_stream


def test_store_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "chunks")
    schema = "path string, content binary"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        store_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(out)

    first = run([("a", bytearray(b"one" * 100)), ("b", bytearray(b"two" * 100)), ("c", bytearray(b"one" * 100))])
    assert first.count() == 2
    second = run([("d", bytearray(b"two" * 100)), ("e", bytearray(b"three" * 100))])
    assert sorted(bytes(r[0]) for r in second.select(decode_chunk(F.col("blob"))).collect()) == [b"one" * 100, b"three" * 100, b"two" * 100]


def test_new_ids(spark, tmp_path):
    schema = "path string, content binary, ts timestamp"
    rows = [("a", bytearray(b"x"), "2024-01-01 00:00:00"), ("b", bytearray(b"x"), "2024-01-01 00:10:00"), ("c", bytearray(b"y"), "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "path string, content binary, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    q = new_ids(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ids").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select distinct chunk_id from ids").count() == spark.sql("select * from ids").count() == 2
