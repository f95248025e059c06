"""Which chunks are new, which files can be reused: equi-joins and aggregates that Catalyst plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_writers(chunks: DataFrame) -> DataFrame:
    """Every chunk reference with was_new: of the references to one id, the first by (path, seq) is its writer.

    The first is found by a minimum, which sums up map-side, so an id that very many files share is no hot window.
    """
    first = chunks.groupBy("chunk_id").agg(F.min(F.struct("path", "seq")).alias("first"))
    return chunks.join(first, "chunk_id").withColumn("was_new", F.struct("path", "seq") == F.col("first")).drop("first")


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One reference for each id that the store lacks: chunk_id, path, offset, size."""
    first = chunks.groupBy("chunk_id").agg(F.min(F.struct("path", "seq", "offset", "size")).alias("first"))
    return first.join(stored.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "first.path", "first.offset", "first.size")


def incremental_status(current: DataFrame, parent: DataFrame) -> DataFrame:
    """Current files with status and, where unchanged, the parent's chunks.

    A file is reused if the parent has its path with equal size and time; mode and content are not looked at. Otherwise
    it is new or changed.
    """
    p = parent.select("path", F.col("size").alias("p_size"), F.col("mtime_ns").alias("p_mtime"), F.col("chunks").alias("p_chunks"), F.lit(True).alias("known"))
    same = F.col("known") & (F.col("p_size") == F.col("size")) & (F.col("p_mtime") == F.col("mtime_ns"))
    status = F.when(F.col("known").isNull(), "new").when(same, "reused").otherwise("changed")
    return current.join(p, "path", "left").withColumn("status", status).withColumn("chunks", F.when(F.col("status") == "reused", F.col("p_chunks"))).drop("p_size", "p_mtime", "p_chunks", "known")


def parent_snapshot(snapshots: DataFrame, source: str | None = None) -> DataFrame:
    """Newest snapshot of each source, by exact equality of the source's name: source, snapshot_id."""
    rows = snapshots if source is None else snapshots.where(F.col("source") == source)
    return rows.groupBy("source").agg(F.max("snapshot_id").alias("snapshot_id"))


def manifest(refs: DataFrame, *keys: str) -> DataFrame:
    """Ordered chunk ids of each file: the keys (by default path), size, chunks."""
    keys = keys or ("path",)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"])
    return refs.groupBy(*keys).agg(F.sum("size").cast("long").alias("size"), ordered.alias("chunks"))


def references(files: DataFrame) -> DataFrame:
    """Chunk references of manifests: snapshot_id, path, seq, chunk_id. Files without chunks have none."""
    return files.select("snapshot_id", "path", F.posexplode("chunks").alias("seq", "chunk_id"))


def unique_refs(chunk_lists: Column) -> Column:
    """Distinct ids of lists of chunks, in the order in which they are first seen."""
    return F.array_distinct(F.flatten(chunk_lists))


def presence(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct ids with present: whether the store has them."""
    return ids.select("chunk_id").distinct().join(stored.select("chunk_id").distinct().withColumn("there", F.lit(True)), "chunk_id", "left").select("chunk_id", F.col("there").isNotNull().alias("present"))


def backup_result(files: DataFrame, refs: DataFrame) -> DataFrame:
    """One row of counts. files: status; refs: size, was_new, stored_size, for the chunks of files that were not reused."""
    f = files.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "reused").alias("reused"))
    c = refs.agg(
        F.count("*").alias("total_chunks"),
        F.count_if("was_new").alias("new_chunks"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("was_new"), F.col("stored_size"))), F.lit(0)).cast("long").alias("stored_bytes"),
    )
    return f.crossJoin(c)


def stats(snapshots: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: snapshots, unique_chunks, stored_bytes (all chunks, orphans too), logical_bytes, chunk_refs."""
    s = snapshots.agg(F.count("*").alias("snapshots"))
    c = chunks.agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("stored_size"), F.lit(0)).cast("long").alias("stored_bytes"))
    f = files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("logical_bytes"), F.coalesce(F.sum(F.size(F.coalesce("chunks", F.array().cast("array<string>")))), F.lit(0)).cast("long").alias("chunk_refs"))
    return s.crossJoin(c).crossJoin(f)
