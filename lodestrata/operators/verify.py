"""Integrity: chunks whose bytes are not what their id says, references without a chunk, snapshots that these break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import decode_chunk
from ..functions.ids import chunk_id


def corrupt(chunks: DataFrame, plain: Column | None = None, identity=chunk_id) -> DataFrame:
    """Ids of stored chunks (chunk_id, blob) that don't decode, or decode to something else."""
    data = decode_chunk(F.col("blob")) if plain is None else plain
    rows = chunks.select("chunk_id", *[c for c in ("inner_pad", "outer_pad") if c in chunks.columns], data.alias("data"))
    return rows.where(F.col("data").isNull() | (identity(F.col("data")) != F.col("chunk_id"))).select("chunk_id")


def missing(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct referenced ids that the store lacks."""
    return refs.join(stored.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id").distinct()


def broken(refs: DataFrame, bad: DataFrame) -> DataFrame:
    """Snapshots that reference any bad id."""
    return refs.join(bad.select("chunk_id"), "chunk_id", "left_semi").select("snapshot_id").distinct()


def report(chunks: int | Column, snapshots: int | Column, corrupt_ids: DataFrame, missing_ids: DataFrame, broken_ids: DataFrame) -> DataFrame:
    """One row: chunks, snapshots, and the sorted lists corrupt, missing, broken, and ok.

    The lists hold problems only; whoever expects very many reads the three tables instead.
    """
    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(column)).alias(name))

    lists = listed(corrupt_ids, "chunk_id", "corrupt").crossJoin(listed(missing_ids, "chunk_id", "missing")).crossJoin(listed(broken_ids, "snapshot_id", "broken"))
    lift = lambda x: x if isinstance(x, Column) else F.lit(x).cast("long")
    return lists.select(lift(chunks).alias("chunks"), lift(snapshots).alias("snapshots"), "corrupt", "missing", "broken", ((F.size("corrupt") == 0) & (F.size("missing") == 0)).alias("ok"))
