"""Exact top-k search (operator 5): norm-sorted inner products with bounds.

Vectors are turned into integers and sorted into blocks by descending length, by a range shuffle. A rotation that puts
most of the length into the first components (from the singular vectors of a bounded sample; any rotation is exact, a
good one prunes more) is applied to vectors and queries. The sample and some of the longest vectors give every query a
first lower bound for its k-th best score. Queries are written once, with their bounds, to the shared folder. Then each
block is one task: it holds its vectors, reads the queries in groups of bounded size, and for each group through its vectors in
descending length: a query whose bound is above length times length is done with the block; of the others, partial sums
over the first 16, then 32 rotated components plus the product of the lengths of the rest (Cauchy-Schwarz) drop vectors
and queries; for those left the integer products are computed exactly (in doubles while they are below 2^53), and the
bound rises.

Vectors are shuffled once and queries are read by each block, so nothing is sent in proportion to blocks times groups. A
block returns k rows a query at most, and only those that reach its bound. The closures hold the rotation and the
sample and the long vectors, bounded in number and bytes; in which order tasks run changes no score.

Vectors that are null or hold null or non-finite components are neither queries nor candidates. An empty table, or one
without queries, gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, stage, work_path

#: Vectors of one block and queries of one file on average, and bytes of either that they stay within.
BLOCK, GROUP, BYTES = 65_536, 2_048, 64 << 20
#: Least number of blocks, so that a small table still spreads.
BLOCKS = 6
#: Vectors that the rotation is fitted on, and of which the first bounds are taken; bytes that either stays within.
SAMPLE, LONGEST, HELD = 4_096, 1_024, 16 << 20
CHUNK, HEADS = 1_024, (16, 32)
#: Shares of the rows, of which one is taken to find long vectors.
_SHARES = [1.0, 0.1, 0.01, 0.001, 0.0001]
_EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), d)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of each row of a with each of b, rows of whole numbers, held within the range of a long."""
    if a.size == 0 or b.size == 0 or a.shape[1] * max(1.0, np.abs(a).max()) * max(1.0, np.abs(b).max()) < _EXACT:
        return (a @ b.T).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    whole = [[int(x) for x in r] for r in b]
    return np.array([[min(high, max(low, sum(x * y for x, y in zip(p, q, strict=True)))) for q in whole] for p in ([int(x) for x in r] for r in a)], np.int64)


class _Turned:
    """Rows, turned, with their lengths and the lengths of what lies beyond each head."""

    def __init__(self, v: np.ndarray, rotation: np.ndarray) -> None:
        self.v, d = v, len(rotation)
        heads = [h for h in HEADS if h < d] or [d]
        turned = v @ rotation
        self.head = turned[:, : heads[-1]].copy()
        square = turned * turned
        self.rest = [np.sqrt(square[:, h:].sum(axis=1)) for h in heads]
        self.heads = heads
        self.norm = np.sqrt((v * v).sum(axis=1))


def search(q: _Turned, q_row: np.ndarray, bound: np.ndarray, v: _Turned, v_row: np.ndarray, v_id: np.ndarray, v_null: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best of a block for each query, as far as they reach its bound, which rises.

    Vectors stand in descending length. Ties go to the smaller id, a null id last, then to the smaller row.
    """
    at = to = score = np.empty(0, np.int64)
    active = np.arange(len(bound))
    for low in range(0, len(v.norm), CHUNK):
        cut = slice(low, low + CHUNK)
        most = q.norm[active] * v.norm[low]
        active = active[~(most + 1e-9 * (1.0 + most) < bound[active])]
        if not len(active):
            break
        some, near = active, np.arange(low, min(low + CHUNK, len(v.norm)))
        slack = 1e-9 * (1.0 + q.norm[:, None][some] * v.norm[low])
        for h, q_rest, v_rest in zip(q.heads, q.rest, v.rest, strict=True):
            over = ~(q.head[some, :h] @ v.head[near, :h].T + np.outer(q_rest[some], v_rest[near]) + slack < bound[some][:, None])
            rows, columns = over.any(axis=1), over.any(axis=0)
            some, near, slack = some[rows], near[columns], slack[rows]
            if not len(some):
                break
        if not len(some):
            continue
        got = _products(q.v[some], v.v[near])
        r, c = np.nonzero((got >= bound[some][:, None]) & (q_row[some][:, None] != v_row[near][None, :]))
        if not len(r):
            continue
        at, to, score = np.concatenate((at, some[r])), np.concatenate((to, near[c])), np.concatenate((score, got[r, c]))
        order = np.lexsort((v_row[to], v_id[to], v_null[to], ~score, at))
        at = at[order]
        start = np.searchsorted(at, at)
        keep = np.arange(len(at)) - start < k
        at, to, score = at[keep], to[order][keep], score[order][keep]
        full, first, number = np.unique(at, return_index=True, return_counts=True)
        last = (first + number - 1)[number == k]
        bound[full[number == k]] = np.maximum(bound[full[number == k]], score[last].astype(np.float64))
    return at, to, score


def _first_bounds(q: np.ndarray, q_row: np.ndarray, longest: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th best product with the longest vectors, the query itself aside; -inf where they are fewer."""
    out = np.full(len(q), -np.inf)
    for low in range(0, len(q), 512):
        got = _products(q[low : low + 512], longest).astype(np.float64)
        got[q_row[low : low + 512][:, None] == rows[None, :]] = -np.inf
        if got.shape[1] >= k:
            out[low : low + 512] = np.partition(got, got.shape[1] - k, axis=1)[:, got.shape[1] - k]
    return out


def _bounded(k: int, d: int, held: np.ndarray, rows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = _first_bounds(_matrix(batch.column(1), d), batch.column(0).to_numpy(), held, rows, k)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bound, pa.float64())], ["row", "v", "bound"])

    return run


def _searched(folder: str, rotation: np.ndarray, k: int, group: int):
    """A block's vectors (row, id, v) to (query, row, id, score), the queries read from ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(rotation)
        held = [(b.column(0).to_numpy(), b.column(1), _matrix(b.column(2), d)) for b in batches if len(b)]
        if not held:
            return
        v_row, matrix = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
        v_id = pa.concat_arrays([h[1] for h in held])
        v_null, v_id = v_id.is_null().to_numpy(zero_copy_only=False), v_id.fill_null(0).to_numpy()
        del held
        order = np.lexsort((v_row, -(matrix * matrix).sum(axis=1)))
        v_row, v_id, v_null = v_row[order], v_id[order], v_null[order]
        v = _Turned(matrix[order], rotation)
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
            if not info.base_name.startswith("part-"):
                continue
            with fs.open_input_file(info.path) as f:
                for asked in pq.ParquetFile(f).iter_batches(group):
                    q_row = asked.column("row").to_numpy()
                    bound = asked.column("bound").to_numpy(zero_copy_only=False).copy()
                    at, to, score = search(_Turned(_matrix(asked.column("v"), d), rotation), q_row, bound, v, v_row, v_id, v_null, k)
                    yield pa.record_batch([pa.array(q_row[at]), pa.array(v_row[to]), pa.array(v_id[to], mask=v_null[to]), pa.array(score)], ["query", "row", "id", "score"])

    return run


def top_products(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """For each usable row that ``is_query`` its k highest integer products with all other usable rows of its length.

    Returns query_id, rank, id, score. Components become floor(scale * x). Rows that repeat an id are separate rows:
    each is a query of its own, and a candidate for the other. A null id may be found, after all others of its score.
    """
    spark = vectors.sparkSession
    value = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), value.alias("v"), F.monotonically_increasing_id().alias("row"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = stage(rows.withColumns({"d": F.size("v"), "norm": norm}), "whole")
    ends = F.percentile_approx("norm", F.array(*[F.lit(1 - x) for x in _SHARES])).alias("ends")
    found = None
    for r in sorted(rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), ends).collect()):
        if r["q"]:
            part = _search_length(rows.where(F.col("d") == r["d"]), r["d"], r["n"], r["ends"], k)
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    best = found.select("query", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)
    asked = rows.where("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.join(asked, "query").select("query_id", "rank", "id", "score")


def _search_length(rows: DataFrame, d: int, n: int, ends: list[float], k: int) -> DataFrame:
    spark, bytes_ = rows.sparkSession, 8 * max(1, d)
    lot = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)
    size, long = min(SAMPLE, HELD // bytes_ + 1), min(LONGEST, HELD // bytes_ + 1)
    sample = rows.where(lot < min(1.0, size / n)).select("row", "v").limit(2 * size).collect()
    least = next((e for s, e in zip(reversed(_SHARES), reversed(ends), strict=True) if s * n >= long), ends[0])
    held = {r["row"]: r["v"] for r in [*sample, *rows.where(F.col("norm") >= least).select("row", "v").limit(long).collect()]}
    matrix = np.array(list(held.values()), np.float64).reshape(len(held), d)
    rotation = np.linalg.svd(matrix[: len(sample)], full_matrices=True)[2].T if sample and d and np.isfinite(matrix).all() else np.eye(d)
    folder, group = work_path(spark, "queries"), max(1, min(GROUP, BYTES // bytes_))
    rows.where("asks").select("row", "v").mapInArrow(_bounded(k, d, matrix, np.array(list(held), np.int64)), "row long, v array<double>, bound double").write.parquet(folder)
    blocks = max(BLOCKS, -(-n // max(1, min(BLOCK, BYTES // bytes_))))
    dealt = rows.repartitionByRange(blocks, F.desc("norm"), "row").select("row", "id", "v")
    return stage(dealt.mapInArrow(_searched(folder, rotation, k, group), "query long, row long, id long, score long"), "found")


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every query: query_id, rank, vec_id, score."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = top_products(vectors, "vec_id", "embedding", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
