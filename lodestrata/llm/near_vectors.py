"""Embedding near-dedup (operator 6): a navigable small-world graph for each shard, queried by every vector.

1. Rows of equal vectors fold into one class (a hash aggregate over two hashes of the vector).
2. Classes are dealt to shards by a hash; each shard's graph is built in one task and written to a file in the shared
   folder, as are its vectors. Neither is ever a row: no executor's heap, sort or shuffle holds one.
3. Every shard's vectors query every shard, by cells of a shard and a block: a task loads one graph and reads the
   vectors of one shard after another. A query whose beam is full of
   links is searched again with twice the beam, until the beam ends below the limit, so large groups are counted whole.
   A sample of each cell's queries is compared with brute force over the shard, in strata by the number of links, each
   query's own vector aside, and so is a sample of the shard's vectors turned until their cosine is the limit, so that
   every audit has links to find: where the mean recall of a query falls short of ``RECALL`` in a stratum, the cell's
   beam doubles, and after the widest the cell is scanned exactly, by blocks.
4. Links are confirmed by their cosine in double precision. A cell returns, for each query, the number of rows that it
   links to, and a spanning forest of its links: rows in proportion to its vectors however large a group is.
5. Components of the forests.

Vectors that are null, all zero, or hold null or non-finite components link with nothing; vectors of different lengths
never link. Rows that repeat an id are separate rows; a null id takes part and is the smallest of a component only if all
its ids are null.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stage, work_path
from .components import components
from .hnsw import Graph
from .topk import usable

LIMIT = 0.95
#: Classes of one shard and of one block of queries; least number of shards, so that a small table still spreads.
SHARD, BLOCK, SHARDS = 50_000, 10_000, 6
BEAM, WIDEST, RECALL, AUDIT = 32, 256, 0.98, 128


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1)[:, None].astype(np.float64)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    return v


def _confirmed(q: np.ndarray, v: np.ndarray, ids: np.ndarray, sims: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the candidates whose cosine in double precision reaches the limit."""
    at, slot = np.nonzero((sims >= limit - 1e-4) & (ids >= 0))
    to = ids[at, slot]
    keep = np.concatenate([np.einsum("nd,nd->n", q[at[i : i + 65536]], v[to[i : i + 65536]]) for i in range(0, len(at), 65536)] or [np.empty(0)]) >= limit
    return at[keep], to[keep]


def _found(graph: Graph, q: np.ndarray, v: np.ndarray, beam: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of all queries, in parts; beams that end above the limit are widened for their queries alone."""
    todo = [(np.arange(len(q)), beam)]
    while todo:
        rows, wide = todo.pop()
        wide = min(wide, len(v))
        for i in range(0, len(rows), max(16, 512 * BEAM // wide)):
            part = rows[i : i + max(16, 512 * BEAM // wide)]
            ids, sims = graph.search(q[part].astype(np.float32), wide)
            full = (sims[:, -1] >= limit - 1e-4) & (wide < len(v))
            if full.any():
                todo.append((part[full], 2 * wide))
            at, to = _confirmed(q[part], v, ids, np.where(full[:, None], -np.inf, sims), limit)
            yield part[at], to


def _roots(n: int, links: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))
    for a, b in links:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
    for i in range(n):
        up[i] = up[up[i]]
    return up


def _scanned(q: np.ndarray, v: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of all queries by brute force, in parts."""
    size = max(16, min(512, (1 << 23) // max(1, len(v))))
    for i in range(0, len(q), size):
        at, to = np.nonzero(q[i : i + size] @ v.T >= limit - 1e-9)
        for low in range(0, len(at), 65536):
            a, t = at[low : low + 65536] + i, to[low : low + 65536]
            keep = np.einsum("nd,nd->n", q[a], v[t]) >= limit
            yield a[keep], t[keep]


def _turned(v: np.ndarray, limit: float) -> np.ndarray:
    """Each vector turned in a seeded direction until its cosine with itself is just within the limit: the farthest link."""
    away = np.random.default_rng(1).standard_normal(v.shape)
    away -= np.einsum("nd,nd->n", away, v)[:, None] * v
    length = np.sqrt((away * away).sum(axis=1))[:, None]
    near = min(limit + 1e-6, 1.0)
    turned = near * v + np.sqrt(1 - near * near) * away / np.maximum(length, 1e-9)
    return np.where(length > 1e-9, turned, v)


def _recalled(rep: np.ndarray, graph: Graph, q_rep: np.ndarray, q: np.ndarray, v: np.ndarray, limit: float, beam: int) -> bool:
    """Whether the beam finds ``RECALL`` of a query's links on average, in each stratum of queries by number of links."""
    links = np.concatenate([((q[i : i + 32] @ v.T >= limit) & (q_rep[i : i + 32, None] != rep)).sum(axis=1) for i in range(0, len(q), 32)])
    got = np.zeros(len(q), np.int64)
    for at, to in _found(graph, q, v, beam, limit):
        other = q_rep[at] != rep[to]
        np.add.at(got, at[other], 1)
    recall = np.minimum(got / np.maximum(links, 1), 1.0)
    stratum = np.ceil(np.log2(links + 1)).astype(np.int64)
    return all(recall[stratum == s].mean() >= RECALL for s in np.unique(stratum) if s)


def _passes(rep: np.ndarray, graph: Graph, q_rep: np.ndarray, q: np.ndarray, v: np.ndarray, limit: float, beam: int) -> bool:
    """The audit of a beam: on the links of the queries given, and on as many vectors of the shard, turned to the limit, so
    that there are links to find where the queries have none."""
    spread = np.unique(np.linspace(0, len(v) - 1, min(AUDIT, len(v))).astype(np.int64))
    planted = _turned(v[spread], limit)
    return _recalled(rep, graph, q_rep, q, v, limit, beam) and _recalled(rep, graph, np.full(len(planted), -1, np.int64), planted, v, limit, beam)


def search_cell(rep: np.ndarray, count: np.ndarray, graph: Graph, q_rep: np.ndarray, q: np.ndarray, v: np.ndarray, limit: float, beam: int = BEAM) -> pd.DataFrame:
    """Rows (a, b, n): for each query with links one to a linked node and the rows linked (n), then links among nodes
    that queries tied together (n is 0)."""
    audited = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64))
    while beam <= min(WIDEST, len(v) - 1) and not _passes(rep, graph, q_rep[audited], q[audited], v, limit, beam):
        beam *= 2
    parts = _found(graph, q, v, beam, limit) if beam <= min(WIDEST, len(v) - 1) else _scanned(q, v, limit)
    n_links = np.zeros(len(q), np.int64)
    some = np.full(len(q), -1, np.int64)
    up = np.arange(len(v))
    for at, to in parts:
        other = q_rep[at] != rep[to]
        at, to = at[other], to[other]
        np.add.at(n_links, at, count[to])
        first = np.unique(at, return_index=True)[1]
        some[at[first]] = to[first]
        ends = np.stack((up[some[at]], up[to]), axis=1)
        ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
        if len(ends):
            up = np.array(_roots(len(v), [*enumerate(up.tolist()), *map(tuple, ends.tolist())]))
    linked = np.flatnonzero(some >= 0)
    tied = np.flatnonzero(up != np.arange(len(v)))
    return pd.DataFrame({"a": np.concatenate((q_rep[linked], rep[tied])), "b": np.concatenate((rep[some[linked]], rep[up[tied]])), "n": np.concatenate((n_links[linked], np.zeros(len(tied), np.int64)))})


def _build(folder: str):
    """A shard's classes to two files in ``folder``: its vectors and its graph."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        v = np.array(pdf["v"].tolist(), np.float64)
        with np.errstate(over="ignore"):
            short = v.astype(np.float32)
        held = io.BytesIO()
        np.savez(held, rep=pdf["rep"].to_numpy(np.int64), count=pdf["count"].to_numpy(np.int64), v=short if (short == v).all() else v)
        graph = Graph.build(_unit(v).astype(np.float32)).dump(vectors=False)
        name = f"{key[0]}-{uuid.uuid4().hex[:12]}"  # a task that runs again leaves the files of the first alone
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        for kind, data in (("rows", held.getbuffer()), ("graph", graph)):
            with fs.open_output_stream(f"{root}/{name}.{kind}") as f:
                f.write(data)
        return pd.DataFrame({"shard": [key[0]], "name": [name]})

    return run


def _read(folder: str, name: str, kind: str) -> bytes:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}.{kind}") as f:
        return f.read()


def _rows(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(_read(folder, name, "rows"))) as z:
        return z["rep"], z["count"], _unit(z["v"])


def _searched(folder: str, names: list[str], parts: int, limit: float):
    """Numbers of tasks to links: task i searches the shard ``i // parts`` for the vectors of each ``parts``-th shard, which
    it reads from the files one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i in (int(x) for b in batches for x in b["id"]):
            rep, count, v = _rows(folder, names[i // parts])
            graph = Graph.load(_read(folder, names[i // parts], "graph"), v.astype(np.float32))
            for name in names[i % parts :: parts]:
                q_rep, _, q = _rows(folder, name)
                blocks = -(-len(q) // BLOCK)
                for j in range(blocks):
                    yield search_cell(rep, count, graph, q_rep[j::blocks], q[j::blocks], v, limit)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = LIMIT, shard_size: int = SHARD) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, first (one row of each component)."""
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    good = usable(F.col(vector_col)) & F.coalesce(F.exists(F.col(vector_col), lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.when(good, v).alias("v"))
    rows = stage(rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.xxhash64(F.lit(1), "v"), "d": F.size("v")}), "rows")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    classes = rows.where("h1 is not null").groupBy("h1", "h2", "d").agg(least, F.count("*").alias("count")).select("h1", "h2", F.col("least.row").alias("rep"), "least", "count")
    classes = stage(classes, "classes")
    reps = rows.select(F.col("row").alias("rep"), "v", "d").join(classes.select("rep", "count"), "rep")
    sizes = {r["d"]: r["n"] for r in reps.groupBy("d").agg(F.count("*").alias("n")).collect()}

    found = None
    for d, n in sorted(sizes.items()):
        part = _search_length(reps.where(F.col("d") == d), n, limit, shard_size)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    found = stage(found, "links")
    labels = components(found, "a", "b").withColumnRenamed("node", "rep")
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = classes.join(labels, "rep", "left").join(linked, "rep", "left")
    heads = joined.where("label is not null").groupBy("label").agg(F.min("least").alias("head"))
    joined = joined.join(heads, "label", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n"), F.coalesce("head", "least").alias("head"))
    out = rows.select("id", "row", "h1", "h2").join(stage(joined, "joined"), ["h1", "h2"], "left")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).cast(kind).alias("component_id"), (F.col("head").isNull() | (F.col("row") == F.col("head.row"))).alias("first"))


def _search_length(reps: DataFrame, n: int, limit: float, shard_size: int) -> DataFrame:
    spark, folder = reps.sparkSession, work_path(reps.sparkSession, "graphs")
    shards = max(SHARDS, -(-n // shard_size))
    dealt = reps.select("rep", "count", "v", F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(shards)).cast("int").alias("shard"))
    built = stage(dealt.groupBy("shard").applyInPandas(_build(folder), "shard int, name string"), "built")
    names = [r["name"] for r in built.orderBy("shard").collect()]
    parts = min(SHARDS, len(names))
    tasks = spark.range(0, len(names) * parts, 1, len(names) * parts)
    return tasks.mapInPandas(_searched(folder, names, parts, limit), "a long, b long, n long")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors: vec_id, n_links, component_id, kept."""
    found = near_vectors(load(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP6_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
