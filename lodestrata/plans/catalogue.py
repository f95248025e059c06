"""Every operator as a query over the driver's tables, and the SQL that says the same.

Documents are a file tree: a path from source, language and id, the UTF-8 bytes of the text, a time from the id. Two
snapshots of it follow from fixed rules on the id: the parent lacks some files and holds others with another size.
Conversations are files of several chunks, one for each turn, where a query needs the order of chunks and SQL must be
able to follow. At the default average every document is one chunk by the engine's own rule (no document of the driver's
tables reaches the least size), so SHA-256 of the text is its only chunk id; queries at small averages are compared by
what must hold of any cut: reassembly, bounds, stability.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, display, ids, paths, seal
from ..operators import dedup, gear, verify
from ..operators.chunking import chunked, chunked_files
from ..sources.object_store import NotFound
from ..sources.tree import local_path, size_prescan, skipped
from ..sources.tree import scan_tree as read_tree
from .vault import Vault, is_encrypted

SMALL = 1024
#: A key for the tests of keyed names; it protects nothing.
TEST_KEY = b"key of the catalogue's keyed ids"
BITS = 12

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# The tree that documents are, and its parent snapshot

_PATH = "coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
_TREE = f"SELECT doc_id, {_PATH} AS path, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, doc_id * 1000 AS mtime_ns FROM documents"
_IDS = f"SELECT *, sha256(text) AS chunk_id FROM ({_TREE})"


def tree(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"), *more)


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the tree at the default average, by the expression: a document below the least size is one chunk."""
    least = gear.Sizes.of().least
    t = tree(spark, sf_dir)
    small = t.where(F.col("size").between(1, least)).select("path", F.lit(0).alias("seq"), F.lit(0).cast("long").alias("offset"), "size", ids.chunk_id(F.col("content")).alias("chunk_id"))
    large = chunked(t.where(F.col("size") > least))
    return small.unionByName(large.select(*small.columns))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files, a chunk for each turn."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    data = F.coalesce("text", F.lit("")).cast("binary")
    return t.select("conv_id", F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").cast("int").alias("seq"), F.octet_length(data).cast("long").alias("size"), ids.chunk_id(data).alias("chunk_id"))


_TURNS = "SELECT conv_id, 'conv/' || CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INTEGER) AS seq, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS chunk_id FROM conversations"


# Sources: the documents as files in a shared folder, and a vault that holds two runs over them

RUNS = ("20240101T000000Z-00000001", "20240101T000001Z-00000002")
_built: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[str], object]) -> str:
    """A local folder that all executors mount, filled by ``make`` once for each session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestrata-")
        path = f"{local_path(base)}/catalogue/{what}-{uuid.uuid4().hex}"
        os.makedirs(path)
        make(path)
        _built[key] = path
    return _built[key]


def _tree_folder(spark: SparkSession, sf_dir: str) -> str:
    def make(root: str) -> None:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content, when in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    name = os.path.join(root, path)
                    os.makedirs(os.path.dirname(name), exist_ok=True)
                    with open(name, "wb") as f:
                        f.write(content)
                    os.utime(name, ns=(when, when))
                yield batch.select([0])

        tree(spark, sf_dir).select("path", "content", "mtime_ns").mapInArrow(write, "path string").count()

    return _once(spark, sf_dir, "tree", make)


def _vault(spark: SparkSession, sf_dir: str, passphrase: str | None = None) -> Vault:
    """Two runs over the tree, the second of which finds nothing changed; the encrypted vault has the first alone."""
    root = _tree_folder(spark, sf_dir)

    def make(path: str) -> None:
        vault = Vault.open(spark, path, passphrase, create=True)
        for name in RUNS[: 1 if passphrase else 2]:
            done = vault.backup(root, "none", snapshot_id=name)
            vault.folder.put(f"results/{name}.json", json.dumps(asdict(done)).encode())

    return Vault.open(spark, _once(spark, sf_dir, "sealed" if passphrase else "vault", make), passphrase)


def _files_with_ids(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder with the chunk that each is; empty ones have none."""
    found = read_tree(spark, root).where("kind = 'file'").select("path", "size")
    return found.join(chunked_files(found, "file://" + root).select("path", "chunk_id"), "path", "left")


_TWO = "(VALUES " + ", ".join(f"('{x}')" for x in RUNS) + ") AS s(snapshot_id)"
_FOLDERS = f"SELECT DISTINCT split_part(path, '/', 1) AS path FROM ({_TREE}) UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM ({_TREE})"
_HELD = f"SELECT DISTINCT chunk_id, size FROM ({_IDS}) WHERE size > 0"


@query(f"SELECT path, 'file' AS kind, size, mtime_ns FROM ({_TREE}) UNION ALL SELECT path, 'dir', CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM ({_FOLDERS})")
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file tree as the data source reads it."""
    return read_tree(spark, _tree_folder(spark, sf_dir)).select("path", "kind", "size", F.when(F.col("kind") == "file", F.col("mtime_ns")).otherwise(-1).alias("mtime_ns"))


@query(f"SELECT path, size, CASE WHEN size > 0 THEN chunk_id END AS chunk_id FROM ({_IDS})")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read and named where they lie."""
    return _files_with_ids(spark, _tree_folder(spark, sf_dir))


@query(f"SELECT snapshot_id, files, CASE WHEN snapshot_id = '{RUNS[0]}' THEN 0 ELSE files END AS reused, CASE WHEN snapshot_id = '{RUNS[0]}' THEN refs ELSE 0 END AS total_chunks, CASE WHEN snapshot_id = '{RUNS[0]}' THEN unique_chunks ELSE 0 END AS new_chunks, CASE WHEN snapshot_id = '{RUNS[0]}' THEN bytes ELSE 0 END AS total_bytes, CASE WHEN snapshot_id = '{RUNS[0]}' THEN stored ELSE 0 END AS stored_bytes, CAST(0 AS BIGINT) AS skipped FROM {_TWO}, (SELECT count(*) AS files, count(*) FILTER (size > 0) AS refs, CAST(sum(size) AS BIGINT) AS bytes, (SELECT count(*) FROM ({_HELD})) AS unique_chunks, (SELECT CAST(sum(size + 1) AS BIGINT) FROM ({_HELD})) AS stored FROM ({_IDS}))")
def vault_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full run and one over unchanged files say that they did."""
    vault = _vault(spark, sf_dir)
    rows = [json.loads(vault.folder.get(f"results/{x}.json")) for x in RUNS]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'string' if k == 'snapshot_id' else 'long'}" for k in rows[0]))


@query(f"SELECT 'chunks/' || substr(chunk_id, 1, 2) || '/' || chunk_id AS key, size, size + 1 AS stored FROM ({_HELD})")
def list_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the vault holds, stored plain after their tag byte."""
    return _vault(spark, sf_dir).stored().select(ids.chunk_key(F.col("chunk_id")).alias("key"), F.col("raw_size").alias("size"), F.col("stored_size").alias("stored"))


@query(f"SELECT min(chunk_id) AS chunk_id, min(chunk_id) AS content_sha256, true AS other_is_absent FROM ({_HELD})")
def get_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = _vault(spark, sf_dir)
    name = vault.stored().agg(F.min("chunk_id")).first()[0]
    try:
        vault.get_chunk("0" * 64)
        absent = False
    except NotFound:
        absent = True
    return spark.createDataFrame([(name, hashlib.sha256(vault.get_chunk(name)).hexdigest(), absent)], "chunk_id string, content_sha256 string, other_is_absent boolean")


@query(f"SELECT snapshot_id, path, size, mtime_ns, CASE WHEN size > 0 THEN chunk_id ELSE '' END AS chunks FROM {_TWO}, ({_IDS})")
def load_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of the snapshots that the vault lists and loads."""
    vault = _vault(spark, sf_dir)
    loaded = spark.createDataFrame([(vault.load_snapshot(x)["id"],) for x in vault.list_snapshots()], "snapshot_id string")
    return vault.files().join(loaded, "snapshot_id").select("snapshot_id", "path", "size", "mtime_ns", F.array_join("chunks", ",").alias("chunks"))


@query(f"SELECT snapshot_id, path FROM {_TWO}, ({_FOLDERS})")
def snapshot_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vault(spark, sf_dir).dirs().select("snapshot_id", "path")


@query(f"SELECT snapshot_id FROM {_TWO}")
def list_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vault(spark, sf_dir).snapshots().select("snapshot_id")


@query(f"SELECT count(*) AS snapshots, any_value(c) AS unique_chunks, any_value(st) AS stored_bytes, CAST(sum(b) AS BIGINT) AS logical_bytes, CAST(sum(r) AS BIGINT) AS chunk_refs FROM {_TWO}, (SELECT (SELECT count(*) FROM ({_HELD})) AS c, (SELECT CAST(sum(size + 1) AS BIGINT) FROM ({_HELD})) AS st, sum(size) AS b, count(*) FILTER (size > 0) AS r FROM ({_IDS}))")
def vault_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _vault(spark, sf_dir).stats()
    return spark.createDataFrame([tuple(asdict(s).values())], ", ".join(f"{k} long" for k in asdict(s)))


@query(f"SELECT quick, count(*) AS chunks, CAST(2 AS BIGINT) AS snapshots, true AS ok FROM ({_HELD}), (VALUES (true), (false)) AS q(quick) GROUP BY 1")
def vault_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = _vault(spark, sf_dir)
    rows = [(q, r.chunks, r.snapshots, r.ok) for q in (True, False) for r in [vault.verify(quick=q)]]
    return spark.createDataFrame(rows, "quick boolean, chunks long, snapshots long, ok boolean")


@query(f"SELECT path, size, CASE WHEN size > 0 THEN chunk_id END AS chunk_id FROM ({_IDS})")
def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the vault writes back, as they are read from the folder."""
    vault = _vault(spark, sf_dir)
    return _files_with_ids(spark, _once(spark, sf_dir, "restored", lambda path: vault.restore(RUNS[1], path)))


@query(f"SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ({_IDS})")
def restore_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault, done = _vault(spark, sf_dir), {}
    _once(spark, sf_dir, "restored-again", lambda path: done.update(vault.restore(RUNS[0], path), path=path))
    done = done or vault.restore(RUNS[0], _built[spark.sparkContext.applicationId, sf_dir, "restored-again"])
    return spark.createDataFrame([(done["files"], done["bytes"])], "files long, bytes long")


@query(f"SELECT path, CASE WHEN size > 0 THEN chunk_id END AS content_sha256, true AS sealed, true AS other_word_refused FROM ({_IDS})")
def encrypted_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encrypted vault gives back under the right passphrase alone."""
    vault = _vault(spark, sf_dir, "a word")
    try:
        Vault.open(spark, vault.folder.root, "another")
        refused = False
    except seal.WrongPassphrase:
        refused = True
    rows = vault.contents(RUNS[0]).select("path", F.sha2("data", 256).alias("content_sha256"))
    return rows.withColumns({"sealed": F.lit(is_encrypted(spark, vault.folder.root)), "other_word_refused": F.lit(refused)})


@query(f"SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes FROM ({_TREE})")
def size_prescan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_prescan(tree(spark, sf_dir).withColumn("kind", F.lit("file")))


@query(f"SELECT count(*) FILTER (doc_id % 17 = 0) AS skipped, count(*) FILTER (doc_id % 17 <> 0) AS files FROM ({_TREE})")
def skip_non_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a rule that makes some entries links."""
    return skipped(tree(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 17 == 0, "other").otherwise("file")))


_SNAPS = "SELECT doc_id, strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 3600), '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS snapshot_id, source FROM documents"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    when = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")) + F.col("doc_id") * 3600)
    name = F.concat(F.date_format(when, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8))
    return docs.select("doc_id", name.alias("snapshot_id"), "source")


@query(f"SELECT snapshot_id, strftime(strptime(substr(snapshot_id, 1, 16), '%Y%m%dT%H%M%SZ'), '%Y-%m-%d %H:%M:%S') AS created FROM ({_SNAPS}) WHERE doc_id % 5 <> 0")
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots among keys of which some are nested deeper or have another ending."""
    s = _snapshots(spark, sf_dir)
    key = F.when(F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("snapshots/old/"), "snapshot_id", F.lit(".json"))).otherwise(F.concat(F.lit("snapshots/"), "snapshot_id", F.lit(".json.tmp")))).otherwise(ids.snapshot_key(F.col("snapshot_id")))
    found = s.select(ids.snapshot_id_of(key).alias("snapshot_id")).where("snapshot_id is not null")
    return found.withColumn("created", F.date_format(ids.snapshot_time(F.col("snapshot_id")), "yyyy-MM-dd HH:mm:ss")).orderBy("snapshot_id")


@query(f"SELECT snapshot_id, source, doc_id % 9 <> 4 AS bound, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS n_chunks FROM ({_SNAPS})")
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests read from JSON, with null chunk lists as empty, and whether the id inside is the one asked for."""
    schema = "id string, source string, dirs array<struct<path:string,mode:bigint>>, files array<struct<path:string,size:bigint,mode:bigint,mtime:bigint,chunks:array<string>>>"
    s = _snapshots(spark, sf_dir)
    inside = F.when(F.col("doc_id") % 9 == 4, F.lit("another")).otherwise(F.col("snapshot_id"))
    chunks = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("a"), F.lit("b")))
    file = F.struct(F.lit("f").alias("path"), F.lit(1).alias("size"), F.lit(420).alias("mode"), F.lit(5).alias("mtime"), chunks.alias("chunks"))
    text = F.to_json(F.struct(inside.alias("id"), "source", F.array(file).alias("files")), {"ignoreNullFields": "false"})
    read = s.select("snapshot_id", F.from_json(text, schema).alias("m"))
    n = F.aggregate("m.files", F.lit(0), lambda a, f: a + F.size(F.coalesce(f["chunks"], F.array().cast("array<string>"))))
    return read.select("snapshot_id", "m.source", (F.col("m.id") == F.col("snapshot_id")).alias("bound"), n.alias("n_chunks"))


# Names


@query(f"SELECT path, chunk_id FROM ({_IDS})")
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).select("path", ids.chunk_id(F.col("content")).alias("chunk_id"))


def _pad_sql(pad: bytes) -> str:
    return f"unhex('{pad.hex()}')"


@query(f"SELECT path, sha256({_pad_sql(ids.hmac_pads(TEST_KEY)[1])} || unhex(sha256({_pad_sql(ids.hmac_pads(TEST_KEY)[0])} || encode(text)))) AS chunk_id FROM ({_TREE})")
def chunk_id_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = seal.with_keys(tree(spark, sf_dir), seal.Keys(b"\0" * 32, TEST_KEY))
    return t.select("path", ids.chunk_id_keyed(F.col("content"), F.col("inner_pad"), F.col("outer_pad")).alias("chunk_id"))


@query(f"SELECT DISTINCT chunk_id, 'chunks/' || substr(chunk_id, 1, 2) || '/' || chunk_id AS key FROM ({_IDS}) WHERE size > 0")
def chunk_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(spark, sf_dir).select("chunk_id", ids.chunk_key(F.col("chunk_id")).alias("key")).distinct()


@query(f"SELECT substr(chunk_id, 1, 2) AS shard, count(DISTINCT chunk_id) AS chunks FROM ({_IDS}) WHERE size > 0 GROUP BY 1")
def shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(spark, sf_dir).select("chunk_id").distinct().groupBy(ids.shard(F.col("chunk_id")).alias("shard")).agg(F.count("*").alias("chunks"))


# Content-defined chunking


def _gear_sql() -> str:
    """Window sums over bytes, the table written out by its rule. Only the low bits matter, so its low bits are enough."""
    table = ", ".join(str(int(v) % (1 << BITS)) for v in gear.gear_table())
    terms = " + ".join(f"coalesce(lag(g, {j}) OVER w, 0) * {1 << j}" for j in range(BITS))
    return f"""
WITH b AS (SELECT doc_id, hex(encode(text)) AS x, size FROM ({_TREE})),
e AS (SELECT doc_id, i, [{table}][1 + CAST('0x' || substr(x, 2 * i + 1, 2) AS INTEGER)] AS g FROM (SELECT doc_id, x, unnest(range(size)) AS i FROM b)),
h AS (SELECT doc_id, ({terms}) % {1 << BITS} AS h FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT b.doc_id, count(h.h) FILTER (h.h = 0) AS candidates FROM b LEFT JOIN h USING (doc_id) GROUP BY 1"""


@query(_gear_sql())
def gear_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in each document where the rolling hash's low bits are zero."""
    size = gear.Sizes(1, 1, 1, BITS, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            n = [len(gear.candidates(np.frombuffer(x, np.uint8), size)[0]) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "candidates"])

    return tree(spark, sf_dir).select("doc_id", "content").mapInArrow(run, "doc_id long, candidates long")


def _cut(spark: SparkSession, sf_dir: str, with_data: bool = False) -> DataFrame:
    return chunked(tree(spark, sf_dir), SMALL, with_data)


@query(f"SELECT path, chunk_id AS content_sha256, size FROM ({_IDS}) WHERE size > 0")
def cdc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each document put together again from its chunks."""
    joined = _cut(spark, sf_dir, True).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("c"), F.sum("size").cast("long").alias("size"))
    whole = F.aggregate("c", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["data"]))
    return joined.select("path", F.sha2(whole, 256).alias("content_sha256"), "size")


@query(f"SELECT path, size, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS too_small, true AS gapless FROM ({_TREE}) WHERE size > 0")
def cdc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes within their bounds (the last chunk may be small), offsets without gaps."""
    s = gear.Sizes.of(SMALL)
    per = _cut(spark, sf_dir).groupBy("path").agg(F.sum("size").cast("long").alias("size"), F.count_if(F.col("size") > s.most).alias("too_large"), F.max("seq").alias("last"), F.array_sort(F.collect_list(F.struct("seq", "offset", "size"))).alias("c"))
    small = F.size(F.filter("c", lambda x: (x["size"] < s.least) & (x["seq"] < F.col("last")))).cast("long")
    ends = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: F.when(a == x["offset"], a + x["size"]).otherwise(F.lit(-1).cast("long")))
    return per.select("path", "size", "too_large", small.alias("too_small"), (ends == F.col("size")).alias("gapless"))


@query()
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks at a small average. Tests hold it against a scalar walk of the same rule."""
    return _cut(spark, sf_dir)


@query(f"SELECT count(*) FILTER (size > 65536) AS files, true AS stable FROM ({_TREE})")
def cdc_insertion_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents of over 64 KiB, with 64 bytes put into the middle, at least three quarters of the chunks stay."""
    t = tree(spark, sf_dir).where("size > 65536")
    half = (F.col("size") / 2).cast("int")
    changed = F.concat(F.substring(F.col("content"), F.lit(1), half), F.lit("+" * 64).cast("binary"), F.substring(F.col("content"), half + 1, F.col("size").cast("int")))
    old = chunked(t, SMALL).select("path", "chunk_id").distinct()
    new = chunked(t.select("path", changed.alias("content")), SMALL).select("path", "chunk_id").distinct().withColumn("stays", F.lit(1))
    per = old.join(new, ["path", "chunk_id"], "left").groupBy("path").agg((F.count("stays") / F.count("*")).alias("share"))
    return per.agg(F.count("*").alias("files"), F.coalesce(F.min("share") >= 0.75, F.lit(True)).alias("stable"))


# Dedup and manifests


@query(f"SELECT CAST(count(*) AS BIGINT) AS refs, CAST(sum(size) AS BIGINT) AS logical_bytes, (SELECT count(DISTINCT chunk_id) FROM ({_IDS}) WHERE size > 0) AS unique_chunks, (SELECT CAST(sum(size) AS BIGINT) FROM (SELECT DISTINCT chunk_id, size FROM ({_IDS}) WHERE size > 0)) AS unique_bytes FROM ({_IDS}) WHERE size > 0")
def dedup_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and bytes, with and without repeats."""
    per = chunk_rows(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return per.agg(F.sum("n").alias("refs"), F.sum(F.col("n") * F.col("size")).alias("logical_bytes"), F.count("*").alias("unique_chunks"), F.sum("size").alias("unique_bytes"))


@query(f"SELECT path, seq, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY path, seq) = 1 AS was_new FROM ({_TURNS})")
def first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_writers(turns(spark, sf_dir)).select("path", "seq", "chunk_id", "was_new")


@query(f"SELECT chunk_id, min(path) AS path FROM ({_IDS}) WHERE size > 0 GROUP BY 1 HAVING NOT bool_or(doc_id % 4 = 0)")
def put_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a store which holds a quarter of the documents lacks, each once."""
    t = tree(spark, sf_dir)
    stored = t.where("doc_id % 4 = 0 and size > 0").select(ids.chunk_id(F.col("content")).alias("chunk_id"))
    return dedup.new_chunks(chunk_rows(spark, sf_dir), stored).select("chunk_id", "path")


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY path, seq) = 1 AS was_new FROM ({_TURNS}))
SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS files, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 3 = 0) AS reused,
 count(*) AS total_chunks, count(*) FILTER (was_new) AS new_chunks, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN was_new THEN size + 1 END) AS BIGINT) AS stored_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY path, seq) = 1 AS was_new FROM ({_TURNS}) WHERE conv_id % 3 <> 0)""")
def backup_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run that reuses a third of the files; chunks stored with a tag byte."""
    t = turns(spark, sf_dir)
    files = t.select("conv_id").distinct().select(F.when(F.col("conv_id") % 3 == 0, "reused").otherwise("new").alias("status"))
    refs = dedup.first_writers(t.where("conv_id % 3 <> 0")).withColumn("stored_size", F.col("size") + 1)
    return dedup.backup_result(files, refs)


@query(f"SELECT path, CAST(sum(size) AS BIGINT) AS size, string_agg(chunk_id, ',' ORDER BY seq, chunk_id) AS chunks FROM ({_TURNS}) GROUP BY 1")
def manifest_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.manifest(turns(spark, sf_dir)).select("path", "size", F.array_join("chunks", ",").alias("chunks"))


@query(f"""
WITH s AS (SELECT conv_id % 10 AS snapshot, conv_id, seq, chunk_id FROM ({_TURNS})),
f AS (SELECT snapshot, chunk_id, min((conv_id, seq)) AS first FROM s GROUP BY 1, 2)
SELECT CAST(snapshot AS BIGINT) AS snapshot, string_agg(chunk_id, ',' ORDER BY first, chunk_id) AS refs FROM f GROUP BY 1""")
def unique_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks of each of ten snapshots in the order in which they are first seen."""
    files = dedup.manifest(turns(spark, sf_dir), "conv_id")
    lists = files.groupBy((F.col("conv_id") % 10).alias("snapshot")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "chunks"))).alias("f"))
    return lists.select("snapshot", F.array_join(dedup.unique_refs(F.transform("f", lambda x: x["chunks"])), ",").alias("refs"))


# Incremental snapshots


def _parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir).where("doc_id % 10 <> 3")
    size = F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    return t.select("path", size.alias("size"), "mtime_ns", F.array(ids.chunk_id(F.col("content"))).alias("chunks"))


@query(f"SELECT path, CASE WHEN doc_id % 10 = 3 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'reused' END AS status, CASE WHEN doc_id % 10 <> 3 AND doc_id % 7 <> 0 THEN chunk_id END AS chunks FROM ({_IDS})")
def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.incremental_status(tree(spark, sf_dir).select("path", "size", "mtime_ns"), _parent(spark, sf_dir))
    return found.select("path", "status", F.array_join("chunks", ",").alias("chunks"))


@query(f"SELECT source, max(snapshot_id) AS snapshot_id FROM ({_SNAPS}) GROUP BY 1")
def parent_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.parent_snapshot(_snapshots(spark, sf_dir))


@query("SELECT source, count(*) AS files, CAST(0 AS BIGINT) AS reused_from_others, count(*) AS reused_again FROM documents WHERE source IS NOT NULL GROUP BY 1")
def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source backed up after all others into one vault: nothing is reused from them, everything the second time."""
    t = tree(spark, sf_dir, "source").where("source is not null").withColumn("snapshot_id", F.concat(F.lit("1-"), "source"))
    files = t.select("source", "snapshot_id", "path", "size", "mtime_ns", F.array(F.lit("c")).alias("chunks"))
    newest = dedup.parent_snapshot(files.select("source", "snapshot_id").distinct()).withColumnRenamed("snapshot_id", "parent")
    again = files.join(newest, "source")
    other = files.select(F.col("path"), "size", "mtime_ns", F.col("source").alias("from"), F.col("snapshot_id").alias("held"))
    met = again.join(other, ["path", "size", "mtime_ns"], "left")
    return met.groupBy("source").agg(F.count_distinct("path").alias("files"), F.count_if(F.col("held").isNotNull() & (F.col("from") != F.col("source"))).alias("reused_from_others"), F.count_if(F.col("held") == F.col("parent")).alias("reused_again"))


# Integrity. The store lacks some chunks and holds others under a wrong name, by rules on the names.

_STORE = f"SELECT DISTINCT chunk_id FROM ({_TURNS}) WHERE substr(chunk_id, 1, 1) <> '7'"
_REFS = f"SELECT 's' || CAST(conv_id % 50 AS VARCHAR) AS snapshot_id, chunk_id FROM ({_TURNS})"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as stored (tag byte, plain bytes), some missing, some changed."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = t.select(ids.chunk_id(data).alias("chunk_id"), data.alias("data")).dropDuplicates(["chunk_id"]).where(~F.col("chunk_id").startswith("7"))
    changed = F.when(F.col("chunk_id").startswith("3"), F.concat("data", F.lit("!").cast("binary"))).otherwise(F.col("data"))
    blob = F.when(F.col("chunk_id").startswith("5"), F.unhex(F.lit("09"))).otherwise(F.concat(F.unhex(F.lit("00")), changed))
    return rows.select("chunk_id", blob.alias("blob"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("conv_id") % 50).cast("string")).alias("snapshot_id"), "chunk_id")


@query(f"SELECT DISTINCT chunk_id FROM ({_TURNS}) WHERE substr(chunk_id, 1, 1) = '7'")
def verify_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.missing(_refs(spark, sf_dir), _store(spark, sf_dir))


@query(f"SELECT chunk_id FROM ({_STORE}) WHERE substr(chunk_id, 1, 1) IN ('3', '5')")
def verify_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.corrupt(_store(spark, sf_dir))


@query(f"SELECT DISTINCT snapshot_id FROM ({_REFS}) WHERE substr(chunk_id, 1, 1) IN ('3', '5', '7')")
def verify_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, store = _refs(spark, sf_dir), _store(spark, sf_dir)
    return verify.broken(refs, verify.missing(refs, store).union(verify.corrupt(store)))


@query(f"SELECT DISTINCT chunk_id, substr(chunk_id, 1, 1) <> '7' AS present FROM ({_TURNS})")
def partition_by_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.presence(_refs(spark, sf_dir), _store(spark, sf_dir))


def _report(spark: SparkSession, sf_dir: str, one: str | None, quick: bool) -> DataFrame:
    refs, store = _refs(spark, sf_dir), _store(spark, sf_dir)
    if one:
        refs = refs.where(F.col("snapshot_id") == one)
        store_here = store.join(refs.select("chunk_id"), "chunk_id", "left_semi")
    else:
        store_here = store
    bad = spark.createDataFrame([], "chunk_id string") if quick else verify.corrupt(store_here)
    lost = verify.missing(refs, store)
    rep = verify.report(0, 0, bad, lost, verify.broken(refs, bad.union(lost)))
    counts = store_here.agg(F.count("*").alias("n")).crossJoin(refs.agg(F.count_distinct("snapshot_id").alias("s")))
    joined = rep.drop("chunks", "snapshots").crossJoin(counts)
    return joined.select(F.col("n").alias("chunks"), F.col("s").alias("snapshots"), *[F.array_join(c, ",").alias(c) for c in ("corrupt", "missing", "broken")], "ok")


def _report_sql(one: str | None, quick: bool) -> str:
    where = f"WHERE snapshot_id = '{one}'" if one else ""
    here = f"SELECT chunk_id FROM ({_STORE})" + (f" WHERE chunk_id IN (SELECT chunk_id FROM r {where})" if one else "")
    bad = "false" if quick else "substr(chunk_id, 1, 1) IN ('3', '5')"
    return f"""
WITH r AS ({_REFS}), x AS (SELECT * FROM r {where}), st AS ({here}),
c AS (SELECT chunk_id FROM st WHERE {bad}), m AS (SELECT DISTINCT chunk_id FROM x WHERE substr(chunk_id, 1, 1) = '7'),
b AS (SELECT DISTINCT snapshot_id FROM x WHERE chunk_id IN (SELECT chunk_id FROM c UNION SELECT chunk_id FROM m))
SELECT (SELECT count(*) FROM st) AS chunks, (SELECT count(DISTINCT snapshot_id) FROM x) AS snapshots,
 coalesce((SELECT string_agg(chunk_id, ',' ORDER BY chunk_id) FROM c), '') AS corrupt,
 coalesce((SELECT string_agg(chunk_id, ',' ORDER BY chunk_id) FROM m), '') AS missing,
 coalesce((SELECT string_agg(snapshot_id, ',' ORDER BY snapshot_id) FROM b), '') AS broken,
 (SELECT count(*) FROM c) + (SELECT count(*) FROM m) = 0 AS ok"""


@query(_report_sql(None, False))
def verify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, None, False)


@query(_report_sql("s7", False))
def verify_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "s7", False)


@query(_report_sql(None, True))
def verify_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, None, True)


# Statistics: ten snapshots of conversations; a store that also holds the documents, which none refers to

_STATS = f"""
WITH s AS (SELECT DISTINCT conv_id % 10 AS snapshot FROM conversations), f AS (SELECT conv_id, size FROM ({_TURNS})),
c AS (SELECT DISTINCT chunk_id, size + 1 AS stored FROM (SELECT chunk_id, size FROM ({_TURNS}) UNION SELECT chunk_id, size FROM ({_IDS}) WHERE size > 0))
SELECT (SELECT count(*) FROM s) AS snapshots, (SELECT count(*) FROM c) AS unique_chunks, (SELECT CAST(coalesce(sum(stored), 0) AS BIGINT) FROM c) AS stored_bytes,
 (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM f) AS logical_bytes, (SELECT count(*) FROM f) AS chunk_refs"""


@query(_STATS)
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    files = dedup.manifest(t, "conv_id")
    held = t.select("chunk_id", "size").union(chunk_rows(spark, sf_dir).select("chunk_id", "size")).distinct().select("chunk_id", (F.col("size") + 1).alias("stored_size"))
    return dedup.stats(files.select(F.col("conv_id") % 10).distinct(), files, held)


@query(f"SELECT logical_bytes - stored_bytes AS saved_bytes FROM ({_STATS})")
def saved_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select(display.saved_bytes(F.col("logical_bytes"), F.col("stored_bytes")).alias("saved_bytes"))


@query(f"SELECT CASE WHEN logical_bytes = 0 THEN 0.0 ELSE CAST(logical_bytes - stored_bytes AS DOUBLE) / logical_bytes END AS ratio FROM ({_STATS})")
def reduction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select(display.reduction_ratio(F.col("logical_bytes"), F.col("stored_bytes")).alias("ratio"))


@query(f"""
WITH t AS (SELECT conv_id % 10 AS snapshot, * FROM ({_TURNS})),
u AS (SELECT snapshot, sum(size + 1) AS stored FROM (SELECT DISTINCT snapshot, chunk_id, size FROM t) GROUP BY 1)
SELECT snapshot, count(DISTINCT conv_id) AS files, CAST(sum(size) AS BIGINT) AS logical_bytes, count(*) AS chunk_refs, CAST(any_value(stored) AS BIGINT) AS stored_bytes
FROM t JOIN u USING (snapshot) GROUP BY 1""")
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("snapshot", F.col("conv_id") % 10)
    own = t.select("snapshot", "chunk_id", "size").distinct().groupBy("snapshot").agg(F.sum(F.col("size") + 1).alias("stored_bytes"))
    return t.groupBy("snapshot").agg(F.count_distinct("conv_id").alias("files"), F.sum("size").alias("logical_bytes"), F.count("*").alias("chunk_refs")).join(own, "snapshot")


# Restore


@query(f"SELECT path, sha256(string_agg(text, '' ORDER BY seq)) AS content_sha256, CAST(sum(size) AS BIGINT) AS size FROM (SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, turn AS seq, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size FROM conversations) GROUP BY 1")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together from a store that holds each chunk once, zstd-coded, with every chunk's name checked."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    data = F.coalesce("text", F.lit("")).cast("binary")
    store = t.select(ids.chunk_id(data).alias("chunk_id"), data.alias("data")).dropDuplicates(["chunk_id"]).select("chunk_id", codec.encode_chunk(F.col("data"), "zstd").alias("blob"))
    opened = store.select("chunk_id", codec.decode_chunk(F.col("blob")).alias("data")).select("chunk_id", F.when(ids.chunk_id(F.col("data")) == F.col("chunk_id"), F.col("data")).alias("data"))
    refs = dedup.manifest(turns(spark, sf_dir)).select("path", F.posexplode("chunks").alias("seq", "chunk_id"))
    wrong = F.raise_error(F.concat(F.lit("integrity check failed for chunk "), F.col("chunk_id"))).cast("binary")
    joined = refs.join(opened, "chunk_id", "left").withColumn("data", F.coalesce("data", wrong))
    files = joined.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("c"))
    whole = F.aggregate("c", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["data"]))
    return files.select("path", F.sha2(whole, 256).alias("content_sha256"), F.octet_length(whole).cast("long").alias("size"))


@query("""
SELECT path, safe FROM (VALUES ('../evil', false), ('../../etc/passwd', false), ('/abs/path', false), ('sub/ok.txt', true), ('a/../b', true),
 ('a/../..', false), ('..', false), ('.', true), ('a/./b//c', true), ('..hidden', true), ('a/b/../../../c', false)) AS t(path, safe)""")
def safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["../evil", "../../etc/passwd", "/abs/path", "sub/ok.txt", "a/../b", "a/../..", "..", ".", "a/./b//c", "..hidden", "a/b/../../../c"]
    return spark.createDataFrame([(r,) for r in rows], "path string").select("path", paths.is_safe(F.col("path")).alias("safe"))


# Codecs and sealing: what goes in comes out


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    forms = [F.struct(F.lit(n).alias("codec"), codec.encode_chunk(F.col("content"), n).alias("blob")) for n in ("none", "gzip", "zstd")]
    return t.select("path", "content", "size", F.explode(F.array(*forms)).alias("f")).select("path", "size", "f.codec", "f.blob")


@query(f"SELECT path, codec, chunk_id AS content_sha256, true AS no_larger FROM ({_IDS}), (VALUES ('none'), ('gzip'), ('zstd')) AS c(codec)")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(spark, sf_dir)
    return rows.select("path", "codec", F.sha2(codec.decode_chunk(F.col("blob")), 256).alias("content_sha256"), (F.octet_length("blob") <= F.col("size") + 1).alias("no_larger"))


@query(f"SELECT path, chunk_id AS content_sha256, size + 28 AS sealed_size FROM ({_IDS})")
def seal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sealed and opened; the plan that opens reads the sealed column, so that it is computed once."""
    keys = seal.Keys(b"k" * 32, TEST_KEY)
    rows = seal.with_keys(tree(spark, sf_dir), keys).withColumn("sealed", seal.seal(F.col("content"), F.col("seal_key")))
    return rows.select("path", F.sha2(seal.open_sealed(F.col("sealed"), F.col("seal_key")), 256).alias("content_sha256"), F.octet_length("sealed").cast("long").alias("sealed_size"))


@query(f"SELECT path, false AS tampered_opens, false AS short_opens, false AS other_key_opens FROM ({_TREE})")
def tamper_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = seal.Keys(b"k" * 32, TEST_KEY)
    rows = seal.with_keys(tree(spark, sf_dir), keys).withColumn("sealed", seal.seal(F.col("content"), F.col("seal_key")))
    n = F.octet_length("sealed")
    last = F.substring(F.col("sealed"), n, F.lit(1))
    flipped = F.concat(F.substring(F.col("sealed"), F.lit(1), n - 1), F.unhex(F.when(F.hex(last) == "00", "01").otherwise("00")))
    opens = lambda blob, key: seal.open_sealed(blob, key).isNotNull()
    return rows.select("path", opens(flipped, F.col("seal_key")).alias("tampered_opens"), opens(F.substring(F.col("sealed"), F.lit(1), F.lit(3)), F.col("seal_key")).alias("short_opens"), opens(F.col("sealed"), F.substring(F.col("inner_pad"), 1, 32)).alias("other_key_opens"))


# Scalar functions


_UNITS_SQL = " ".join(f"WHEN n < {1024 ** (p + 1)} THEN printf('%.1f {u}iB', round_even(n / {1024**p}.0, 1))" for p, u in list(enumerate(display.UNITS, 1))[:3])


@query(f"SELECT n, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' {_UNITS_SQL} END AS shown FROM (SELECT DISTINCT strlen(coalesce(text, '')) * 37 AS n FROM documents)")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tree(spark, sf_dir).select((F.col("size") * 37).alias("n")).distinct()
    return n.select("n", display.human_bytes(F.col("n")).alias("shown"))


@query("SELECT n, CASE WHEN n = 1 THEN '1 chunk' ELSE CAST(n AS VARCHAR) || ' chunks' END AS shown FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) - 1 AS n FROM lineitem)")
def plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_linenumber").cast("long") - 1).alias("n")).distinct()
    return n.select("n", display.plural(F.col("n"), "chunk").alias("shown"))


@query("SELECT c_custkey, greatest(CAST(floor(c_acctbal) AS BIGINT), 0) AS bytes, greatest(c_acctbal / 10000, 0.0) AS ratio FROM customer")
def non_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", display.non_neg(F.floor("c_acctbal")).alias("bytes"), display.non_neg_ratio(F.col("c_acctbal") / 10000).alias("ratio"))


@query("SELECT name, CASE name WHEN 'none' THEN 0 WHEN 'store' THEN 0 WHEN 'gzip' THEN 1 WHEN 'zstd' THEN 2 ELSE -1 END AS tag FROM (SELECT unnest(['none', 'store', 'gzip', 'zstd', 'ZSTD', 'lz4', '']) AS name)")
def parse_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in ("none", "store", "gzip", "zstd", "ZSTD", "lz4", "")], "name string")
    return rows.select("name", F.coalesce(codec.parse_codec(F.col("name")), F.lit(-1)).alias("tag"))


@query("SELECT tag, CASE tag WHEN 0 THEN 'none' WHEN 1 THEN 'gzip' WHEN 2 THEN 'zstd' ELSE 'codec(' || CAST(tag AS VARCHAR) || ')' END AS name FROM (SELECT DISTINCT l_linenumber AS tag FROM lineitem)")
def codec_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("tag")).distinct()
    return rows.select("tag", codec.codec_name(F.col("tag")).alias("name"))


@query("SELECT o_orderkey, CASE WHEN total <= 0 THEN 0.0 WHEN done >= total THEN 1.0 ELSE CAST(done AS DOUBLE) / total END AS fraction FROM (SELECT o_orderkey, o_orderkey % 1000 AS done, o_custkey % 900 AS total FROM orders)")
def fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("done"), (F.col("o_custkey") % 900).alias("total"))
    return o.select("o_orderkey", display.fraction(F.col("done"), F.col("total")).alias("fraction"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, logical bytes, distinct chunks and their bytes of the documents as one snapshot."""
    return dedup_unique(spark, sf_dir)
