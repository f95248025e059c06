"""A vault: chunks, manifests and snapshots as Parquet tables below one folder, and the four things done with them.

    config.json                        only in an encrypted vault; written before any data
    chunks/shard=<x>/*.parquet         chunk_id, blob, raw_size, stored_size, codec
    files/snapshot_id=<id>/*.parquet   ordinal, path, size, mode, mtime_ns, chunks
    dirs/snapshot_id=<id>/*.parquet    ordinal, path, mode
    snapshots/<id>.json                written last; what has none was never published and is not read

A backup reads metadata first and joins it with the parent snapshot, so unchanged files are never opened. Changed files
are chunked and named where they are read, and only names travel; the bytes of chunks that the store lacks are read a
second time and written from the task that reads them, so no shuffle carries file contents.
"""

from __future__ import annotations

import json
import os
import secrets
import stat
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec as codecs
from ..functions import seal
from ..functions.display import reduction_ratio, saved_bytes
from ..functions.ids import chunk_id, chunk_id_keyed, shard
from ..functions.paths import UnsafePath, is_safe, safe_join
from ..operators import dedup, verify
from ..operators.chunking import chunked, chunked_files, read_ranges
from ..sources.object_store import Folder, NotFound
from ..sources.tree import local_path, scan_tree, size_prescan

CHUNKS = "chunk_id string, blob binary, raw_size bigint, stored_size bigint, codec int, shard string"
FILES = "ordinal bigint, path string, size bigint, mode bigint, mtime_ns bigint, chunks array<string>, snapshot_id string"
DIRS = "ordinal bigint, path string, mode bigint, snapshot_id string"
SNAPSHOTS = "snapshot_id string, source string"
#: Leading hex digits of an id that name its folder.
SHARD_WIDTH = 1


class IntegrityError(RuntimeError):
    """Stored data is not what its name or its manifest says."""


class Cancelled(RuntimeError):
    """The run was cancelled; nothing was published."""


@dataclass(frozen=True)
class BackupResult:
    snapshot_id: str
    files: int
    reused: int
    skipped: int
    total_chunks: int
    new_chunks: int
    total_bytes: int
    stored_bytes: int

    @property
    def reduction_ratio(self) -> float:
        return (self.total_bytes - self.stored_bytes) / self.total_bytes if self.total_bytes else 0.0


@dataclass(frozen=True)
class Report:
    chunks: int
    snapshots: int
    corrupt: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    broken: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.corrupt and not self.missing


@dataclass(frozen=True)
class Stats:
    snapshots: int
    unique_chunks: int
    stored_bytes: int
    logical_bytes: int
    chunk_refs: int

    @property
    def saved_bytes(self) -> int:
        return self.logical_bytes - self.stored_bytes

    @property
    def reduction_ratio(self) -> float:
        return self.saved_bytes / self.logical_bytes if self.logical_bytes else 0.0


class Progress:
    """Counts that a running operation reports through Spark's observed metrics, with no pass of their own."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []
        self.total_bytes = 0

    def watch(self, df: DataFrame, **counts) -> DataFrame:
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[c.alias(k) for k, c in counts.items()])

    def snapshot(self) -> dict[str, int]:
        """Totals of the parts that have finished."""
        out: dict[str, int] = {}
        for seen in self._seen:
            if seen._jo is None or not seen._jo.future().isCompleted():
                continue  # get would wait for it
            for k, v in seen.get.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out

    @staticmethod
    def tasks(spark: SparkSession) -> tuple[int, int]:
        """Tasks done, and tasks, of the stages that run now."""
        tracker = spark.sparkContext.statusTracker()
        stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
        return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


def new_snapshot_id(now: datetime | None = None) -> str:
    return f"{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}-{secrets.token_hex(4)}"


def is_encrypted(spark: SparkSession, root: str) -> bool:
    folder = Folder(spark, root)
    return folder.exists("config.json") and json.loads(folder.get("config.json")).get("kdf") is not None


class Vault:
    """Open with :meth:`open`. All methods plan Spark jobs; only counts, lists of problems and names reach the driver."""

    def __init__(self, spark: SparkSession, folder: Folder, keys: seal.Keys | None) -> None:
        self.spark, self.folder, self.keys = spark, folder, keys
        self._cancelled, self._tag = threading.Event(), f"vault-{secrets.token_hex(8)}"

    def cancel(self) -> None:
        """Stop what this object runs in another thread: its Spark jobs end, and a backup is not published."""
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    @contextmanager
    def _running(self) -> Iterator[None]:
        """Jobs started inside can be cancelled; that they failed because of it is told as such."""
        self._cancelled.clear()
        self.spark.sparkContext.addJobTag(self._tag)
        try:
            yield
            self._go_on()
        except Exception as failed:
            if self._cancelled.is_set():
                raise Cancelled("cancelled") from failed
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self._tag)

    def _go_on(self) -> None:
        if self._cancelled.is_set():
            raise Cancelled("cancelled")

    @classmethod
    def open(cls, spark: SparkSession, root: str, passphrase: bytes | str | None = None, create: bool = False) -> Vault:
        """Open a vault. A passphrase is needed exactly for encrypted vaults; a new vault with one is encrypted."""
        passphrase = passphrase.encode() if isinstance(passphrase, str) else passphrase
        folder = Folder(spark, root)
        if not folder.bucket_exists():
            raise NotFound(f"no bucket for {folder.root}")
        if not folder.exists() and not create:
            raise NotFound(folder.root)
        folder.make()
        config = json.loads(folder.get("config.json")) if folder.exists("config.json") else None
        if config and config.get("kdf") is not None:
            if not passphrase:
                raise seal.PassphraseRequired("the vault is encrypted: a passphrase is required")
            return cls(spark, folder, seal.open_config(config, passphrase))
        if not passphrase:
            return cls(spark, folder, None)
        if not create or any(n.endswith(".json") for n in folder.names("snapshots")):
            raise seal.NotEncrypted("the vault is not encrypted")
        config, keys = seal.new_config(passphrase)
        folder.put("config.json", json.dumps(config, indent=2).encode())
        return cls(spark, folder, keys)

    # Tables

    def _table(self, name: str, schema: str, readable: bool = False) -> DataFrame:
        if not self.folder.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", readable).parquet(self.folder.at(name))

    def chunks(self, readable: bool = False) -> DataFrame:
        """Stored chunks. Two runs at a time may both have written one; the copies are alike. ``readable``: leave out what
        lies in files that can't be read, instead of failing."""
        return self._table("chunks", CHUNKS, readable)

    def damaged(self) -> DataFrame:
        """Files of chunks of which no row can be read: path, shard."""
        if not self.folder.exists("chunks"):
            return self.spark.createDataFrame([], "path string, shard string")
        name = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.folder.at("chunks")).select(name(F.col("path")).alias("path"))
        read = self.chunks(readable=True).select("chunk_id", name(F.col("_metadata.file_path")).alias("path")).groupBy("path").agg(F.count("chunk_id").alias("n"))
        return there.join(read, "path", "left_anti").select("path", F.regexp_extract("path", "/shard=([^/]*)/", 1).alias("shard"))

    def get_chunk(self, chunk: str) -> bytes:
        """Checked plain bytes of one chunk; only its shard is read."""
        rows = self.chunks().where((F.col("shard") == chunk[:SHARD_WIDTH]) & (F.col("chunk_id") == chunk))
        chunks, plain, name = self._plain(rows)
        found = chunks.select(F.when(name(plain) == F.col("chunk_id"), plain).alias("data")).collect()
        if not found:
            raise NotFound(f"no chunk {chunk}")
        if found[0]["data"] is None:
            raise IntegrityError(f"chunk {chunk} does not hold what its name says")
        return bytes(found[0]["data"])

    def stored(self, readable: bool = False) -> DataFrame:
        """Ids and sizes of stored chunks, without reading their bytes."""
        return self.chunks(readable).groupBy("chunk_id").agg(F.min("raw_size").alias("raw_size"), F.min("stored_size").alias("stored_size"))

    def snapshots(self) -> DataFrame:
        """Published snapshots, checked against the names that they stand under."""
        rows = []
        for name in self.list_snapshots():
            held = self.load_snapshot(name)
            rows.append((name, held["source"]))
        return self.spark.createDataFrame(rows, SNAPSHOTS)

    def list_snapshots(self) -> list[str]:
        return [n[: -len(".json")] for n in self.folder.names("snapshots") if n.endswith(".json")]

    def load_snapshot(self, snapshot_id: str) -> dict:
        held = json.loads(self.folder.get(f"snapshots/{snapshot_id}.json"))
        if self.keys:
            held = self._unsealed(held)
        if held.get("id") != snapshot_id:
            raise IntegrityError(f"the object of snapshot {snapshot_id} names itself {held.get('id')!r}")
        return held

    def _sealed(self, held: dict) -> dict:
        row = seal.with_keys(self.spark.createDataFrame([(json.dumps(held),)], "j string"), self.keys)
        return {"sealed": row.select(F.base64(seal.seal(F.col("j").cast("binary"), F.col("seal_key"))).alias("s")).first()["s"]}

    def _unsealed(self, held: dict) -> dict:
        row = seal.with_keys(self.spark.createDataFrame([(held.get("sealed"),)], "s string"), self.keys)
        text = row.select(seal.open_sealed(F.unbase64("s"), F.col("seal_key")).cast("string").alias("j")).first()["j"]
        if text is None:
            raise IntegrityError("a snapshot could not be decrypted")
        return json.loads(text)

    def files(self) -> DataFrame:
        return self._manifest("files", FILES, ["path", "chunks"])

    def dirs(self) -> DataFrame:
        return self._manifest("dirs", DIRS, ["path"])

    def _manifest(self, name: str, schema: str, sealed: list[str]) -> DataFrame:
        """Rows of published snapshots. In an encrypted vault the columns in ``sealed`` are stored as one blob."""
        published = self.spark.createDataFrame([(s,) for s in self.list_snapshots()], "snapshot_id string")
        if not self.keys:
            return self._table(name, schema).join(F.broadcast(published), "snapshot_id")
        kept = [f for f in T._parse_datatype_string(schema).fields if f.name not in sealed]
        rows = self._table(name, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept[:-1]] + ["sealed binary", "snapshot_id string"]))
        inside = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields if f.name in sealed)
        plain = seal.open_sealed(F.col("sealed"), F.col("seal_key")).cast("string")
        rows = seal.with_keys(rows.join(F.broadcast(published), "snapshot_id"), self.keys)
        rows = rows.withColumn("plain", F.from_json(F.coalesce(plain, F.raise_error(F.lit("a manifest could not be decrypted")).cast("string")), inside))
        return rows.select(*[f.name for f in kept], "plain.*")

    def _write_manifest(self, rows: DataFrame, name: str, snapshot_id: str, sealed: list[str]) -> None:
        if self.keys:
            rows = seal.with_keys(rows, self.keys).withColumn("sealed", seal.seal(F.to_json(F.struct(*sealed)).cast("binary"), F.col("seal_key")))
            rows = rows.drop("seal_key", "inner_pad", "outer_pad", *sealed)
        rows.write.parquet(self.folder.at(f"{name}/snapshot_id={snapshot_id}"))

    # Backup

    def backup(self, source: str, codec: str = "zstd", average: int = 0, snapshot_id: str | None = None, progress: Progress | None = None) -> BackupResult:
        """Store a directory tree as a new snapshot. Any unreadable entry fails the run, and nothing is published."""
        with self._running():
            return self._backup_folder(source, codec, average, snapshot_id, progress)

    def _backup_folder(self, source: str, codec: str, average: int, snapshot_id: str | None, progress: Progress | None) -> BackupResult:
        tree = scan_tree(self.spark, source)
        root = "file://" + os.path.abspath(local_path(source))
        return self._backup(tree, source, codec, average, snapshot_id, progress, lambda files: chunked_files(files, root, average, self._name_key()), lambda refs: read_ranges(refs, root, self._name_key()))

    def backup_table(self, files: DataFrame, source: str, codec: str = "zstd", average: int = 0, snapshot_id: str | None = None, progress: Progress | None = None) -> BackupResult:
        """Store a table (path, content, mtime_ns) as a snapshot, one file for each row."""
        tree = files.select("path", F.lit("file").alias("kind"), F.octet_length("content").cast("long").alias("size"), F.lit(0o644).cast("long").alias("mode"), "mtime_ns")

        def cut(changed: DataFrame) -> DataFrame:
            return chunked(files.join(changed.select("path"), "path", "left_semi"), average, name_key=self._name_key())

        def read(refs: DataFrame) -> DataFrame:
            joined = refs.join(files.select("path", "content"), "path")
            return joined.select("chunk_id", F.col("size").alias("raw_size"), F.substring("content", (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).alias("data"))

        with self._running():
            return self._backup(tree, source, codec, average, snapshot_id, progress, cut, read)

    def _name_key(self) -> bytes | None:
        return self.keys.name if self.keys else None

    def _backup(self, tree: DataFrame, source: str, codec: str, average: int, snapshot_id: str | None, progress: Progress | None, cut: Callable, read: Callable) -> BackupResult:
        tag = codecs.tag_of(codec)
        snapshot_id = snapshot_id or new_snapshot_id()
        work = self.folder.at(f"staging/{snapshot_id}")

        def staged(df: DataFrame, name: str) -> DataFrame:
            """Written once and read back; in an encrypted vault rows are sealed, so that a run that is killed leaves no
            names behind."""
            self._go_on()
            if not self.keys:
                df.write.parquet(f"{work}/{name}")
                return self.spark.read.schema(df.schema).parquet(f"{work}/{name}")
            rows = seal.with_keys(df, self.keys).select(seal.seal(F.to_json(F.struct(*df.columns)).cast("binary"), F.col("seal_key")).alias("sealed"))
            rows.write.parquet(f"{work}/{name}")
            rows = seal.with_keys(self.spark.read.schema("sealed binary").parquet(f"{work}/{name}"), self.keys)
            plain = seal.open_sealed(F.col("sealed"), F.col("seal_key")).cast("string")
            return rows.select(F.from_json(plain, df.schema).alias("row")).select("row.*")

        try:
            tree = staged(tree, "tree")  # metadata only; one walk, whose times decide what is reused
            if progress:
                progress.total_bytes = size_prescan(tree).first()["total_bytes"]
            newest = dedup.parent_snapshot(self.snapshots(), source).first()
            parent = self.files().where(F.col("snapshot_id") == newest["snapshot_id"]) if newest else self.spark.createDataFrame([], FILES)
            status = staged(dedup.incremental_status(tree.where("kind = 'file'"), parent), "status")
            refs = cut(status.where("status <> 'reused'"))
            if progress:
                refs = progress.watch(refs, chunks_read=F.count("*"), bytes_read=F.sum("size"))
            refs = staged(refs, "refs")
            fresh = staged(dedup.new_chunks(refs, self.stored()), "fresh")
            blobs = read(fresh.repartition("path").sortWithinPartitions("path", "offset"))
            encoded = codecs.encode_chunk(F.col("data"), codec)
            if self.keys:
                blobs = seal.with_keys(blobs, self.keys)
                encoded = seal.seal(encoded, F.col("seal_key"))
            blobs = blobs.select("chunk_id", encoded.alias("blob"), "raw_size")
            blobs = blobs.select("chunk_id", "blob", "raw_size", F.octet_length("blob").cast("long").alias("stored_size"), F.lit(tag).alias("codec"), shard(F.col("chunk_id"), SHARD_WIDTH).alias("shard"))
            written = Observation()
            blobs.observe(written, F.count("*").alias("n"), F.sum("stored_size").alias("b")).write.mode("append").option("compression", "none").partitionBy("shard").parquet(self.folder.at("chunks"))

            made = status.join(dedup.manifest(refs).select("path", F.col("chunks").alias("cut")), "path", "left")
            ordered = F.xxhash64("path")  # a stable number; readers sort by path, parents before children
            none = F.array().cast("array<string>")
            self._write_manifest(made.select(ordered.alias("ordinal"), "path", "size", "mode", "mtime_ns", F.coalesce("chunks", "cut", none).alias("chunks")), "files", snapshot_id, ["path", "chunks"])
            self._write_manifest(tree.where("kind = 'dir'").select(ordered.alias("ordinal"), "path", "mode"), "dirs", snapshot_id, ["path"])
            counts = status.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "reused").alias("reused")).first()
            chunked_ = refs.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
            left_out = tree.where("kind = 'other'").count()
            held = {"id": snapshot_id, "source": source}
            self._go_on()
            self.folder.put(f"snapshots/{snapshot_id}.json", json.dumps(self._sealed(held) if self.keys else held, indent=2).encode())
            new = written.get
            return BackupResult(snapshot_id, counts["files"], counts["reused"], left_out, chunked_["n"], new["n"] or 0, chunked_["b"], new["b"] or 0)
        finally:
            self.folder.drop(f"staging/{snapshot_id}")

    # Reading back

    def _plain(self, chunks: DataFrame) -> tuple[DataFrame, Column, Callable]:
        """Chunks with what is needed to open them, their plain bytes, and how to name bytes in this vault."""
        if not self.keys:
            return chunks, codecs.decode_chunk(F.col("blob")), chunk_id
        return seal.with_keys(chunks, self.keys), codecs.decode_chunk(seal.open_sealed(F.col("blob"), F.col("seal_key"))), lambda data: chunk_id_keyed(data, F.col("inner_pad"), F.col("outer_pad"))

    def references(self, snapshot_id: str | None = None) -> DataFrame:
        files = self.files()
        return dedup.references(files if snapshot_id is None else files.where(F.col("snapshot_id") == snapshot_id))

    def contents(self, snapshot_id: str) -> DataFrame:
        """Checked bytes of a snapshot: path, seq, data, mode; files without chunks have one row with null data.

        A chunk that is missing, can't be opened or has other bytes than its name says fails the query.
        """
        files = self.files().where(F.col("snapshot_id") == snapshot_id).select("path", "mode", F.posexplode_outer("chunks").alias("seq", "chunk_id"))
        stored = self.chunks().select("*", F.col("_metadata.file_path").alias("file"))
        twice = stored.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("file").alias("first")).where("n > 1").select("chunk_id", "first")
        stored = stored.join(twice, "chunk_id", "left").where("first is null or first = file")
        chunks, plain, name = self._plain(stored)
        held = chunks.select("chunk_id", plain.alias("data"), *(["inner_pad", "outer_pad"] if self.keys else []))
        held = held.select("chunk_id", F.when(name(F.col("data")) == F.col("chunk_id"), F.col("data")).alias("data"))
        wrong = F.raise_error(F.concat(F.lit("integrity check failed for chunk "), F.col("chunk_id"))).cast("binary")
        joined = files.join(held, "chunk_id", "left")
        return joined.select("path", "mode", "seq", F.when(F.col("chunk_id").isNull(), F.lit(None)).when(F.col("data").isNull(), wrong).otherwise(F.col("data")).alias("data"))

    def restore(self, snapshot_id: str, target: str) -> dict[str, int]:
        """Write a snapshot below a folder that driver and executors all mount under one path: files, bytes. Folder modes
        are set last, deepest first."""
        with self._running():
            return self._restore(snapshot_id, target)

    def _restore(self, snapshot_id: str, target: str) -> dict[str, int]:
        self.load_snapshot(snapshot_id)
        target = os.path.abspath(local_path(target))
        dirs = self.dirs().where(F.col("snapshot_id") == snapshot_id).select("path", "mode")
        files = self.files().where(F.col("snapshot_id") == snapshot_id).select("path")
        bad = files.union(dirs.select("path")).where(~is_safe(F.col("path"))).first()
        if bad:
            raise UnsafePath(f"{bad['path']!r} would lie outside the target folder")
        os.makedirs(target, exist_ok=True)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    os.makedirs(safe_join(target, path), mode=0o755, exist_ok=True)
                yield batch.select([0])

        dirs.select("path").mapInArrow(make, "path string").count()

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows in order of path and seq; a file is written piece by piece, then gets its mode."""
            at, out, mode, last = None, None, 0, None
            files = size = 0

            def close() -> None:
                if out:
                    out.close()
                    os.chmod(safe_join(target, at), mode & 0o777)

            for batch in batches:
                for path, mode_, seq, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != at:
                        close()
                        at, mode, last = path, mode_, None
                        name = safe_join(target, path)
                        os.makedirs(os.path.dirname(name), exist_ok=True)
                        if os.path.lexists(name) and not os.access(name, os.W_OK):
                            os.chmod(name, stat.S_IMODE(os.lstat(name).st_mode) | stat.S_IWUSR)
                        out = open(name, "wb")  # noqa: SIM115
                        files += 1
                    if data and seq != last:  # a chunk that two runs stored at a time is there twice
                        last = seq
                        out.write(data)
                        size += len(data)
            close()
            yield pa.record_batch([pa.array([files], pa.int64()), pa.array([size], pa.int64())], ["files", "bytes"])

        rows = self.contents(snapshot_id).repartition("path").sortWithinPartitions("path", "seq")
        done = rows.mapInArrow(write, "files long, bytes long").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        for row in dirs.orderBy(F.desc("path")).toLocalIterator():
            os.chmod(safe_join(target, row["path"]), row["mode"] & 0o777)
        return {"files": done["files"], "bytes": done["bytes"]}

    # Checking

    def verify(self, snapshot_id: str | None = None, quick: bool = False, progress: Progress | None = None) -> Report:
        """Check one snapshot's chunks, or every stored chunk and every snapshot; ``quick`` reads no chunk's bytes.

        Damage is reported, it does not end the check: a chunk that can't be read or opened, or has other bytes than its
        name says, is corrupt, and so is a referenced one that is not found while a file of its shard can't be read. Any
        other referenced chunk that is not found is missing.
        """
        with self._running():
            return self._verify(snapshot_id, quick, progress)

    def _verify(self, snapshot_id: str | None, quick: bool, progress: Progress | None) -> Report:
        if snapshot_id is not None:
            self.load_snapshot(snapshot_id)
        refs = self.references(snapshot_id)
        stored = self.stored(readable=True)
        unread = self.damaged().select("shard").distinct()
        lost = verify.missing(refs, stored).withColumn("shard", shard(F.col("chunk_id"), SHARD_WIDTH))
        bad = lost.join(unread, "shard", "left_semi").select("chunk_id")
        lost = lost.join(unread, "shard", "left_anti").select("chunk_id")
        checked, ids = self.chunks(readable=True), stored.select("chunk_id")
        if snapshot_id is not None:
            checked, ids = (x.join(refs.select("chunk_id"), "chunk_id", "left_semi") for x in (checked, ids))
        if not quick:
            if progress:
                checked = progress.watch(checked, chunks_checked=F.count("*"), bytes_checked=F.sum("stored_size"))
            chunks, plain, name = self._plain(checked)
            # one reading of the bytes: ids whose every copy opens to what the id says, and all others
            good = chunks.select("chunk_id", F.coalesce(name(plain) == F.col("chunk_id"), F.lit(False)).alias("fine"))
            good = good.groupBy("chunk_id").agg(F.min("fine").alias("fine"))
            bad = bad.union(ids.join(good.where("fine"), "chunk_id", "left_anti"))
        bad, lost = bad.distinct().cache(), lost.cache()
        try:
            hurt = verify.broken(refs, bad.union(lost))
            row = verify.report(ids.count(), len(self.list_snapshots()) if snapshot_id is None else 1, bad, lost, hurt).first()
            return Report(row["chunks"], row["snapshots"], row["corrupt"], row["missing"], row["broken"])
        finally:
            bad.unpersist()
            lost.unpersist()

    def stats(self) -> Stats:
        self.snapshots()
        row = dedup.stats(self.spark.createDataFrame([(s,) for s in self.list_snapshots()], "snapshot_id string"), self.files(), self.stored()).first()
        return Stats(row["snapshots"], row["unique_chunks"], row["stored_bytes"], row["logical_bytes"], row["chunk_refs"])

    def stats_by_snapshot(self) -> DataFrame:
        """One row for each snapshot: files, logical_bytes, chunk_refs, and what its own chunks hold in the store."""
        files = self.files()
        own = files.groupBy("snapshot_id").agg(F.count("*").alias("files"), F.sum("size").alias("logical_bytes"), F.sum(F.size("chunks")).alias("chunk_refs"))
        held = dedup.references(files).select("snapshot_id", "chunk_id").distinct().join(self.stored(), "chunk_id").groupBy("snapshot_id").agg(F.sum("stored_size").alias("stored_bytes"))
        rows = own.join(held, "snapshot_id", "left").fillna(0, ["stored_bytes"])
        return rows.withColumns({"saved": saved_bytes(F.col("logical_bytes"), F.col("stored_bytes")), "ratio": reduction_ratio(F.col("logical_bytes"), F.col("stored_bytes"))})
