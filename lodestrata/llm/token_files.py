"""Token-ID / binary output (operator 8): Arrow files of equal-length sequences.

A file is an Arrow IPC stream with the footer of Arrow's file format: record batches of ``BATCH`` rows, each row a
fixed-size list of ``SEQUENCE`` ids and a fixed-size list of as many mask bits. Since every list and every batch but the
last has one size, sequence i is at a known place: a reader maps the file and gets a view of it without a copy or a
scan. Documents follow one another without gaps inside a file; the last sequence is padded and its mask says so. A second
small Arrow file beside it says where each document starts.

Documents are dealt to files by ranges of their id (ties by a hash of the text, then by place in the input, so that one
id that holds many rows still spreads), sorted inside each, and encoded as they are written; memory is one batch of
sequences. A task writes under a name of its own and reports it in its result, so a task that runs twice leaves a file
that nobody reads and never a torn one. Files go to the shared folder through pyarrow's file systems (file, hdfs, s3).
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import load, slots, stage, work_path

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that one file holds on average, where that makes more files than the session has shuffle partitions.
FILE_BYTES = 128 << 20
SEQUENCE = 2048
BATCH = 64
END = 1


class WordIds:
    """Ids of texts by the library, through a bounded table of the ids of short runs without ASCII white space.

    The vocabulary's rules (composed form, white space to one space, lower case, then runs of letters, single digits and
    runs of marks) never join over white space, so a text's ids are those of its runs in order. Where composing changes
    nothing, A-Z may be lowered before; a single stop or comma after a plain letter or digit that ends a run has ids of its own.
    """

    LIMIT, LONG, GROUP = 500_000, 64, 8 << 20

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would spin
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _even(text: bytes | None) -> bytes:
        if not text:
            return b""
        low = text.lower()
        same = b"<|" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text.decode()) and unicodedata.is_normalized("NFC", low.decode()))
        return low if same else text

    def ids_of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For each UTF-8 text its ids and the end id, made for groups of texts of bounded bytes."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for t in texts:
            group.append(self._even(t))
            size += len(group[-1])
            if size >= self.GROUP:
                out += self._group(group)
                group, size = [], 0
        return out + list(self._group(group)) if group else out

    def _group(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        runs = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        number, first = coded.indices.to_numpy(), runs.offsets.to_numpy()
        known = self._known(coded.dictionary.cast(pa.large_binary()).to_pylist())
        width = np.dtype(self.kind).itemsize
        size = np.fromiter(map(len, known), np.int64, len(known)) // width
        start, ids = np.cumsum(size) - size, np.frombuffer(b"".join(known), self.kind)
        own = size[number]
        end = np.concatenate(([0], np.cumsum(own)))
        flat = ids[np.arange(end[-1]) + np.repeat(start[number] - end[:-1], own)]
        cuts = end[first]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.append(flat[low:high], self.kind(END))

    def _known(self, runs: list[bytes]) -> list[bytes]:
        """The ids of distinct runs, as bytes. Those that the table lacks are encoded in one call."""
        if len(self.new) >= self.LIMIT:
            self.old, self.new = self.new, {}
        known, before = self.new.get, self.old.get
        found = list(map(known, runs))
        here = {b"": b""}
        stopped: dict[bytes, tuple[bytes, bytes]] = {}
        wanted = set()
        for r, p in zip(runs, found, strict=True):
            if p is None and r:
                p = before(r)
                if p is not None:
                    here[r] = p
                elif r[-1:] in _STOPS and r[-2:-1] in _PLAIN:
                    stopped[r] = r[:-1], r[-1:]
                    wanted.update(stopped[r])
                else:
                    wanted.add(r)
        fresh = []
        for r in wanted:
            p = known(r) or before(r) or here.get(r)
            if p is None:
                fresh.append(r)
            else:
                here[r] = p
        for r, e in zip(fresh, self.tokenizer.encode_batch_fast([r.decode() for r in fresh], add_special_tokens=False), strict=True):
            here[r] = np.array(e.ids, self.kind).tobytes()
        here.update((r, here[x] + here[y]) for r, (x, y) in stopped.items())
        self.new.update((r, p) for r, p in here.items() if len(r) <= self.LONG)
        return [here[r] if p is None else p for r, p in zip(runs, found, strict=True)]


_STOPS = frozenset((b".", b","))
_PLAIN = frozenset(bytes([x]) for x in b"abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=1)
def _words(path: str) -> WordIds:
    return WordIds(path)


def _schema(kind, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


def _write(folder: str, path: str | None, length: int, id_type: pa.DataType):
    index_schema = pa.schema([("doc", id_type), ("start", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path or public_tokenizers.path(VOCABULARY))
        number = TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{number:07d}-{uuid.uuid4().hex}"
        schema, size = _schema(words.kind, length), length * BATCH
        total = docs = 0
        held: list[np.ndarray] = []
        sink = index = None

        def put(last: bool) -> None:
            nonlocal held
            flat = np.concatenate(held) if held else np.empty(0, words.kind)
            full = len(flat) // size * size
            if last and len(flat) > full:
                rows = -(-(len(flat) - full) // length)
                ends = np.zeros(full + rows * length, words.kind)
                ends[: len(flat)] = flat
                mask, flat = np.arange(len(ends)) < len(flat), ends
            else:
                mask, held = np.ones(full, bool), [flat[full:]]
                flat = flat[:full]
            for at in range(0, len(flat), size):
                cut = flat[at : at + size]
                sink.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(cut), length), pa.FixedSizeListArray.from_arrays(pa.array(mask[at : at + size]), length)], schema=schema))

        waiting = 0
        for batch in batches:
            if sink is None:
                fs.create_dir(root, recursive=True)
                files = fs.open_output_stream(f"{name}.arrow"), fs.open_output_stream(f"{name}.docs")
                sink, index = pa.ipc.new_file(files[0], schema), pa.ipc.new_file(files[1], index_schema)
            starts, sizes = [], []
            for ids in (x for at in range(0, len(batch), 1024) for x in words.ids_of(batch.column(1).slice(at, 1024).cast(pa.binary()).to_pylist())):
                starts.append(total)
                sizes.append(len(ids))
                total += len(ids)
                waiting += len(ids)
                held.append(ids)
                if waiting >= size:
                    put(False)
                    waiting = len(held[0])
            docs += len(starts)
            index.write_batch(pa.record_batch([batch.column(0).cast(id_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=index_schema))
        if sink is not None:
            put(True)
            for x in (sink, index, *files):
                x.close()
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "name", "docs", "ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, length: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """Write the files and return their list: part, name, docs, ids, base (ids in all parts before).

    Null texts count as empty and have the end id alone; null ids come first. Rows in ascending order of the id. An empty
    table makes no files. Columns other than the id and the text are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"mark": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(slots(spark), -(-size // FILE_BYTES))
    dealt = rows.repartitionByRange(files, "id", "mark", "place").sortWithinPartitions("id", "mark", "place")
    id_type = pa.int64() if docs.schema[id_col].dataType.simpleString() == "bigint" else pa.string()
    listed = stage(dealt.select(F.col("id").cast("bigint" if id_type == pa.int64() else "string"), "text").mapInArrow(_write(folder, path, length, id_type), "part long, name string, docs long, ids long"), "files")
    # one small row for each file, not for each document
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


class TokenFile:
    """Random access to one file: sequences by number, ids by place, without reading what lies before."""

    def __init__(self, fs: pyarrow.fs.FileSystem, name: str) -> None:
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.source = pa.memory_map(f"{name}.arrow") if local else fs.open_input_file(f"{name}.arrow")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.number, self.flat, self.full = -1, None, None

    def _load(self, number: int) -> None:
        if number != self.number:
            batch = self.reader.get_batch(number)
            self.number, self.flat, self.full = number, batch.column(0).flatten().to_numpy(), batch.column(1).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids, a view into the mapped file, and mask of sequence i."""
        self._load(i // BATCH)
        at = i % BATCH * self.length
        return self.flat[at : at + self.length], self.full.slice(at, self.length)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from ``start`` on, in views of one batch each."""
        size = self.length * BATCH
        while n:
            self._load(start // size)
            cut = self.flat[start % size : start % size + n]
            yield cut
            start, n = start + len(cut), n - len(cut)


def _read(folder: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TokenFile(fs, name)
                with fs.open_input_file(f"{name}.docs") as f, pa.ipc.open_file(f) as index:
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        crcs = []
                        for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                            crc = 0
                            for cut in tokens.ids(start, n):
                                crc = zlib.crc32(cut.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        starts = pa.array(np.asarray(part.column(1)) + base, pa.int64())
                        yield pa.record_batch([part.column(0), starts, part.column(2), pa.array(crcs, pa.int64())], ["doc", "start", "n", "crc"])

    return run


def read_documents(listed: DataFrame, folder: str, id_type: pa.DataType) -> DataFrame:
    """Read the files back: one row for each document, with its place among all ids and the crc32 of its ids."""
    rows = listed.select("name", "base")
    rows = rows.repartition(max(slots(listed.sparkSession), rows.count()), "name")
    return rows.mapInArrow(_read(folder, id_type), f"doc {'bigint' if id_type == pa.int64() else 'string'}, start long, n long, crc long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from the files: doc_id, start, n_tokens, ids_crc32."""
    folder = work_path(spark, "tokens")
    listed = write_token_files(load(spark, sf_dir, "documents"), folder)
    return read_documents(listed, folder, pa.int64()).select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
