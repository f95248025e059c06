"""Tables of bytes to tables of chunks."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

from .gear import Sizes, split, split_bytes

READ = 4 << 20
_BATCH_BYTES = 16 << 20

_COLUMNS = "path string, seq int, offset long, size long, chunk_id string"


def _namer(name_key: bytes | None):
    if name_key is None:
        return lambda data: hashlib.sha256(data).hexdigest()
    return lambda data: hmac.new(name_key, data, hashlib.sha256).hexdigest()


def _batches(rows: Iterator[tuple], with_data: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (path, seq, offset, size, id, data) to batches of bounded bytes."""
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_data
    names = ["path", "seq", "offset", "size", "chunk_id"] + ["data"] * with_data
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += 200 + (row[3] if with_data else 0)
        if weight >= _BATCH_BYTES:
            yield pa.record_batch([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)
            held, weight = [], 0
    yield pa.record_batch([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)


def chunked(files: DataFrame, average: int = 0, with_data: bool = False, name_key: bytes | None = None) -> DataFrame:
    """Chunks of a table (path, content): path, seq, offset, size, chunk_id, and the bytes if asked for.

    Empty and null contents have no chunks. A naming key turns ids from SHA-256 into HMAC-SHA256.
    """
    Sizes.of(average)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _namer(name_key)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1), strict=True):
                    if not content.is_valid:
                        continue
                    offset = 0
                    for seq, data in enumerate(split_bytes(content.as_py(), average)):
                        yield path.as_py(), seq, offset, len(data), name(data), data
                        offset += len(data)

        yield from _batches(rows(), with_data)

    return files.select("path", "content").mapInArrow(run, _COLUMNS + (", data binary" if with_data else ""))


def chunked_files(files: DataFrame, root: str, average: int = 0, name_key: bytes | None = None) -> DataFrame:
    """Chunks of files named by their path below ``root``, without their bytes: path, seq, offset, size, chunk_id.

    Files are streamed: a task holds one buffer, whatever the file's size. A file that can't be read is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _namer(name_key)
        fs, base = pyarrow.fs.FileSystem.from_uri(root)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    offset = 0
                    with fs.open_input_stream(f"{base}/{path}") as f:
                        for seq, data in enumerate(split(iter(lambda f=f: f.read(READ), b""), average)):
                            yield path, seq, offset, len(data), name(data), None
                            offset += len(data)

        yield from _batches(rows(), False)

    return files.select("path").mapInArrow(run, _COLUMNS)


def read_ranges(chunks: DataFrame, root: str, name_key: bytes | None = None) -> DataFrame:
    """Bytes of chunks (path, offset, size, chunk_id) read from the files below ``root``: chunk_id, raw_size, data.

    The bytes are named anew; a file that has changed since it was chunked is an error, not a wrong chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _namer(name_key)
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        opened, at = None, None

        def rows() -> Iterator[tuple]:
            nonlocal opened, at
            for batch in batches:
                for path, offset, size, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != at:
                        if opened:
                            opened.close()
                        opened, at = fs.open_input_file(f"{base}/{path}"), path
                    data = opened.read_at(size, offset)
                    if name(data) != chunk:
                        raise RuntimeError(f"{path} changed while it was being stored")
                    yield path, 0, offset, size, chunk, data

        for batch in _batches(rows(), True):
            yield pa.record_batch([batch.column(4), batch.column(3), batch.column(5)], ["chunk_id", "raw_size", "data"])

    return chunks.select("path", "offset", "size", "chunk_id").mapInArrow(run, "chunk_id string, raw_size long, data binary")
