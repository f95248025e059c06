"""Chunk codecs: one tag byte, then the payload.

Compression has no Spark function, so encoding and decoding are Arrow functions; the codec objects live once in each
Python worker. Data that a codec does not shrink is stored as it is, so a stored chunk is at most one byte longer.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and tags of the codecs, and the most bytes that a chunk may inflate to.
TAGS = {"none": 0, "store": 0, "gzip": 1, "zstd": 2}
NAMES = {0: "none", 1: "gzip", 2: "zstd"}
LIMIT = 512 << 20


class CodecError(ValueError):
    """An unknown codec, or bytes that are not what their tag says."""


def tag_of(name: str) -> int:
    try:
        return TAGS[name]
    except KeyError:
        raise CodecError(f"unknown codec {name!r}") from None


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def encode(tag: int, data: bytes) -> bytes:
    if tag == 1:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        payload = packer.compress(data) + packer.flush()
    elif tag == 2:
        payload = _zstd()[0].compress(data)
    elif tag == 0:
        return b"\0" + data
    else:
        raise CodecError(f"unknown codec {tag}")
    return bytes([tag]) + payload if len(payload) < len(data) else b"\0" + data


def decode(blob: bytes, limit: int = LIMIT) -> bytes:
    if not blob:
        raise CodecError("empty chunk")
    tag, payload = blob[0], blob[1:]
    if tag == 0:
        return payload
    try:
        if tag == 1:
            reader = zlib.decompressobj(31)
            data = reader.decompress(payload, limit + 1)
            if len(data) <= limit and not reader.eof:
                raise CodecError("truncated gzip chunk")
        elif tag == 2:
            import zstandard

            size = zstandard.frame_content_size(payload)
            if size > limit:
                raise CodecError(f"chunk exceeds the {limit}-byte decompression limit")
            # a frame that hides its size is bounded here; one that lies about it is an error of the library
            data = _zstd()[1].decompress(payload, max_output_size=limit, allow_extra_data=False)
        else:
            raise CodecError(f"unknown chunk codec {tag}")
    except CodecError:
        raise
    except Exception as broken:  # the libraries' own errors for bytes that are no stream
        raise CodecError(f"broken chunk: {broken}") from broken
    if len(data) > limit:
        raise CodecError(f"chunk exceeds the {limit}-byte decompression limit")
    return data


def encode_chunk(data: Column, codec: str) -> Column:
    """Stored form of the plain bytes under a codec given by its name."""
    tag = tag_of(codec)
    if tag == 0:
        return F.concat(F.unhex(F.lit("00")), data)

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else encode(tag, v) for v in x.to_pylist()], pa.binary())

    return run(data)


def decode_chunk(blob: Column, limit: int = LIMIT) -> Column:
    """Plain bytes of a stored chunk; null where it can't be decoded."""

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        out = []
        for v in x.to_pylist():
            try:
                out.append(decode(v or b"", limit))
            except CodecError:
                out.append(None)
        return pa.array(out, pa.binary())

    return run(blob)


def parse_codec(name: Column) -> Column:
    """Tag of a codec's name, case-sensitive; null for any other name."""
    out = F.lit(None).cast("int")
    for known, tag in TAGS.items():
        out = F.when(name == known, tag).otherwise(out)
    return out


def codec_name(tag: Column) -> Column:
    out = F.format_string("codec(%d)", tag)
    for known, name in NAMES.items():
        out = F.when(tag == known, name).otherwise(out)
    return out
