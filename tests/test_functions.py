import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import codec, display, ids, paths, seal


@pytest.mark.parametrize("name", ["none", "gzip", "zstd"])
def test_codec_round_trip(random_bytes, name):
    for data in (b"", b"hello", b"hello world" * 2000, random_bytes(9, 4096)):
        blob = codec.encode(codec.tag_of(name), data)
        assert codec.decode(blob) == data and len(blob) <= len(data) + 1


@pytest.mark.parametrize("name", ["gzip", "zstd"])
def test_codec_shrinks_or_falls_back(random_bytes, name):
    tag = codec.tag_of(name)
    assert len(codec.encode(tag, b"hello world" * 2000)) < 2000
    plain = codec.encode(tag, random_bytes(11, 16384))
    assert plain[0] == 0 and len(plain) == 16385


@pytest.mark.parametrize("name", ["gzip", "zstd"])
def test_codec_limit(name):
    blob = codec.encode(codec.tag_of(name), bytes(10_000))
    with pytest.raises(codec.CodecError, match="limit"):
        codec.decode(blob, 100)
    assert len(codec.decode(blob, 10_000)) == 10_000


@pytest.mark.parametrize("blob", [b"", b"\x07abc", b"\x01garbage", b"\x02garbage", b"\x02", b"\x01"])
def test_codec_garbage(blob):
    with pytest.raises(codec.CodecError):
        codec.decode(blob)


def test_codec_truncated():
    for name in ("gzip", "zstd"):
        blob = codec.encode(codec.tag_of(name), b"hello world" * 2000)
        with pytest.raises(codec.CodecError):
            codec.decode(blob[:-6])


def test_codec_names():
    assert [codec.tag_of(n) for n in ("none", "store", "gzip", "zstd")] == [0, 0, 1, 2]
    with pytest.raises(codec.CodecError):
        codec.tag_of("ZSTD")


def test_codec_columns(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 500),), (bytearray(b""),), (None,)], "d binary")
    for name in ("none", "gzip", "zstd"):
        assert [bytes(r[0]) if r[0] is not None else None for r in df.select(codec.decode_chunk(codec.encode_chunk(F.col("d"), name))).collect()] == [b"x" * 500, b"", None]


def test_keyed_ids(spark):
    for key in (b"k", b"long" * 40):
        inner, outer = ids.hmac_pads(key)
        row = spark.createDataFrame([(bytearray(b"data"), bytearray(inner), bytearray(outer))], "d binary, i binary, o binary")
        assert row.select(ids.chunk_id_keyed(F.col("d"), F.col("i"), F.col("o"))).first()[0] == hmac.new(key, b"data", hashlib.sha256).hexdigest()


def test_seal(spark):
    keys = seal.Keys.of(b"m" * 32)
    df = seal.with_keys(spark.createDataFrame([(bytearray(b"attack at dawn"),)], "d binary"), keys)
    blob = bytes(df.select(seal.seal(F.col("d"), F.col("seal_key"))).first()[0])
    assert len(blob) == 14 + 28 and b"attack" not in blob

    def opened(b, k):
        return seal.with_keys(spark.createDataFrame([(bytearray(b),)], "b binary"), k).select(seal.open_sealed(F.col("b"), F.col("seal_key"))).first()[0]

    assert bytes(opened(blob, keys)) == b"attack at dawn"
    assert opened(blob[:-1] + bytes([blob[-1] ^ 1]), keys) is None
    assert opened(b"abc", keys) is None
    assert opened(blob, seal.Keys.of(b"n" * 32)) is None


def test_keys_are_not_in_the_plan(spark):
    keys = seal.Keys(b"S" * 32, b"N" * 32)
    df = seal.with_keys(spark.createDataFrame([(bytearray(b"x"),)], "d binary"), keys)
    plan = df.select(seal.seal(F.col("d"), F.col("seal_key")))._jdf.queryExecution().toString()
    assert "SSSS" not in plan and (b"S" * 8).hex().upper() not in plan.upper()


def test_config():
    config, keys = seal.new_config(b"pw")
    assert seal.open_config(config, b"pw") == keys
    with pytest.raises(seal.WrongPassphrase):
        seal.open_config(config, b"other")


def test_hkdf_is_the_standard_one():
    # RFC 5869, test case 3: no salt, no info
    assert seal.hkdf(b"\x0b" * 22, "", 42).hex() == "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"


@pytest.mark.parametrize(("n", "shown"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (1 << 20, "1.0 MiB"), (5 << 20, "5.0 MiB"), (1 << 30, "1.0 GiB"), (1280, "1.2 KiB"), (1 << 60, "1.0 EiB")])
def test_human_bytes(spark, n, shown):
    from lodestrata.cli import human_bytes

    assert spark.range(1).select(display.human_bytes(F.lit(n).cast("long"))).first()[0] == shown == human_bytes(n)


@pytest.mark.parametrize(("path", "safe"), [("../evil", False), ("../../etc/passwd", False), ("/abs/path", False), ("sub/ok.txt", True), ("a/../..", False), ("a/../b", True), ("..x", True)])
def test_safe_paths(spark, path, safe):
    assert spark.createDataFrame([(path,)], "p string").select(paths.is_safe(F.col("p"))).first()[0] == safe
    if safe:
        assert paths.safe_join("/t", path).startswith("/t/")
    else:
        with pytest.raises(paths.UnsafePath, match="outside"):
            paths.safe_join("/t", path)


def test_fraction(spark):
    rows = spark.createDataFrame([(0, 0), (5, 10), (10, 10), (12, 10), (1, -1)], "d long, t long")
    assert [r[0] for r in rows.select(display.fraction(F.col("d"), F.col("t"))).collect()] == [0.0, 0.5, 1.0, 1.0, 0.0]
