import json
import os
import stat

import pytest

from lodestrata.functions.paths import UnsafePath
from lodestrata.functions.seal import NotEncrypted, PassphraseRequired, WrongPassphrase
from lodestrata.plans.vault import Cancelled, IntegrityError, Progress, Vault, is_encrypted
from lodestrata.sources.object_store import NotFound
from lodestrata.sources.tree import scan_tree


def fill(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def content(root):
    out = {}
    for at, _, names in os.walk(root):
        for n in names:
            p = os.path.join(at, n)
            if not os.path.islink(p):
                with open(p, "rb") as f:
                    out[os.path.relpath(p, root)] = (f.read(), stat.S_IMODE(os.stat(p).st_mode))
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory, random_bytes):
    """A tree, a vault with two runs over it, and their results."""
    base = tmp_path_factory.mktemp("made")
    root = base / "src"
    fill(root, {"README.md": b"# read me\n", "empty": b"", ".dot": b"hidden", "bin/tool.sh": b"#!/bin/sh\n", "data/big.bin": random_bytes(1, 300_000), "data/nested/note.txt": b"note", "data/copy.bin": random_bytes(1, 300_000)})
    (root / "bin/tool.sh").chmod(0o755)
    (root / "data/nested/note.txt").chmod(0o600)
    (root / "hollow/inner").mkdir(parents=True)
    (root / "hollow/inner").chmod(0o750)
    (root / "link").symlink_to("README.md")
    vault = Vault.open(spark, str(base / "v"), create=True)
    progress = Progress()
    first = vault.backup(str(root), average=4096, snapshot_id="20240101T000000Z-00000001", progress=progress)
    second = vault.backup(str(root), average=4096, snapshot_id="20240101T000001Z-00000002")
    return base, vault, first, second, progress


def test_tree(spark, made):
    rows = {r["path"]: r for r in scan_tree(spark, str(made[0] / "src")).collect()}
    assert rows["link"]["kind"] == "other" and rows["empty"]["size"] == 0 and ".dot" in rows and "." not in rows
    assert rows["hollow/inner"]["mode"] == (1 << 31) | 0o750 and rows["bin/tool.sh"]["mode"] == 0o755
    assert rows["README.md"]["mtime_ns"] == os.stat(made[0] / "src/README.md").st_mtime_ns


def test_results(made):
    _, _, first, second, progress = made
    assert (first.files, first.reused, first.skipped) == (7, 0, 1)
    assert first.total_bytes == 600_000 + 10 + 6 + 10 + 4 and first.new_chunks < first.total_chunks
    assert (second.files, second.reused, second.total_chunks, second.new_chunks, second.stored_bytes) == (7, 7, 0, 0, 0)
    seen = progress.snapshot()
    assert seen["chunks_read"] == first.total_chunks and seen["bytes_read"] == progress.total_bytes == first.total_bytes


def test_restore(made):
    base, vault, first, second, _ = made
    done = vault.restore(second.snapshot_id, str(base / "out"))
    assert content(base / "out") == content(base / "src") and done["files"] == 7 and done["bytes"] == first.total_bytes
    assert stat.S_IMODE(os.stat(base / "out/hollow/inner").st_mode) == 0o750


def test_stats_and_verify(made):
    _, vault, first, second, _ = made
    s = vault.stats()
    assert s.snapshots == 2 and s.logical_bytes == 2 * first.total_bytes and s.chunk_refs == 2 * first.total_chunks > s.unique_chunks and s.reduction_ratio > 0
    for r in (vault.verify(), vault.verify(quick=True), vault.verify(first.snapshot_id)):
        assert r.ok and r.chunks == s.unique_chunks and not r.broken
    assert vault.list_snapshots() == [first.snapshot_id, second.snapshot_id]
    assert vault.stats_by_snapshot().count() == 2


def test_incremental(spark, tmp_path, random_bytes):
    root = tmp_path / "s"
    fill(root, {"stable.bin": random_bytes(1, 30_000), "changing.bin": random_bytes(2, 30_000)})
    vault = Vault.open(spark, str(tmp_path / "v"), create=True)
    assert vault.backup(str(root), average=4096).reused == 0
    fill(root, {"changing.bin": random_bytes(3, 30_000), "added.bin": random_bytes(4, 10_000)})
    later = os.stat(root / "changing.bin").st_mtime_ns + 2 * 10**9
    os.utime(root / "changing.bin", ns=(later, later))
    (root / "stable.bin").chmod(0o640)
    again = vault.backup(str(root), average=4096, snapshot_id="99990101T000000Z-00000000")
    assert (again.reused, again.files) == (1, 3)
    vault.restore(again.snapshot_id, str(tmp_path / "o"))
    assert content(tmp_path / "o") == content(root)
    fill(tmp_path / "s2", {"stable.bin": random_bytes(1, 30_000)})
    other = vault.backup(str(tmp_path / "s2"), average=4096)
    assert other.reused == 0 and other.new_chunks == 0


def test_damage(spark, tmp_path, random_bytes):
    fill(tmp_path / "s", {"a.bin": random_bytes(7, 40_000)})
    vault = Vault.open(spark, str(tmp_path / "v"), create=True)
    run = vault.backup(str(tmp_path / "s"), "none", average=4096)
    chunks = vault.chunks().collect()
    bad, gone = sorted(r["chunk_id"] for r in chunks)[:2]
    rows = [(r["chunk_id"], bytearray(b"\0changed") if r["chunk_id"] == bad else r["blob"], r["raw_size"], r["stored_size"], r["codec"], r["shard"]) for r in chunks if r["chunk_id"] != gone]
    frame = spark.createDataFrame(rows, vault.chunks().schema)
    vault.folder.drop("chunks")
    frame.write.partitionBy("shard").parquet(vault.folder.at("chunks"))
    deep, quick = vault.verify(), vault.verify(run.snapshot_id, quick=True)
    assert (deep.corrupt, deep.missing, deep.broken, deep.ok) == ([bad], [gone], [run.snapshot_id], False)
    assert (quick.corrupt, quick.missing) == ([], [gone])
    with pytest.raises(Exception, match="integrity check"):
        vault.restore(run.snapshot_id, str(tmp_path / "o"))


def test_encrypted(spark, tmp_path):
    fill(tmp_path / "s", {"secret-name.txt": b"MARKER" * 2000})
    where = str(tmp_path / "v")
    vault = Vault.open(spark, where, "pw", create=True)
    run = vault.backup(str(tmp_path / "s"), "none")
    assert is_encrypted(spark, where)
    for at, _, names in os.walk(where):
        for n in names:
            with open(os.path.join(at, n), "rb") as f:
                data = f.read()
            assert b"MARKER" not in data and b"secret-name" not in data
    with pytest.raises(PassphraseRequired):
        Vault.open(spark, where)
    with pytest.raises(WrongPassphrase):
        Vault.open(spark, where, "no")
    again = Vault.open(spark, where, "pw")
    assert again.backup(str(tmp_path / "s"), snapshot_id="99990101T000000Z-00000000").reused == 1
    assert again.verify().ok
    again.restore(run.snapshot_id, str(tmp_path / "o"))
    assert content(tmp_path / "o") == content(tmp_path / "s")


def test_opening(spark, tmp_path):
    with pytest.raises(NotFound):
        Vault.open(spark, str(tmp_path / "none"))
    fill(tmp_path / "s", {"a": b"a"})
    vault = Vault.open(spark, str(tmp_path / "v"), create=True)
    assert vault.stats().unique_chunks == 0 and vault.verify().ok
    vault.backup(str(tmp_path / "s"))
    for create in (False, True):
        with pytest.raises(NotEncrypted):
            Vault.open(spark, str(tmp_path / "v"), "pw", create=create)


def test_failed_run_publishes_nothing(spark, tmp_path):
    vault = Vault.open(spark, str(tmp_path / "v"), create=True)
    with pytest.raises(Exception):  # noqa: B017
        vault.backup(str(tmp_path / "absent"))
    assert vault.list_snapshots() == [] and not vault.folder.exists("staging/x")


def test_hostile_and_swapped_manifests(spark, made, tmp_path):
    _, vault, first, _, _ = made
    fill(tmp_path / "s", {"a": b"a"})
    mine = Vault.open(spark, str(tmp_path / "v"), create=True)
    run = mine.backup(str(tmp_path / "s"))
    rows = [(1, "../escape.txt", 1, 0o644, 0, [])]
    spark.createDataFrame(rows, "ordinal long, path string, size long, mode long, mtime_ns long, chunks array<string>").write.mode("append").parquet(mine.folder.at(f"files/snapshot_id={run.snapshot_id}"))
    with pytest.raises(UnsafePath, match="outside"):
        mine.restore(run.snapshot_id, str(tmp_path / "o"))
    assert not (tmp_path / "escape.txt").exists()
    mine.folder.put("snapshots/20240101T000000Z-ffffffff.json", json.dumps({"id": run.snapshot_id, "source": "s"}).encode())
    with pytest.raises(IntegrityError, match="names itself"):
        mine.load_snapshot("20240101T000000Z-ffffffff")


def test_table_as_source(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"x" * 9000), 1), ("b", bytearray(b""), 1), ("c", bytearray(b"x" * 9000), 1)], "path string, content binary, mtime_ns long")
    vault = Vault.open(spark, str(tmp_path / "v"), create=True)
    run = vault.backup_table(rows, "table", average=1024)
    assert run.files == 3 and run.total_bytes == 18000 and vault.verify().ok
    assert vault.backup_table(rows, "table", snapshot_id="99990101T000000Z-00000000").reused == 3
    vault.restore(run.snapshot_id, str(tmp_path / "o"))
    assert {k: v[0] for k, v in content(tmp_path / "o").items()} == {"a": b"x" * 9000, "b": b"", "c": b"x" * 9000}


def test_a_killed_encrypted_run_leaves_no_names(spark, tmp_path, monkeypatch):
    root = fill(tmp_path / "s", {f"payroll-{i}.bin": bytes([i]) * 50 for i in range(4)})
    vault = Vault.open(spark, str(tmp_path / "v"), "pw", create=True)
    monkeypatch.setattr(type(vault.folder), "drop", lambda self, key: None)
    run = vault.backup(root)
    assert any((tmp_path / "v/staging").rglob("*.parquet"))
    assert not [p for p in (tmp_path / "v").rglob("*") if p.is_file() and b"payroll" in p.read_bytes()]
    assert vault.restore(run.snapshot_id, str(tmp_path / "o"))["files"] == 4 and content(tmp_path / "o") == content(root)


def test_cancelled_run_publishes_nothing(spark, tmp_path):
    import threading

    root = fill(tmp_path / "s", {f"{i}.bin": os.urandom(2000) for i in range(300)})
    vault = Vault.open(spark, str(tmp_path / "v"), create=True)
    said = []

    def work():
        try:
            vault.backup(root, average=64)
        except Exception as e:
            said.append(e)

    runner = threading.Thread(target=work)
    runner.start()
    while runner.is_alive() and not said:
        vault.cancel()
        runner.join(0.05)
    assert [type(e) for e in said] == [Cancelled] and vault.list_snapshots() == [] and not (tmp_path / "v/staging").exists() or not os.listdir(tmp_path / "v/staging")
    assert vault.backup(root).files == 300


def test_get_chunk(made):
    vault = made[1]
    row = vault.chunks().select("chunk_id").first()
    import hashlib

    assert hashlib.sha256(vault.get_chunk(row["chunk_id"])).hexdigest() == row["chunk_id"]
    with pytest.raises(NotFound):
        vault.get_chunk("0" * 64)
