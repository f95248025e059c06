import io

import pytest

from lodestrata import cli


def run(*argv):
    out = io.StringIO()
    return cli.main([*argv, "--no-progress"], out), out.getvalue()


def test_end_to_end(spark, tmp_path, monkeypatch):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.txt").write_text("hello " * 5000)
    v = str(tmp_path / "v")
    monkeypatch.setenv(cli.VARIABLE, "pw")
    code, said = run("backup", str(tmp_path / "s"), "--vault", v, "--encrypt")
    facts = dict(line.split(maxsplit=1) for line in said.splitlines())
    assert code == 0 and facts["chunks_cut"] == facts["chunks_added"] == "1" and facts["cipher"] == "AES-256-GCM"
    snapshot = facts["snapshot"]
    code, said = run("backup", str(tmp_path / "s"), "--vault", v)
    facts = dict(line.split(maxsplit=1) for line in said.splitlines())
    assert code == 0 and facts["files_reused"] == "1" and facts["chunks_added"] == "0"
    code, said = run("verify", "--vault", v)
    facts = dict(line.split(maxsplit=1) for line in said.splitlines())
    assert code == 0 and facts["sound"] == "yes" and (facts["chunks_seen"], facts["snapshots_seen"]) == ("1", "2")
    code, said = run("stats", "--vault", v)
    assert code == 0 and dict(line.split(maxsplit=1) for line in said.splitlines())["snapshot_count"] == "2"
    code, said = run("restore", snapshot, str(tmp_path / "o"), "--vault", v)
    assert code == 0 and (tmp_path / "o/a.txt").read_text() == "hello " * 5000
    monkeypatch.setenv(cli.VARIABLE, "other")
    assert run("stats", "--vault", v)[0] == 1


def test_arguments(spark, tmp_path):
    for bad in ([], ["backup"], ["restore", "x"], ["backup", "x", "--compress", "lz4"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    assert run("stats", "--vault", str(tmp_path / "none"))[0] == 1


def test_passphrase(tmp_path, monkeypatch):
    monkeypatch.delenv(cli.VARIABLE, raising=False)
    (tmp_path / "p").write_text("word\r\n")
    assert cli.passphrase(str(tmp_path / "p")) == b"word"
    (tmp_path / "p").write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        cli.passphrase(str(tmp_path / "p"))
    monkeypatch.setenv(cli.VARIABLE, "env")
    assert cli.passphrase(str(tmp_path / "p")) == b"env"


def test_damage_is_told_and_not_raised(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.txt").write_text("hello")
    v = tmp_path / "v"
    assert run("backup", str(tmp_path / "s"), "--vault", str(v))[0] == 0
    part = next((v / "chunks").rglob("*.parquet"))
    part.write_bytes(part.read_bytes()[: part.stat().st_size // 2])
    for x in part.parent.glob(".*.crc"):
        x.unlink()
    for more in ((), ("--quick",)):
        code, said = run("verify", "--vault", str(v), *more)
        assert code == 1 and "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824" in said.split("missing")[0]
    assert run("restore", "nothing", str(tmp_path / "o"), "--vault", str(v))[0] == 1
