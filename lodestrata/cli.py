"""Command line: backup, restore, verify, stats."""

from __future__ import annotations

import argparse
import contextlib
import getpass
import os
import sys
import threading

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import __version__
from .plans.vault import Progress, Vault, is_encrypted
from .sources.object_store import Folder, s3_settings

VARIABLE = "LODESTRATA_PASSPHRASE"


def human_bytes(n: int) -> str:
    """The column function of the same name, for one number."""
    if n < 1024:
        return f"{n} B"
    power = min((n.bit_length() - 1) // 10, 6)
    return f"{n / 1024**power:.1f} {'KMGTPE'[power - 1]}iB"


def passphrase(file: str | None, confirm: bool = False) -> bytes:
    """From the environment, else the file (its line end is cut), else asked for. An empty one is refused."""
    if os.environ.get(VARIABLE):
        given = os.environ[VARIABLE]
    elif file:
        with open(file) as f:
            given = f.read().rstrip("\r\n")
    else:
        given = getpass.getpass("passphrase: ")
        if confirm and getpass.getpass("again: ") != given:
            raise ValueError("the passphrases differ")
    if not given:
        raise ValueError("the passphrase is empty")
    return given.encode()


def _parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--vault", default="./vault")
    common.add_argument("--passphrase-file")
    common.add_argument("--no-progress", action="store_true")
    common.add_argument("--s3-endpoint")
    common.add_argument("--s3-region")
    common.add_argument("--workers", type=int, default=0, help="cores of a local session; 0: all")
    top = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("backup", parents=[common])
    p.add_argument("source")
    p.add_argument("--compress", default="zstd", choices=["none", "store", "gzip", "zstd"])
    p.add_argument("--encrypt", action="store_true")
    p = sub.add_parser("restore", parents=[common])
    p.add_argument("snapshot")
    p.add_argument("target")
    p = sub.add_parser("verify", parents=[common])
    p.add_argument("snapshot", nargs="?")
    p.add_argument("--quick", action="store_true")
    sub.add_parser("stats", parents=[common])
    return top


def _session(args: argparse.Namespace) -> SparkSession:
    builder = SparkSession.getActiveSession() or SparkSession.builder.appName("lodestrata").config("spark.ui.showConsoleProgress", str(not args.no_progress and sys.stderr.isatty()).lower())
    if isinstance(builder, SparkSession):
        return builder
    if args.workers:
        builder = builder.master(f"local[{args.workers}]")
    if args.vault.startswith("s3://"):
        for k, v in s3_settings(args.s3_endpoint, args.s3_region).items():
            builder = builder.config(f"spark.hadoop.{k}", v)
    return builder.getOrCreate()


def _table(facts: dict) -> str:
    """A line for each fact: its name, then its value; one more line for each entry of a list."""
    width = max(map(len, facts))
    out = []
    for name, value in facts.items():
        first, *more = value if isinstance(value, list) and value else ["-"] if isinstance(value, list) else [value]
        out.append(f"{name:<{width}}  {first}")
        out += [f"{'':<{width}}  {x}" for x in more]
    return "\n".join(out)


class _Shown:
    """Writes a running operation's counters to a terminal, a line that is written over."""

    def __init__(self, spark: SparkSession, progress: Progress, to) -> None:
        self.spark, self.progress, self.to = spark, progress, to
        self.done = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.done.wait(0.5):
            done, tasks = self.progress.tasks(self.spark)
            counts = " ".join(f"{k}={v}" for k, v in self.progress.snapshot().items())
            print(f"\r{done}/{tasks} tasks {counts}\x1b[K", end="", file=self.to, flush=True)

    def __enter__(self) -> _Shown:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.done.set()
        self.thread.join()
        print("\r\x1b[K", end="", file=self.to, flush=True)


def _facts(args: argparse.Namespace, vault: Vault, progress: Progress) -> dict:
    """What the command did, as names and values."""
    if args.command == "backup":
        r = vault.backup(args.source, args.compress, progress=progress)
        facts = {"snapshot": r.snapshot_id, "files_stored": r.files - r.reused, "files_reused": r.reused, "entries_left_out": r.skipped, "chunks_cut": r.total_chunks, "chunks_added": r.new_chunks, "bytes_read": r.total_bytes, "bytes_added": r.stored_bytes, "shrunk_by": f"{max(0.0, r.reduction_ratio):.1%}"}
        return facts | {"cipher": "AES-256-GCM" if vault.keys else "none"}
    if args.command == "restore":
        done = vault.restore(args.snapshot, args.target)
        return {"files_written": done["files"], "bytes_written": done["bytes"]}
    if args.command == "stats":
        s = vault.stats()
        sizes = {"logical": human_bytes(s.logical_bytes), "stored": human_bytes(s.stored_bytes), "saved": f"{human_bytes(max(0, s.saved_bytes))}, {max(0.0, s.reduction_ratio):.1%}"}
        return {"location": args.vault, "snapshot_count": s.snapshots, "chunk_count": s.unique_chunks, "reference_count": s.chunk_refs, **sizes}
    r = vault.verify(args.snapshot, args.quick, progress)
    return {"method": "names only" if args.quick else "all bytes", "chunks_seen": r.chunks, "snapshots_seen": r.snapshots, "sound": "yes" if r.ok else "no", "corrupt": r.corrupt, "missing": r.missing, "snapshots_hurt": r.broken}


def main(argv: list[str] | None = None, out=None) -> int:
    """0 if all went well, 1 if not or if a check found damage, 130 if it was interrupted."""
    args, out = _parser().parse_args(argv), out or sys.stdout
    spark = _session(args)
    try:
        sealed = Folder(spark, args.vault).exists() and is_encrypted(spark, args.vault)
        new = args.command == "backup" and args.encrypt and not sealed
        word = passphrase(args.passphrase_file, confirm=new) if sealed or new else None
        vault = Vault.open(spark, args.vault, word, create=args.command == "backup")
        progress = Progress()
        with contextlib.nullcontext() if args.no_progress or not sys.stderr.isatty() else _Shown(spark, progress, sys.stderr):
            facts = _facts(args, vault, progress)
        print(_table(facts), file=out)
        return int(facts.get("sound") == "no")
    except KeyboardInterrupt:  # the session's own handler has cancelled its jobs by now
        print("interrupted", file=sys.stderr)
        return 130
    except (ValueError, OSError, RuntimeError, PySparkException, Py4JError) as failed:
        print(f"failed: {str(failed).splitlines()[0] if str(failed) else type(failed).__name__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
