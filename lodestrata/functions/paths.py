"""Paths inside a snapshot, as column expressions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnsafePath(ValueError):
    """A path that would leave the folder it is restored to."""


def safe_join(target: str, relative: str) -> str:
    clean = posixpath.normpath(relative or ".")
    if clean == ".." or clean.startswith(("../", "/")):
        raise UnsafePath(f"{relative!r} would lie outside the target folder")
    return posixpath.normpath(posixpath.join(target, clean))


def is_safe(path: Column) -> Column:
    """Whether a relative path stays inside its root: it is not absolute, and no prefix of it climbs above the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depths = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda s, p: F.struct(
            (s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"),
            F.least(s["least"], s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("least"),
        ),
        lambda s: s["least"],
    )
    return ~path.startswith("/") & (depths >= 0)


def relative_path(path: Column, root: str) -> Column:
    """Path relative to a root folder; the root itself is '.'."""
    base = root.rstrip("/")
    return F.when(path == base, ".").otherwise(F.substring(path, len(base) + 2, 1 << 30))
