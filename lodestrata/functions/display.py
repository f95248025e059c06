"""Numbers as people read them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "KMGTPE"


def human_bytes(n: Column) -> Column:
    """Bytes below 1024 as they are, else one decimal of the largest unit that is not above; halves round to even."""
    shown = F.format_string("%d B", n)
    for power, unit in enumerate(UNITS, 1):
        value = F.bround((n.cast("double") / float(1024**power)).cast("decimal(38,18)"), 1).cast("double")
        shown = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}iB", value)).otherwise(shown)
    return shown


def non_neg(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("long"))


def non_neg_ratio(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def fraction(done: Column, total: Column) -> Column:
    """Progress from 0 to 1; 0 while the total is unknown."""
    return F.when(total <= 0, 0.0).when(done >= total, 1.0).otherwise(done / total)


def saved_bytes(logical: Column, stored: Column) -> Column:
    return logical - stored


def reduction_ratio(logical: Column, stored: Column) -> Column:
    """Share of the logical bytes that are not stored; 0 of nothing."""
    return F.when(logical == 0, 0.0).otherwise((logical - stored) / logical)
