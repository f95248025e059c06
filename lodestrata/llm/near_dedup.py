"""MinHash near-dedup (operator 1): SetSketch registers, banded; joint likelihood estimate; exact check of full sets.

Plan, every table distributed and staged in the shared folder:

1. one pass over the texts makes, for each row, the size and fingerprint of its shingle set, its registers and band keys;
2. rows of equal sets fold into one class (a hash aggregate, so a group of any size folds map-side first);
3. band keys that two classes share are buckets; the full sets of their members are made once;
4. a bucket is cut into blocks of bounded members and bytes. In the first round each class goes to one block of its
   largest bucket among the first bands, where it meets the rest of the block and the bucket's pivot, which goes to all
   blocks: rows in proportion to the classes, however large a bucket is. Most members of a bucket are alike, so most are
   connected by now;
5. of all bands, buckets whose members are in one component are settled and sent nowhere; buckets with the same members
   are one. In the exact round members outside a bucket's largest component go to each of its blocks, all others to
   their own, so each pair that is not yet known to be connected meets in a cell. Where that were more than ``WIDE`` times
   a bucket's members, rounds with a pivot from among those outside and blocks dealt anew come before (``ROUNDS`` at most,
   while they connect much), over these buckets alone; what is still more goes to fewer, larger blocks, so rows stay in
   proportion to a bucket's members;
6. a cell skips pairs that are connected, drops pairs whose likelihood estimate is over four standard deviations below
   the limit, and confirms the rest on full sets; it returns a spanning forest of the confirmed links;
7. components of these links, and the smallest id of each.

Null texts, and texts without words, have an empty set and link with nothing. Rows that repeat an id are separate rows.
A null id takes part; it is never the smallest of a component unless all are null. An empty table gives no rows. Columns
other than the id and the text are not looked at, whatever their names. Sets are held as 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setsketch as ss
from .common import load, slots, stage
from .components import components, contracted

#: Classes, and bytes of their full sets, that one block holds on average. A cell is a block and what meets it there.
BLOCK, BLOCK_BYTES = 192, 32 << 20
#: Bands of the first round; rounds with further pivots before the exact one, for buckets that would otherwise be sent
#: more than so many times over.
FIRST, ROUNDS, WIDE = 4, 3, 4
#: Standard deviations that an estimate may fall below the limit before the pair is dropped unchecked.
SIGMAS = 4.0


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                sets = ss.shingle_sets(part.column(2), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                regs = ss.sketch([sets[i] for i in full])
                keys = ss.band_keys(regs)
                prints = [ss.fingerprint(s) for s in sets]
                reg_col: list = [None] * len(sets)
                key_col: list = [None] * len(sets)
                for at, i in enumerate(full):
                    reg_col[i], key_col[i] = regs[at].tobytes(), keys[at]
                yield pa.record_batch(
                    [part.column(0), part.column(1), part.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(reg_col, pa.binary()), pa.array(key_col, pa.list_(pa.int64()))],
                    ["row", "id", "mark", "n", "f1", "f2", "regs", "keys"],
                )

    return run


def _sets(k: int):
    """Texts of candidate classes to their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                sets = ss.shingle_sets(part.column("text"), k)
                same = [ss.fingerprint(s) == f for s, f in zip(sets, zip(part.column("f1").to_pylist(), part.column("f2").to_pylist(), strict=True), strict=True)]
                own = part.filter(pa.array(same, pa.bool_()))  # not another row of the same id
                yield pa.record_batch([own.column("row"), own.column("regs"), pa.array([s.tobytes() for s, x in zip(sets, same, strict=True) if x], pa.binary())], ["row", "regs", "shingles"])

    return run


def _links_of_cell(rows: list[tuple], num: int, den: int, exact: bool) -> list[tuple[int, int]]:
    """Links that span the components among the rows of one cell, each (block, wide, row, label, band, kept, regs,
    shingles), rows that go to many blocks first. Equal labels are connected already. In the exact round a pair is looked
    at in its first common bucket alone, and two wide rows in the first block alone."""
    n = len(rows)
    label = np.array([r[3] for r in rows], np.int64)
    if (label == label[0]).all():
        return []
    part, band, again = label.copy(), rows[0][4], np.array([r[0] > 0 and r[1] for r in rows])
    regs = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(n, -1)
    mine = np.zeros((n, ss.BANDS), np.int64)
    for i, r in enumerate(rows if exact else ()):
        for x in r[5]:
            mine[i, x["band"]] = x["key"]
    sets = [np.frombuffer(r[7], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    limit = num / den
    floor = limit - SIGMAS * np.sqrt(limit * (1 - limit) / regs.shape[1])
    for i in range(n - 1):
        rest = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        rest = rest[den * np.minimum(size[rest], size[i]) >= num * np.maximum(size[rest], size[i])]
        if exact and again[i]:
            rest = rest[~again[rest]]
        if exact and len(rest):
            common = (mine[rest] == mine[i]) & (mine[i] != 0)
            rest = rest[common.argmax(axis=1) == band]
        if not len(rest):
            continue
        more, less = (regs[i] > regs[rest]).sum(axis=1), (regs[i] < regs[rest]).sum(axis=1)
        near = ss.likely_jaccard(more, less, regs.shape[1] - more - less, np.full(len(rest), size[i]), size[rest]) >= floor
        for j in rest[near].tolist():
            if part[i] == part[j]:
                continue
            both = ss.common(sets[i], sets[j])
            if den * both >= num * (int(size[i]) + int(size[j]) - both):
                part[part == part[j]] = part[i]
    found = []
    for at in np.unique(part[part != label]):
        inside = np.flatnonzero(part == at)
        ends = inside[np.unique(label[inside], return_index=True)[1]]
        root = rows[int(ends.max())][2]  # not the pivot, which is in every cell of its bucket
        found += [(rows[int(x)][2], root) for x in ends if rows[int(x)][2] != root]
    return found


def _confirm(num: int, den: int, exact: bool):
    """Rows sorted by cell, wide rows first, to links; a cell may run over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def links() -> pa.RecordBatch:
            got = _links_of_cell(rows, num, den, exact) if len(rows) > 1 else []
            return pa.record_batch([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

        parts = (batch.slice(start, 512) for batch in batches for start in range(0, len(batch), 512))  # few rows are Python objects at a time
        for part in parts:
            for key, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (key, row[0]) != at:
                    if rows:
                        yield links()
                    at, rows = (key, row[0]), []
                elif row[2] in (rows[0][2], rows[-1][2]):
                    continue  # the same class again: a pivot in its own block, or from a repeated id
                rows.append(tuple(row))
        if rows:
            yield links()

    return run


def _met(held: DataFrame, jobs: DataFrame, num: int, den: int, turn: int, exact: bool) -> DataFrame:
    """Links found where classes meet. jobs: row, label and kept, the buckets it goes to: key, band, blocks, wide (whether
    to all blocks of the bucket)."""
    rows = held.join(jobs, "row").select("row", "label", "kept", "regs", "shingles", F.explode("kept").alias("x"))
    own = F.array(F.pmod(F.xxhash64("row", "x.key", F.lit(turn)), F.col("x.blocks")).cast("int"))
    block = F.explode(F.when(F.col("x.wide"), F.sequence(F.lit(0), (F.col("x.blocks") - 1).cast("int"))).otherwise(own))
    dealt = rows.select("x.key", block.alias("block"), "x.wide", "row", "label", "x.band", "kept", "regs", "shingles")
    dealt = dealt.repartition(slots(held.sparkSession), "key", "block").sortWithinPartitions("key", "block", F.desc("wide"), "row")
    return stage(dealt.mapInArrow(_confirm(num, den, exact), "a long, b long"), "links")


def _blocks(members: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(shingles) * 8 / BLOCK_BYTES)).alias("blocks")


def _entries(classes: DataFrame, bands: int = ss.BANDS, more: tuple[str, ...] = ()) -> DataFrame:
    return classes.select("row", "n", *more, F.posexplode(F.slice("keys", 1, bands)).alias("band", "key"))


def _buckets(classes: DataFrame) -> DataFrame:
    """Band keys that classes share: key, members, blocks, pivot."""
    pivot = F.min(F.struct(F.xxhash64("row", F.lit(0)).alias("lot"), "row"))["row"].alias("pivot")
    found = _entries(classes).groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), pivot)
    return found.where("members > 1").select("key", "members", _blocks("members", "shingles"), "pivot")


def _first_jobs(classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each class in its largest bucket of the first bands, and in all where it is the pivot of several blocks."""
    job = lambda wide: F.struct("key", "band", "blocks", F.lit(wide).alias("wide"))
    pivots = F.collect_list(F.when((F.col("row") == F.col("pivot")) & (F.col("blocks") > 1), job(True)))
    largest = F.array(F.max_by(job(False), F.struct("members", "key")))
    placed = _entries(classes, FIRST).join(buckets, "key")
    return placed.groupBy("row").agg(F.col("row").alias("label"), F.concat(pivots, largest).alias("kept"))


def _connected(held: DataFrame, classes: DataFrame, jobs: DataFrame, num: int, den: int) -> DataFrame:
    """Components of the confirmed links: node, label. classes: row, n, keys, of all classes that share a band key."""
    edges = contracted(_met(held, jobs, num, den, 0, False), "a", "b", 1)
    turn, before = 0, None
    while True:
        turn += 1
        labels = edges.groupBy(F.col("u").alias("row")).agg(F.min("v").alias("label"))
        placed = classes.join(labels, "row", "left").select("row", "n", "keys", F.coalesce("label", "row").alias("label"))
        placed = _entries(placed, more=("label",))
        lot = F.xxhash64("row", F.lit(3))
        parts = placed.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"), F.sum(lot % F.lit(1 << 40)).alias("s1"), F.bit_xor(lot).alias("s2"))
        whole = [F.count("*").alias("parts"), F.sum("c").alias("members"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("main")]
        whole += [F.sum("shingles").alias("shingles"), F.sum("s1").alias("s1"), F.bit_xor("s2").alias("s2")]
        unsettled = parts.groupBy("key").agg(*whole).where("parts > 1")
        unsettled = unsettled.select("key", "main", "members", "s1", "s2", (F.col("members") - F.col("most")).alias("outside"), _blocks("members", "shingles"))
        # buckets of the same members are one
        unsettled = stage(unsettled.groupBy("members", "s1", "s2").agg(F.min(F.struct("key", "main", "outside", "blocks")).alias("x")).select("members", "x.*"), "unsettled")
        hard = (F.col("blocks") > 1) & (F.col("outside") * F.col("blocks") > WIDE * F.col("members"))
        left = unsettled.where(hard).agg(F.sum("outside")).first()[0] or 0
        exact = turn > ROUNDS or not left or before is not None and left > 0.7 * before
        before = left
        jobs = _exact_jobs(placed, unsettled) if exact else _pivot_jobs(placed, unsettled.where(hard), turn)
        found = edges.select("u", "v").union(_met(held, jobs, num, den, turn, exact).select("a", "b"))
        if exact:
            return components(found, "u", "v")
        edges = contracted(found, "u", "v", 1)


def _exact_jobs(placed: DataFrame, unsettled: DataFrame) -> DataFrame:
    """Each class in all its unsettled buckets, in all blocks of those where it is outside the largest component. Blocks
    are so few that this sends no bucket more than ``WIDE`` times over besides once: cells, which hold all that is
    outside anyway, grow by one part in ``WIDE`` at most."""
    few = F.least("blocks", F.greatest(F.floor(WIDE * F.col("members") / F.col("outside")), F.lit(1)))
    here = placed.join(unsettled.withColumn("blocks", few), "key")
    wide = (F.col("blocks") > 1) & (F.col("label") != F.col("main"))
    return here.groupBy("row").agg(F.min("label").alias("label"), F.collect_list(F.struct("key", "band", "blocks", wide.alias("wide"))).alias("kept"))


def _pivot_jobs(placed: DataFrame, hard: DataFrame, turn: int) -> DataFrame:
    """Each class in one block of that hard bucket of its own with the most outside, and one class from outside the
    largest component in all blocks of the bucket. Other buckets are not joined."""
    here = stage(placed.join(hard, "key"), "here")
    job = lambda wide: F.struct("key", "band", "blocks", F.lit(wide).alias("wide")).alias("job")
    lot = F.struct(F.xxhash64("row", F.lit(turn)).alias("lot"), "row", "label", "band", "blocks")
    pivots = here.where("label <> main").groupBy("key").agg(F.min(lot).alias("x")).select("key", "x.*")
    own = here.groupBy("row").agg(F.min("label").alias("label"), F.max_by(job(False), F.struct("outside", "key")).alias("job"))
    both = own.union(pivots.select("row", "label", job(True)))
    return both.groupBy("row").agg(F.min("label").alias("label"), F.collect_list("job").alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, first.

    Links pairs with ``den * |A & B| >= num * |A | B|`` over distinct k-word shingles. component_id is the smallest id
    reachable, ``first`` marks exactly one row of each component (of its smallest id; of rows that repeat it, one).
    An empty set links with nothing: its row is its own component.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    kind = docs.schema[id_col].dataType.simpleString()
    made = texts.select(F.monotonically_increasing_id().alias("row"), "id", "text", "mark").mapInArrow(_sketches(k), f"row long, id {kind}, mark long, n long, f1 long, f2 long, regs binary, keys array<long>")
    sketched = stage(made, "sketch")

    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    classes = stage(sketched.where("n > 0").groupBy("f1", "f2", "n").agg(least).select("f1", "f2", "n", F.col("least.row").alias("rep"), "least"), "classes")
    reps = stage(sketched.join(classes.select(F.col("rep").alias("row")), "row", "left_semi"), "reps")

    buckets = stage(_buckets(reps), "buckets")
    jobs = stage(_first_jobs(reps, buckets), "jobs")
    others = _entries(reps.join(jobs, "row", "left_anti")).join(buckets, "key", "left_semi").select("row").distinct()
    wanted = stage(reps.join(jobs.select("row").union(others), "row"), "wanted")

    same = wanted["id"].eqNullSafe(texts["id"]) & (wanted["mark"] == texts["mark"])
    held = wanted.hint("shuffle_hash").join(texts, same).select("row", "f1", "f2", "regs", "text").mapInArrow(_sets(k), "row long, regs binary, shingles binary")
    labels = _connected(stage(held, "sets"), wanted.select("row", "n", "keys"), jobs, num, den).withColumnsRenamed({"node": "rep"})

    joined = classes.join(labels, "rep", "left")
    heads = joined.where("label is not null").groupBy("label").agg(F.min("least").alias("head"))
    joined = stage(joined.join(heads, "label", "left").select("f1", "f2", "n", F.coalesce("head", "least").alias("head")), "joined")
    rows = sketched.select("row", "id", "n", "f1", "f2").join(joined, ["f1", "f2", "n"], "left")
    return rows.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head.id")).otherwise(F.col("id")).alias("component_id"), ((F.col("n") == 0) | (F.col("row") == F.col("head.row"))).alias("first"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id, kept, over sets of 4-word shingles and a similarity of 0.8."""
    found = near_duplicates(load(spark, sf_dir, "documents"), k=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, text_col: str = "text", k: int = 5) -> DataFrame:
    """The rows of ``docs``, with their columns, of which one of each group of near copies stays.

    The row that stays is the group's first by its position in ``docs``, whatever its other columns hold.
    """
    rec = stage(docs.select(F.struct("*").alias("rec"), F.monotonically_increasing_id().alias("pos")), "dedup")
    found = near_duplicates(rec.select("pos", F.col("rec").getField(text_col).alias("text")), id_col="pos", text_col="text", k=k)
    return rec.join(found.where("first").select(F.col("id").alias("pos")), "pos", "left_semi").select("rec.*")
