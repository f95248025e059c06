"""Mixing sources to target weights (operator 4): subset-sum budget fitting.

1. Documents are counted by source and exact length in words: a histogram, far smaller than the table.
2. Every source has a target from the weights. A source takes each of its documents as many whole times as the target
   holds its size; what is left is its budget.
3. The budget is filled from the histogram: of every length the same share of documents, what is left of the shares dealt
   out by seed, and the difference closed by a bounded-knapsack dynamic programme that may undo what was dealt to the
   lengths it is given: 64 by seed, twice as many while the total is not exact, in the end all, shares included.
4. Of each length the wanted number of documents is chosen by a seeded hash. Where a length has very many documents, the
   hash first deals them into buckets; counts of buckets say which are taken whole, and only one is ranked.

The histogram is fitted in one task for each source, on at most one row for each distinct length; no other step needs
the rows of one source, length or copy group in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import load, stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 20240611
#: Documents of one length that one bucket holds on average.
BUCKET = 4096
#: How many lengths the dynamic programme is given at first; its most steps times totals once that is not enough.
ITEMS, WORK = 64, 1 << 29
#: Bytes of texts whose words are counted at a time.
PIECE = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def _piece_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of words of each of consecutive texts. at: where each starts, and where the last one ends."""
    out = np.zeros(len(at) - 1, np.int64)
    if not len(data):
        return out
    inside = ~_BREAK[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    some = np.flatnonzero(at[1:] > at[:-1])
    start[at[some]] = inside[at[some]]
    out[some] = np.add.reduceat(start, at[some], dtype=np.int64)
    return out


def count_words(texts: pa.Array) -> np.ndarray:
    """Number of words of each text, runs of anything but ASCII white space; 0 for null. In pieces of bounded size, or of
    one text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    out = np.zeros(len(texts), np.int64)
    if data is None or not len(texts):
        return out
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, low = np.frombuffer(data, np.uint8), 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE, side="right")) - 1)
        out[low:high] = _piece_counts(data[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high
    return out


@F.arrow_udf(LongType())
def _size(texts: pa.Array) -> pa.Array:
    return pa.array(count_words(texts), pa.int64())


def targets(sizes: list[tuple], weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Target words of each source, given (source, size) in order; weights repeat along the order.

    All targets together equal all sizes. A target stops at ``most`` times its source's size, and the excess goes to the
    others by weight, until none is above.
    """
    size = [float(s) for _, s in sizes]
    weight = [weights[i % len(weights)] for i in range(len(size))]
    out = [0.0] * len(size)
    free, left = [i for i in range(len(size)) if size[i] > 0], float(sum(size))
    while free:
        whole = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / whole > most * size[i]]
        if not over:
            for i in free:
                out[i] = left * weight[i] / whole
            break
        for i in over:
            out[i] = most * size[i]
        left -= sum(out[i] for i in over)
        full = set(over)
        free = [i for i in free if i not in full]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length, at most its count, sum to the reachable total nearest to ``budget``.

    Exact dynamic programme over totals: for each length the least number used to reach a total that shorter prefixes of
    the list do not reach. Of two equally near totals the smaller is taken.
    """
    room = budget + max(lengths, default=0)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1, np.int32)
    used = np.zeros(room + 1, np.int32)  # of the length in ``by``
    for at, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        fresh = np.zeros(room + 1, bool)
        front = reached.copy()
        for k in range(1, min(count, room // length) + 1):
            step = np.zeros(room + 1, bool)
            step[length:] = front[:-length]
            step &= ~reached & ~fresh
            if not step.any():
                break
            fresh |= step
            used[step], by[step] = k, at
            front = step
        reached |= fresh
        if reached[budget]:
            break
    totals = np.flatnonzero(reached)
    total = int(totals[np.argmin(np.abs(totals - budget))])
    taken = [0] * len(lengths)
    while total:
        at = int(by[total])
        taken[at] = int(used[total])
        total -= taken[at] * lengths[at]
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, spare: int = 1, seed: tuple[int, ...] = (SEED,)) -> np.ndarray:
    """How many copies of documents of each length to take, at most ``spare`` of each document, so that their words sum
    to ``budget`` as nearly as may be."""
    counts = counts * spare
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts
    share = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    rest = np.array([int(c) * budget % total / total for c in counts.tolist()])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(lengths))
    dealt = np.zeros(len(lengths), np.int64)
    dealt[order] = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(rest[order]))) + rng.random())).astype(np.int64)
    best = np.minimum(share + dealt, counts)
    order = order[lengths[order] > 0]
    for least in (share, np.zeros_like(share)):  # in the end the shares may be undone too
        size = min(ITEMS, len(order))
        while True:
            miss = budget - int((best * lengths).sum())
            if not miss:
                return best
            pool = order[:size]
            goal = miss + int(((best - least)[pool] * lengths[pool]).sum())
            free = (counts - least)[pool]
            room = goal + int(lengths[pool].max())
            if size > ITEMS and int(np.minimum(free, room // lengths[pool]).sum()) * room > WORK:
                break
            if goal >= 0:
                again = best.copy()
                again[pool] = least[pool] + np.array(knapsack(lengths[pool].tolist(), free.tolist(), goal))
                if abs(budget - int((again * lengths).sum())) < abs(miss):
                    best = again
            if size == len(order):
                break
            size = min(2 * size, len(order))
    return best


def _fit_source(pdf: pd.DataFrame, seed: int = SEED) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    target, whole = float(pdf["target"].iloc[0]), int((lengths * counts).sum())
    base = min(MOST, int(target // whole)) if whole else 0
    budget = round(target - base * whole) if base < MOST else 0
    lot = (seed, int(pdf["source_no"].iloc[0]))
    more = fit(lengths, counts, budget, seed=lot)
    if base + 1 < MOST and (lengths * more).sum() != budget:  # few documents: further copies of some come nearer
        again = fit(lengths, counts, budget, MOST - base, lot)
        if abs((lengths * again).sum() - budget) < abs((lengths * more).sum() - budget):
            more = again
    return pd.DataFrame({"source_no": pdf["source_no"], "size": lengths, "n": counts, "base": base + more // counts, "more": more % counts})


def mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, order_by: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``rec`` (a struct of the columns in ``keep``, by default all), size, source_size, target
    and copies (0 to 3).

    Sources in order of their code points, null last, get the weights in turn. Of one source and length, rows are taken
    in the order of a hash of ``order_by`` and the text, so reruns agree, however the table is split. Rows that repeat
    both are alike; where only some of them are wanted, a share of them near the wanted number is taken. A null text has
    size 0, and rows of size 0 add no words whatever their copies. An empty table gives no rows.
    """
    spark = docs.sparkSession
    lot = F.xxhash64(F.lit(seed), *order_by, text_col)
    facts = [F.col(source_col).cast("string").alias("source"), _size(F.col(text_col)).alias("size"), lot.alias("lot")]
    slim = stage(docs.select(*facts), "slim")
    hist = stage(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()
    sizes = sorted(sizes, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    plan = [(i, r["source"], r["s"], t) for i, (r, t) in enumerate(zip(sizes, targets([tuple(r) for r in sizes], weights), strict=True))]
    sources = spark.createDataFrame(plan, "source_no long, source string, source_size long, target double")
    fitted = hist.alias("h").join(sources.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("source_no", "size", "n", "target")
    fitted = fitted.groupBy("source_no").applyInPandas(lambda pdf: _fit_source(pdf, seed), "source_no long, size long, n long, base int, more long")
    fitted = stage(sources.join(fitted, "source_no"), "fitted")

    def placed(rows: DataFrame, right: DataFrame, *columns) -> DataFrame:
        same = F.col("w.source").eqNullSafe(F.col("f.source")) & (F.col("w.size") == F.col("f.size"))
        return rows.alias("w").join(right.alias("f").hint("shuffle_hash"), same).select(*columns)

    # lengths of which some documents are taken: buckets in the order of the hash, and the one where the cut lies
    part = placed(slim, fitted.where("more > 0 and more < n"), "f.source_no", "w.size", "w.lot", "f.n", "f.more")
    share = F.col("lot") / float(1 << 64) + 0.5
    part = part.withColumn("bucket", F.floor(share * F.ceil(F.col("n") / BUCKET)))
    key = ["source_no", "size", "bucket"]
    so_far = F.sum("here").over(Window.partitionBy("source_no", "size").orderBy("bucket"))
    cut_in = part.groupBy(*key, "more").agg(F.count("*").alias("here")).withColumn("upto", so_far)
    cut_in = cut_in.where("upto >= more and upto - here < more").select(*key, (F.col("more") - F.col("upto") + F.col("here")).alias("quota"))
    ranked = stage(part.join(cut_in, key).select(*key, "lot", "quota"), "cut")
    nth = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("lot"))).where("r = quota").select("source_no", "size", F.col("lot").alias("cut"))
    cuts = ranked.join(nth, ["source_no", "size"]).groupBy("source_no", "size", "cut").agg(F.count_if(F.col("lot") == F.col("cut")).alias("alike"), (F.max("quota") - F.count_if(F.col("lot") < F.col("cut"))).alias("wanted"))
    fitted = stage(fitted.join(cuts, ["source_no", "size"], "left"), "cuts")

    rows = docs.select(F.struct(*(keep or ["*"])).alias("rec"), *facts).withColumn("place", F.monotonically_increasing_id())
    rows = placed(rows, fitted, "rec", "w.size", "w.lot", "w.place", "source_size", "target", "base", "more", "f.n", "cut", "alike", "wanted")
    tie = (F.col("wanted") == F.col("alike")) | (F.pmod(F.xxhash64("place"), "alike") < F.col("wanted"))
    one = (F.col("more") == F.col("n")) | (F.col("lot") < F.col("cut")) | ((F.col("lot") == F.col("cut")) & tie)
    return rows.select("rec", "size", "source_size", "target", (F.col("base") + F.when(one & (F.col("more") > 0), 1).otherwise(0)).alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken."""
    out = mixed(load(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select("rec.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
