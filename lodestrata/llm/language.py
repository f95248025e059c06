"""Language ID (operator 10): rank-order profiles (Cavnar and Trenkle, 1994).

A profile is a language's most frequent letter n-grams in order. A text's own most frequent n-grams are compared with
every profile: each n-gram costs the distance between its two ranks, or the full length where the profile lacks it. The
language at the least distance wins; of equal ones, the first by code point.

Texts are lower-cased; every run of anything but letters, and marks that follow letters, is one word break, and n-grams
of one to three letters keep the breaks at a word's ends. They are counted as packed integers in numpy, in pieces of bounded size, over whole texts.
Null texts and those without a letter have no language; an empty table gives no rows, and one without labels no profiles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load

#: Length of a profile, and of the list that is taken from a text.
RANKS = 400
#: Bound on the training sample: about so many rows of each language, chosen by a hash of the id.
SAMPLE_ROWS = 2000
UNKNOWN = "und"
_PIECE = 1 << 18
_PLAIN_GAPS = re.compile("[^a-z]+").sub
_GAPS = regex.compile(r"[^\p{L}\p{M}]+\p{M}*|\A\p{M}+").sub
_BREAK = ord("_")


def _fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _count(codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that start in a piece of the codes, sorted, and their counts."""
    c = codes[low : high + 2].astype(np.int64)
    n = high - low
    gap = c == _BREAK
    pair = (c[:-1] << 21) | c[1:]
    triple = (pair[:-1] << 21) | c[2:]
    keys = np.sort(np.concatenate((c[:n][~gap[:n]], pair[:n], triple[:n][~gap[1:-1][:n]])))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers in rising order, and their counts; none if it has no letter."""
    text = (text or "").lower()
    words = (_PLAIN_GAPS if text.isascii() else _GAPS)("_", text).strip("_")
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f"_{words}_".encode("utf-32-le", "surrogatepass"), np.uint32)
    keys, counts = _count(codes, 0, min(_PIECE, len(codes)))
    for low in range(_PIECE, len(codes), _PIECE):
        k, n = _count(codes, low, min(low + _PIECE, len(codes)))
        keys, counts = _fold(np.concatenate((keys, k)), np.concatenate((counts, n)))
    return keys, counts


def _parts(rows: pa.Array | pa.RecordBatch, size: int = 512) -> Iterator:
    """A batch in parts, so that few of its texts are Python objects at a time."""
    return (rows.slice(start, size) for start in range(0, len(rows), size))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed over each batch."""
    for batch in batches:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in _parts(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                k, n = ngrams(text)
                if len(k):
                    old = sums.get(lang)
                    sums[lang] = (k, n) if old is None else _fold(np.concatenate((old[0], k)), np.concatenate((old[1], n)))
        for lang, (k, n) in sums.items():
            yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


class Profiles:
    """Languages in the order of their code points and the rank of each n-gram in each profile."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int = RANKS) -> None:
        self.ranks = ranks
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.langs), len(self.grams)), ranks, np.int32)
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.rank[number[lang], np.searchsorted(self.grams, gram)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngrams(text)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        own = keys[np.argsort(-counts, kind="stable")[: self.ranks]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        place = np.flatnonzero(known)
        far = np.abs(self.rank[:, at[known]] - place).astype(np.int64)
        far = np.where(self.rank[:, at[known]] == self.ranks, self.ranks, far).sum(axis=1) + self.ranks * int((~known).sum())
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (self.ranks * len(own))


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is in neither part, shown as false."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, ranks: int = RANKS) -> Profiles:
    """Profiles from rows that are not held out and have a label, about ``sample_rows`` of each language.

    The sample is every row whose id hashes below a share of the range that follows from the language's number of rows;
    the same rows are taken however the table is split. All n-grams of the whole sampled texts are counted.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    sizes = rows.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return Profiles([], ranks)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_rows / r["count"]))])
    lot = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(lot < share[F.col("lang")]).select("lang", "text")
    sums = sample.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = sums.select("lang", "gram", rank.alias("rank")).where(F.col("rank") < ranks)
    return Profiles([tuple(r) for r in top.collect()], ranks)


def _predict(model: Profiles):
    def run(texts: pa.Array) -> pa.Array:
        got = [model.predict(t) for part in _parts(texts) for t in part.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()  # else a filter on it runs it again


def predicted(docs: DataFrame, model: Profiles, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row as ``rec`` (a struct of the columns in ``keep``, by default all), lang_pred and score.

    lang_pred is ``und`` and score 0 where the text is null or has no letter, or nothing was learned. score is 1 less
    the distance's share of the largest possible one. Only texts go to Python, once each; the rows stay where they are.
    """
    rows = docs.select(F.struct(*(keep or ["*"])).alias("rec"), _predict(model)(F.col(text_col)).alias("found"))
    return rows.select("rec", "found.lang_pred", "found.score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score."""
    docs = load(spark, sf_dir, "documents")
    out = predicted(docs, train(docs), keep=("doc_id",)).select("rec.doc_id", "lang_pred", "score")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
