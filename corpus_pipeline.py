"""Documents to an encoded training mix: five stages, each on all that the one before kept.

``run`` writes each stage's rows as Parquet to the shared folder and reads them back as the next stage's input. All
stages but the last return the columns of ``documents``. Tables that a stage's operator staged for itself are deleted
when the next stage starts, so the stage's rows must have been written by then; tables of other queries stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, language, mixing, near_dedup, piece_bpe, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Least score of a language: below it a text's n-grams lie at over 95 % of the largest distance from every profile.
LEAST_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null text, not one letter, or letters that are foreign to every profile. Learns
    from the input's own labels; without any, all that have letters stay."""
    model = language.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = language.predicted(docs, model)
    return rows.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("rec.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of 5-word shingles, similarity of 0.8."""
    return near_dedup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; confirmed secrets in its text are replaced by a mask."""
    return secrets.redacted(docs, secrets.train(secrets.labelled_findings(spark))).withColumn("n_chars", F.char_length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0 to 3) as the mix takes it."""
    rows = mixing.mixed(docs).where("copies > 0")
    return rows.select("rec", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("rec.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every copy in the mix."""
    return piece_bpe.digests(piece_bpe.encoded(docs, keep=("doc_id",)).select("rec.doc_id", "ids", "decoded"))


_staged: list[str] = []


def _alone(stage: Stage) -> Stage:
    """The stage, after the tables that the one before staged for itself are deleted."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_staged(spark, _staged)
        with common.recorded() as paths:
            try:
                return stage(spark, docs, sf_dir)
            finally:
                _staged.extend(paths)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _alone(language_id)),
    ("near_dedup", _alone(near_duplicates)),
    ("secret_scan", _alone(secret_scan)),
    ("source_mix", _alone(source_mix)),
    ("sentencepiece", _alone(encode)),
]

#: SQL can't express the forest, the knapsack or the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        out = function(spark, docs, sf_dir)
        path = common.work_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
