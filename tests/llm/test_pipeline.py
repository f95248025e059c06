import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lodestrata.llm import piece_bpe


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{i}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert kept["language_id"].count() == 200
    assert kept["near_dedup"].count() == kept["secret_scan"].count() < 200
    secret = F.col("text").rlike(r'(?i)token = "[0-9a-f]{40}"')
    assert kept["secret_scan"].where(secret).count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))
    want = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, sp.encode(r["text"]))).encode()).hexdigest()) for r in kept["source_mix"].collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in kept["sentencepiece"].collect()) == want
    whole = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, kept["sentencepiece"].collect()))


def test_stages_on_odd_rows(spark, odd_documents, tables):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_documents, odd_documents.where("false")):
            n = stage(spark, docs, tables).count()
            assert n <= 3 * docs.count(), name
