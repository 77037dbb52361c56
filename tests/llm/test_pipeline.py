"""The pipeline's stages, each on what the one before kept, against what brute force gives."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordframe.llm import mixing, quality_rules

from test_operators import SF, brute_components, secrets


def test_stages(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    results = []
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialize(stage(spark, kept, SF))
        results.append(kept)
    for df in results[:-1]:
        assert df.columns == docs.columns
    texts = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in (docs, *results[:-1])]
    assert set(texts[1]) == {i for i, t in texts[0].items() if quality_rules.measure((t or "").encode(), quality_rules.Limits())[6]}
    assert set(texts[2]) == {i for i, (_, root) in brute_components(texts[1]).items() if root == i}
    assert set(texts[3]) == set(texts[2])
    for i, t in texts[2].items():
        found = secrets(t)
        assert (texts[3][i] == t) if not found else not secrets(texts[3][i])
    p = mixing.plan(results[2])
    assert set(texts[4]) == {r.doc_id for r in mixing.assign(results[2], p).collect() if r.kept}
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.sentencepiece_codec.default_model())
    for r in results[4].collect():
        ids = library.encode(texts[4][r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_mixture_rests_on_every_document(spark):
    """Forty documents of 6 000, none among those of least hash, are a topic of their own and so are repeated."""
    rare = {r.id for r in spark.range(6_000).orderBy(F.xxhash64("id", F.lit(7)).desc()).limit(40).collect()}
    rows = [(i, "s", "en", " ".join(f"{'rare' if i in rare else 'word'}{(i + j) % 9}" for j in range(30))) for i in range(6_000)]
    kept = corpus_pipeline.mixture(spark, spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), SF)
    assert sum(r.doc_id in rare for r in kept.select("doc_id").collect()) > 80
