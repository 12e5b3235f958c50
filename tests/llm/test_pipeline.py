"""The pipeline on the smallest tables, against a plain version of each stage's work."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from lexispark.llm import quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, steps):
    docs, good, lines, unique, mixed, coded = steps
    for df in steps[:-1]:
        assert df.columns == docs.columns
    labels = {i: q for i, q in duckdb.sql(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall()}
    kept = texts(good)
    assert all((i in kept) == bool(q) for i, q in labels.items())
    from test_operators import plain_lines, plain_similar

    left = {i: t for i, t in plain_lines(sorted(kept.items())) if t == kept[i] or any(c.isalnum() for c in t)}
    assert texts(lines) == left
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    ids = set(texts(unique))
    assert ids == {c for _, c in plain_similar(sorted(left.items()))}
    assert set(texts(mixed)) <= ids and mixed.count() > 0
    import public_tokenizers as P

    from lexispark.llm import bpe

    whole = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for r in coded.collect():
        text = texts(mixed)[r.doc_id] if coded.count() < 5 else None
        if text is not None:
            assert r.ids == whole.encode_ordinary(text)
    got = {r.doc_id: r.decoded_sha256 for r in coded.collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts(mixed).items()}


def test_run_gives_the_last_stage(spark, steps):
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == sorted((r.doc_id, r.ids_sha256) for r in steps[-1].collect())


def test_classifier_alone_decides_the_first_stage(spark, steps):
    docs, labels = steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = quality.with_quality(docs, quality.train(docs, labels)).where("score >= 0.5")
    assert {r.doc_id for r in scores.collect()} == set(texts(steps[1]))
