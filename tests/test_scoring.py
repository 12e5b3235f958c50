"""Golden scores, formulas and stems."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import scoring
from lexispark.functions.english import stem
from lexispark.functions.text import analyze, flatten_array, tokens
from lexispark.operators import search, standalone
from lexispark.operators.build import build
from lexispark.plans.spec import IndexSpec

CORPORA = {
    "one": ["hello world", "goodbye cruel world"],
    "two": ["hello world", "goodbye world", "hello goodbye", "world domination", "hello"],
    "three": ["the quick brown fox jumps over the lazy dog", "a short sentence", "this is a medium length sentence that contains several words"],
    "four": ["goodbye world", "goodbyes are hard"],
    "five": ["hello world", "goodbye cruel world", "goodbye nerds"],
    "six": ["hello, world!", "goodbye cruel world..."],
}
GOLDEN = [
    ("one", "hello", {1: -0.7549}),
    ("one", "cruel", {2: -0.6407}),
    ("two", "hello", {5: -0.6588, 1: -0.5156, 3: -0.5156}),
    ("two", "world", {1: -0.5156, 2: -0.5156, 4: -0.5156}),
    ("two", "goodbye", {2: -0.8374, 3: -0.8374}),
    ("two", "domination", {4: -1.3260}),
    ("three", "quick", {1: -0.8782}),
    ("three", "sentence", {2: -0.6134, 3: -0.4208}),
    ("four", "goodbye", {1: -0.1823, 2: -0.1823}),
    ("five", "hello", {1: -1.0417}),
    ("five", "world", {1: -0.4992, 2: -0.4208}),
    ("five", "goodbye", {3: -0.4992, 2: -0.4208}),
    ("six", "hello", {1: -0.7549}),
    ("six", "world", {1: -0.1986, 2: -0.1685}),
]


def corpus(spark, name):
    return spark.createDataFrame(list(enumerate(CORPORA[name], 1)), "id long, content string")


@pytest.mark.parametrize("name,query,expected", GOLDEN)
def test_golden_scores(spark, name, query, expected):
    df = corpus(spark, name)
    tables = build(df, IndexSpec("i", "id", "content", "english"))
    found = [(r.doc_key, round(r.score, 4)) for r in search.search(tables, query).collect()]
    assert found == list(expected.items())
    every = {r.id: round(r.score, 4) for r in standalone.scored(df, tables, query).collect()}
    assert every == {i: expected.get(i, 0.0) for i in every}


def test_query_frequency_multiplies(spark):
    tables = build(corpus(spark, "two"), IndexSpec("i", "id", "content", "simple"))
    once = {r.doc_key: r.score for r in search.search(tables, "hello").collect()}
    twice = {r.doc_key: r.score for r in search.search(tables, "hello Hello").collect()}
    assert twice == {k: pytest.approx(2 * v) for k, v in once.items()}


def test_parameters_change_scores(spark):
    flat = build(corpus(spark, "two"), IndexSpec("i", "id", "content", "simple", b=0.0))
    scores = [r.score for r in search.search(flat, "hello").collect()]
    assert len({round(s, 9) for s in scores}) == 1


@given(st.integers(0, 5_000_000))
def test_fieldnorm_keeps_four_bits(n):
    q = scoring.fieldnorm_of(n)
    assert q <= n and scoring.fieldnorm_of(q) == q and n - q <= max(0, (n - 24) // 8)


def test_fieldnorm_column(spark):
    rows = spark.range(0, 3000).union(spark.range(10**6, 10**6 + 50)).select("id", scoring.fieldnorm(F.col("id")).alias("q"))
    assert all(r.q == scoring.fieldnorm_of(r.id) for r in rows.collect())
    assert scoring.fieldnorm_of(39) == 39 and scoring.fieldnorm_of(100) == 96


def test_sql_functions(spark):
    scoring.register(spark)
    row = spark.sql("SELECT bm25_fieldnorm(100) n, bm25_idf(2, 1) i, bm25_term_score(1, 2, 2.5, bm25_idf(2, 1), 1.2, 0.75) s").first()
    assert (row.n, round(row.i, 4), round(row.s, 4)) == (96, 0.6931, 0.7549)


@pytest.mark.parametrize(
    "word,expected",
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"),
     ("relational", "relat"), ("conditional", "condit"), ("generically", "generic"), ("generous", "generous"), ("goodbyes", "goodby"), ("sentence", "sentenc"),
     ("running", "run"), ("happy", "happi"), ("cry", "cri"), ("by", "by"), ("say", "say"), ("skies", "sky"), ("national", "nation"), ("electricity", "electr"),
     ("hopefulness", "hope"), ("databases", "databas"), ("indexing", "index"), ("controlling", "control"), ("news", "news"), ("youth", "youth"), ("succeeded", "succeed")],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, WORLD! x1",), ("",), (None,), ("é-É " + "a" * 3000,)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"), "ascii_simple")).collect()[:3]] == [["hello", "world", "x1"], [], None]
    assert df.select(tokens(F.col("t"), "public.simple")).collect()[3][0] == ["é", "é"]
    assert analyze(spark, "The Running dogs", "english") == ["run", "dog"]
    with pytest.raises(ValueError, match="does not exist"):
        tokens(F.col("t"), "klingon")


def test_flattened_array(spark):
    df = spark.createDataFrame([(["a", None, "", "b c"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(flatten_array(F.col("a"))).collect()] == ["a b c", "", None]
