"""Scores of every row of a table, matching or not: the operator as an expression."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.scoring import fieldnorm, idf, term_score
from lexispark.functions.text import analyze, tokens
from lexispark.operators.build import IndexTables


def corpus(tables: IndexTables, words: list[str]) -> tuple[int, int, dict[str, int]]:
    """N, total length and the df of the given words over the whole index: as many values as words."""
    whole = tables.stats.agg(F.sum("n_docs").alias("n"), F.sum("total_len").alias("len")).first()
    if tables.spec.partition_by and whole.n is None:
        raise ValueError("partitioned index has no child partitions")
    rows = tables.terms.where(F.col("term").isin(words)).groupBy("term").agg(F.sum("df").alias("df")).collect() if words else []
    return whole.n or 0, whole.len or 0, {r.term: r.df for r in rows}


def score_column(tables: IndexTables, text: Column, query: str, decimals: int | None = None) -> Column:
    """The score of a text under the index's statistics: 0 without a query term or for an empty text, null for null.

    The query's words are counted in one walk over the text's lexemes; statistics are literals.
    """
    spec = tables.spec
    words = Counter(analyze(tables.docs.sparkSession, query, spec.text_config))
    n, total, df = corpus(tables, list(words))
    found = tokens(text, spec.text_config)

    def of(lexemes: Column) -> Column:
        norm, out = fieldnorm(F.size(lexemes)), F.lit(0.0)
        for word, qf in words.items():
            if word in df:
                tf = F.size(_equal(lexemes, word))
                weight = idf(F.lit(n), F.lit(df[word]))
                part = term_score(tf, norm, F.lit(total / n), weight, spec.k1, spec.b) * qf
                out = out + F.when(tf > 0, part).otherwise(0.0)
        value = out if decimals is None else F.round(out, decimals)
        return F.when(value > 0, -value).otherwise(0.0)

    # Bound once in a one-element array, so that a text is split once.
    return F.when(text.isNull(), F.lit(None)).otherwise(F.element_at(F.transform(F.array(found), of), 1))


def _equal(lexemes: Column, word: str) -> Column:
    return F.filter(lexemes, lambda x: x == F.lit(word))


def scored(df: DataFrame, tables: IndexTables, query: str, name: str = "score", decimals: int | None = None) -> DataFrame:
    """Every row of `df` with its score, also where the index has no such row."""
    return df.withColumn(name, score_column(tables, tables.spec.text(df), query, decimals))


def match_counts(tables: IndexTables, queries: DataFrame) -> DataFrame:
    """(query_id, n) of matching documents for each query, 0 where none does."""
    words = queries.select("query_id", F.explode(tokens(F.col("text"), tables.spec.text_config)).alias("term")).distinct()
    hits = tables.postings.join(words, "term").select("query_id", "doc_key").distinct()
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
