"""Building an index: documents, postings, term statistics and corpus statistics as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.scoring import fieldnorm
from lexispark.plans.spec import IndexSpec


@dataclass(frozen=True)
class IndexTables:
    """docs(part, doc_key, len, norm), postings(part, term, doc_key, tf, norm),
    terms(part, term, df, max_tf, min_norm), stats(part, n_docs, total_len).

    vectors(part, doc_key, len, norm, entries) is the forward form that a build begins with; a
    store writes it first, so that no text is split twice.
    """

    spec: IndexSpec
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    vectors: DataFrame | None = None

    def cached(self) -> IndexTables:
        """The same index with its tables kept by Spark's storage, which evicts what it has no room for."""
        return replace(self, **{name: getattr(self, name).persist() for name in ("docs", "postings", "terms", "stats")})

    def released(self) -> None:
        for name in ("docs", "postings", "terms", "stats"):
            getattr(self, name).unpersist()


def frequencies(words: Column) -> Column:
    """(term, tf) of a document's lexemes: sorted once, runs counted, all inside its own row."""
    ordered = F.array_sort(words)

    def runs(x: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))

        def counted(at: Column) -> Column:
            return F.transform(at, lambda p, j: F.struct(F.get(x, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(x)) - p).alias("tf")))

        return F.flatten(F.transform(F.array(begins), counted))

    return F.flatten(F.transform(F.array(ordered), runs))


def vectors_of(documents: DataFrame) -> DataFrame:
    """(part, doc_key, len, norm, entries): no shuffle, as a document's words are in its row."""
    n = F.size("tokens")
    return documents.select("part", "doc_key", n.alias("len"), fieldnorm(n).alias("norm"), frequencies(F.col("tokens")).alias("entries"))


def postings_of(vectors: DataFrame, *also: str) -> DataFrame:
    """(part, term, doc_key, tf, norm), and other columns if asked for."""
    return vectors.select(*also, "part", "doc_key", "norm", F.inline("entries")).select(*also, "part", "term", "doc_key", "tf", "norm")


def terms_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("part", "term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("norm").alias("min_norm"))


def stats_of(docs: DataFrame) -> DataFrame:
    return docs.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("len").cast("long").alias("total_len"))


def from_vectors(spec: IndexSpec, vectors: DataFrame) -> IndexTables:
    docs, postings = vectors.drop("entries"), postings_of(vectors)
    return IndexTables(spec, docs, postings, terms_of(postings), stats_of(docs), vectors)


def build(df: DataFrame, spec: IndexSpec) -> IndexTables:
    """The tables of an index over `df`, as plans; a store writes them."""
    return from_vectors(spec, vectors_of(spec.documents(df)))


def without(tables: IndexTables, dead: DataFrame) -> IndexTables:
    """The index less the documents whose keys are in `dead` (doc_key): all statistics count live rows only.

    Where the forward form is at hand, document frequencies are those of the index less those
    of the dead documents' own terms; the terms' bounds stay, so that none is too low.
    """
    gone = dead.select("doc_key").distinct()
    docs = tables.docs.join(gone, "doc_key", "left_anti").select(*tables.docs.columns)
    postings = tables.postings.join(gone, "doc_key", "left_anti").select(*tables.postings.columns)
    if tables.vectors is None:
        return IndexTables(tables.spec, docs, postings, terms_of(postings), stats_of(docs))
    less = postings_of(tables.vectors.join(gone, "doc_key", "left_semi")).groupBy("part", "term").agg((-F.count("*")).alias("df"))
    every = tables.terms.unionByName(less, allowMissingColumns=True).groupBy("part", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_norm").alias("min_norm"))
    vectors = tables.vectors.join(gone, "doc_key", "left_anti").select(*tables.vectors.columns)
    return IndexTables(tables.spec, docs, postings, every.where("df > 0"), stats_of(docs), vectors)


def union(first: IndexTables, *rest: IndexTables) -> IndexTables:
    """Several indexes of disjoint documents as one: statistics add up."""
    docs, postings, terms, stats, vectors = first.docs, first.postings, first.terms, first.stats, first.vectors
    for other in rest:
        docs, postings = docs.unionByName(other.docs), postings.unionByName(other.postings)
        terms, stats = terms.unionByName(other.terms), stats.unionByName(other.stats)
        vectors = None if vectors is None or other.vectors is None else vectors.unionByName(other.vectors)
    terms = terms.groupBy("part", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_norm").alias("min_norm"))
    stats = stats.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").cast("long").alias("total_len"))
    return IndexTables(first.spec, docs, postings, terms, stats, vectors)
