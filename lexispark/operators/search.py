"""Ranked search over an index: scores, top-k, batches, documents as queries, facets, phrases."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.scoring import idf, term_score, upper_bound
from lexispark.functions.text import analyze, tokens
from lexispark.operators.build import IndexTables
from lexispark.operators.likeness import best_of_blocks


def scoped(tables: IndexTables, scope: str) -> tuple[DataFrame, DataFrame]:
    """(terms, stats) with statistics of each partition, or of all partitions together in each."""
    if scope not in ("partition", "global"):
        raise ValueError(f"unknown statistics scope {scope!r}")
    terms, stats = tables.terms, tables.stats
    if scope == "global" and tables.spec.partition_by:
        every = terms.groupBy("term").agg(F.sum("df").alias("df"))
        terms = terms.drop("df").join(every, "term").select("part", "term", "df", "max_tf", "min_norm")
        whole = stats.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
        stats = stats.select("part").crossJoin(F.broadcast(whole))  # one row
    return terms, stats


def weighted_terms(tables: IndexTables, scope: str = "partition") -> DataFrame:
    """(part, term, df, weight, avgdl, max_tf, min_norm): each term with its idf and its partition's average length."""
    terms, stats = scoped(tables, scope)
    # As many rows as partitions of the index; Spark broadcasts them by their size.
    rows = terms.join(stats, "part")
    avgdl = (F.col("total_len") / F.col("n_docs")).alias("avgdl")
    return rows.select("part", "term", "df", idf(F.col("n_docs"), F.col("df")).alias("weight"), avgdl, "max_tf", "min_norm")


def _contribution(spec, qf: Column) -> Column:
    return term_score(F.col("tf"), F.col("norm"), F.col("avgdl"), F.col("weight"), spec.k1, spec.b) * qf


def _query_terms(tables: IndexTables, words: list[str], scope: str) -> DataFrame:
    counts = Counter(words)
    found = weighted_terms(tables, scope).where(F.col("term").isin(list(counts)))
    pairs = F.create_map(*(F.lit(x) for item in counts.items() for x in item))
    return found.withColumn("qf", F.element_at(pairs, F.col("term")))


def _nothing(tables: IndexTables) -> DataFrame:
    return tables.docs.where("false").select("doc_key", F.lit(0.0).alias("score"))


def matches(tables: IndexTables, query: str, scope: str = "partition", decimals: int | None = None) -> DataFrame:
    """(doc_key, score) of every document that has a query term; scores are negative, the best is least.

    The term filter reaches the postings' scan; contributions are summed before the shuffle by
    document. A query without lexemes gives no rows.
    """
    words = analyze(tables.docs.sparkSession, query, tables.spec.text_config)
    if not words:
        return _nothing(tables)
    # At most one row for each query word and index partition.
    asked = F.broadcast(_query_terms(tables, words, scope).drop("max_tf", "min_norm", "df"))
    hits = tables.postings.where(F.col("term").isin(list(set(words)))).join(asked, ["part", "term"])
    scored = hits.groupBy("doc_key").agg(F.sum(_contribution(tables.spec, F.col("qf"))).alias("s"))
    return scored.select("doc_key", _negated(F.col("s"), decimals).alias("score"))


def _negated(score: Column, decimals: int | None) -> Column:
    value = score if decimals is None else F.round(score, decimals)
    return F.when(value > 0, -value).otherwise(F.lit(0.0))


def top(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """The best rows by (score, doc_key); all of them without a limit."""
    ordered = rows.orderBy("score", "doc_key")
    if limit is None:
        return ordered.offset(offset) if offset else ordered
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def search(tables: IndexTables, query: str, limit: int | None = 10, offset: int = 0, scope: str = "partition", decimals: int | None = None, prune: bool = False) -> DataFrame:
    """(doc_key, score) of the best documents; ties go by key."""
    if prune and limit and not offset and limit <= SEED:
        return _pruned(tables, query, limit, scope, decimals)
    return top(matches(tables, query, scope, decimals), limit, offset)


#: The most rows for which a search prunes: so many partial scores are asked of the strongest term.
SEED = 10_000


def _pruned(tables: IndexTables, query: str, limit: int, scope: str, decimals: int | None) -> DataFrame:
    """The same rows as `search`, with fewer postings summed.

    The term of the highest bound alone gives `limit` partial scores, whose least no result can
    be under. Terms whose bounds together stay under it can't lift a document that has none of
    the others: their postings count only for documents found by the rest.
    """
    words = analyze(tables.docs.sparkSession, query, tables.spec.text_config)
    if not words:
        return _nothing(tables)
    spec = tables.spec
    asked = _query_terms(tables, words, scope)
    bound = upper_bound(F.col("max_tf"), F.col("min_norm"), F.col("avgdl"), F.col("weight"), spec.k1, spec.b) * F.col("qf")
    bounds = asked.groupBy("term").agg(F.max(bound).alias("bound")).orderBy("bound").collect()  # a row for each query word
    if not bounds:
        return _nothing(tables)
    small = F.broadcast(asked.drop("max_tf", "min_norm", "df"))
    hits = tables.postings.where(F.col("term").isin(list(set(words)))).join(small, ["part", "term"])
    hits = hits.withColumn("c", _contribution(spec, F.col("qf")))
    seed = [r.c for r in hits.where(F.col("term") == bounds[-1].term).select("c").orderBy(F.desc("c")).limit(limit).collect()]
    floor, total, weak = (seed[-1] if len(seed) == limit else 0.0), 0.0, []
    for row in bounds:
        total += row.bound
        if total >= floor * (1 - 1e-9):
            break
        weak.append(row.term)
    if weak:
        strong = hits.where(~F.col("term").isin(weak)).select("doc_key").distinct()
        hits = hits.where(~F.col("term").isin(weak)).unionByName(hits.where(F.col("term").isin(weak)).join(strong, "doc_key", "left_semi").select(*hits.columns))
    scored = hits.groupBy("doc_key").agg(F.sum("c").alias("s"))
    return top(scored.select("doc_key", _negated(F.col("s"), decimals).alias("score")), limit)


def search_batch(tables: IndexTables, queries: DataFrame, limit: int = 10, scope: str = "partition", decimals: int | None = None) -> DataFrame:
    """(query_id, doc_key, score, rank) of the best documents of each of `queries` (query_id, text).

    Queries become (query, term) rows once; the join with the postings is one shuffle or a
    broadcast by the queries' measured size, the sums one more, the ranking one by query with
    only the best rows of each task.
    """
    words = queries.select("query_id", F.explode(tokens(F.col("text"), tables.spec.text_config)).alias("term"))
    wanted = words.groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    asked = wanted.join(weighted_terms(tables, scope).drop("max_tf", "min_norm", "df"), "term")
    hits = tables.postings.join(asked, ["part", "term"])
    scored = hits.groupBy("query_id", "doc_key").agg(F.sum(_contribution(tables.spec, F.col("qf"))).alias("s"))
    scored = scored.select("query_id", "doc_key", _negated(F.col("s"), decimals).alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "doc_key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def first_ranks(rows: DataFrame, limit: int, decimals: int | None) -> DataFrame:
    """Of rows (query_id, doc_key, s) the best `limit` of each query."""
    w = Window.partitionBy("query_id").orderBy(_negated(F.col("s"), decimals), "doc_key")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def more_like_this(tables: IndexTables, docs: DataFrame, limit: int = 10, decimals: int | None = None) -> DataFrame:
    """(query_id, doc_key, score, rank): for rows (query_id, text) of the indexed table, the best other documents.

    Where the index has its forward form, documents meet blocks of queries in their own rows;
    else by their postings, whose pairs are shuffled.
    """
    if tables.vectors is None:
        found = search_batch(tables, docs, limit + 1, decimals=decimals)
    else:
        found = best_of_blocks(tables, weighted_terms(tables), docs, limit + 1, decimals)
        found = found.select("query_id", "doc_key", _negated(F.col("s"), decimals).alias("score"))
    found = found.where("query_id <> doc_key")
    w = Window.partitionBy("query_id").orderBy("score", "doc_key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def with_rows(found: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The found documents with their source rows, fetched last."""
    return found.join(source, found["doc_key"] == source[key]).drop("doc_key")


def filtered(tables: IndexTables, query: str, source: DataFrame, key: str, condition: Column | str, limit: int | None = 10, decimals: int | None = None) -> DataFrame:
    """(doc_key, score) of the best documents whose source rows meet a condition.

    Statistics stay those of the whole index. The condition is met before ranking, so `limit`
    rows come if there are as many, whatever share it keeps.
    """
    kept = source.where(condition).select(F.col(key).alias("doc_key"))
    return top(matches(tables, query, decimals=decimals).join(kept, "doc_key", "left_semi"), limit)


def phrase(tables: IndexTables, query: str, source: DataFrame, key: str, text: str, limit: int = 10, fetch: int = 100, decimals: int | None = None) -> DataFrame:
    """The phrase idiom: fetch more, keep texts that contain the query as it stands in any case, rank again."""
    pattern = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hits = search(tables, query, fetch, decimals=decimals)
    kept = source.where(F.col(text).ilike(pattern))
    return top(hits.join(kept.select(F.col(key).alias("doc_key")), "doc_key", "left_semi"), limit)


def facets(found: DataFrame, source: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n) over found documents."""
    rows = found.join(source.select(F.col(key).alias("doc_key"), by), "doc_key")
    return rows.groupBy(by).agg(F.count("*").alias("n"))
