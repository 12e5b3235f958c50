"""Ranked search as a table function of SQL: `select * from bm25_search('some words', 10)`."""

from __future__ import annotations

from lexispark.functions.text import _SPLITS
from lexispark.operators.build import IndexTables


def register_search(tables: IndexTables, name: str = "bm25_search") -> None:
    """Define a temporary table function name(query STRING, most INT): (doc_key, score) of the best documents.

    Its body is a plan over the index's tables (as views called after it), which the optimizer
    merges into the query around it: the words are a constant there, and `most` ends the ranking
    early. Every partition scores by its own statistics. Configurations that stem have no form
    in SQL; postings are read whole, as SQL can't hand the words down to the files.
    """
    spec, spark = tables.spec, tables.docs.sparkSession
    if spec.text_config.rpartition(".")[2] == "english":
        raise ValueError(f'text search configuration "{spec.text_config}" needs a stemmer, which SQL has not')
    for part in ("postings", "terms", "stats"):
        getattr(tables, part).createOrReplaceTempView(f"{name}_{part}")
    pattern = _SPLITS[spec.text_config.rpartition(".")[2]].replace("\\", "\\\\")
    key = tables.docs.schema["doc_key"].dataType.simpleString()
    k1, b = f"{float(spec.k1)}D", f"{float(spec.b)}D"
    length = f"(CASE WHEN total_len > 0 THEN tf + {k1} * (1D - {b} + {b} * norm * n_docs / total_len) ELSE tf + {k1} END)"
    score = f"ln(1D + (n_docs - df + 0.5D) / (df + 0.5D)) * tf * ({k1} + 1D) / {length} * qf"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, most INT) RETURNS TABLE(doc_key {key}, score DOUBLE) RETURN
        SELECT doc_key, score FROM (
          SELECT doc_key, score, most_, row_number() OVER (ORDER BY score, doc_key) AS place FROM (
            SELECT doc_key, most_, -sum({score}) AS score FROM (
              SELECT p.doc_key, p.tf, p.norm, t.df, s.n_docs, s.total_len, q.most_, size(filter(q.words, x -> x = p.term)) AS qf
              FROM (SELECT split(lower(query), '{pattern}') AS words, most AS most_) q
              JOIN {name}_postings p ON array_contains(q.words, p.term)
              JOIN {name}_terms t ON p.part = t.part AND p.term = t.term
              JOIN {name}_stats s ON p.part = s.part)
            GROUP BY doc_key, most_))
        WHERE place <= most_""")
