"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.scoring import fieldnorm, idf, upper_bound
from lexispark.functions.text import flatten_array
from lexispark.operators import evaluate, search, standalone
from lexispark.operators.build import IndexTables, build, frequencies, union, without
from lexispark.plans.catalog import Catalog
from lexispark.plans.spec import IndexSpec
from lexispark.plans.sqlsearch import register_search
from lexispark.sources.shared import shared_folder
from lexispark.sources.store import IndexStore
from lexispark.streaming.ingest import feed

DECIMALS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPECS = {
    "docs_idx": IndexSpec("docs_idx", "doc_id", "text", "ascii_simple", table="documents"),
    "flat_idx": IndexSpec("flat_idx", "doc_id", "text", "ascii_simple", k1=2.0, b=0.3, table="documents"),
    "en_idx": IndexSpec("en_idx", "doc_id", "text", "ascii_simple", where="lang = 'en'", table="documents"),
    "lang_idx": IndexSpec("lang_idx", "doc_id", "text", "ascii_simple", partition_by=("lang",), table="documents"),
    "unicode_idx": IndexSpec("unicode_idx", "doc_id", "text", "simple", table="documents"),
    "english_idx": IndexSpec("english_idx", "doc_id", "text", "english", table="documents"),
    "concat_idx": IndexSpec("concat_idx", "doc_id", "concat_ws(' ', source, lang, text)", "ascii_simple", expression=True, table="documents"),
    "props_idx": IndexSpec("props_idx", "event_id", "concat_ws(' ', event_type, get_json_object(props, '$.k'))", "ascii_simple", expression=True, table="events"),
    "turns_idx": IndexSpec("turns_idx", "conv_id", "turns", "ascii_simple", table="turns"),
    "parts_idx": IndexSpec("parts_idx", "p_partkey", "p_name", "ascii_simple", table="part"),
    "pages_idx": IndexSpec("pages_idx", "page_id", "regexp_replace(html, '<[^>]*>', ' ')", "ascii_simple", expression=True, table="pages"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "turns":  # a text array for each conversation, in the order of its turns
        rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
        ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
        return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["text"]).alias("turns"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORES: dict[tuple[str, str, str], IndexStore] = {}


def index(spark: SparkSession, sf_dir: str, name: str) -> IndexTables:
    """The tables of an index over a table of `sf_dir`, built and stored when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORES:
        path = f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
        _STORES[key] = IndexStore.create(spark, path, table(spark, sf_dir, SPECS[name].table), SPECS[name])
    return _STORES[key].tables()


def _query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


# SQL of the same index, for the oracle


def _norm(n: str) -> str:
    return f"(case when {n} < 32 then {n} else 24 + ((({n} - 24) >> (length(bin({n} - 24)) - 4)) << (length(bin({n} - 24)) - 4)) end)::bigint"


def _sql_index(rows: str = "select doc_id as key, text, '' as part from documents", pattern: str = "[^a-z0-9]+") -> str:
    """Common tables of an index: dd documents, p postings, n corpus and t term statistics."""
    return f"""d as (select key, part, list_filter(regexp_split_to_array(lower(text), '{pattern}'), lambda x: x <> '') as w from ({rows}) where text is not null),
dd as materialized (select key, part, len(w)::bigint as len, {_norm("len(w)::bigint")} as norm, w from d where len(w) > 0),
p as materialized (select key, part, norm, term, count(*)::bigint as tf from (select key, part, norm, unnest(w) as term from dd) group by all),
n as (select part, count(*)::bigint as n, sum(len)::bigint as total, sum(len)::double / count(*) as avgdl from dd group by part),
t as (select part, term, count(*)::bigint as df, max(tf)::bigint as max_tf, min(norm)::bigint as min_norm from p group by part, term)"""


def _sql_score(k1: float = 1.2, b: float = 0.75) -> str:
    weight = "ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double))"
    return f"{weight} * (tf * ({k1}::double + 1.0::double)) / (tf + {k1}::double * (1.0::double - {b}::double + {b}::double * norm / avgdl)) * qf"


def _sql_matches(words: str, k1: float = 1.2, b: float = 0.75) -> str:
    values = ", ".join(f"('{w}', {n})" for w, n in Counter(words.split()).items())
    return f"""m as (select key, -round(sum({_sql_score(k1, b)}), {DECIMALS}) as score from p join t using (part, term) join n using (part)
  join (values {values}) as q(term, qf) using (term) group by key)"""


def _sql_search(words: str, limit: int = 10, offset: int = 0, rows: str | None = None, k1: float = 1.2, b: float = 0.75, pattern: str = "[^a-z0-9]+", key: str = "doc_id") -> str:
    base = _sql_index(rows, pattern) if rows else _sql_index(pattern=pattern)
    return f"with {base},\n{_sql_matches(words, k1, b)} select key as {key}, score from m order by score, key limit {limit} offset {offset}"


def _named(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.withColumnRenamed("doc_key", key)


# Statistics


@_query(f"with {_sql_index()} select n as n_docs, total as total_len, round(avgdl, 6) as avg_len from n")
def corpus_stats(spark, sf_dir):
    stats = index(spark, sf_dir, "docs_idx").stats
    return stats.select("n_docs", "total_len", F.round(F.col("total_len") / F.col("n_docs"), 6).alias("avg_len"))


@_query(f"with {_sql_index()} select term, df, max_tf, min_norm from t")
def term_statistics(spark, sf_dir):
    t = index(spark, sf_dir, "docs_idx").terms
    return t.select("term", *(F.col(c).cast("long").alias(c) for c in ("df", "max_tf", "min_norm")))


@_query(f"with {_sql_index()} select key as doc_id, len, norm from dd")
def doc_lengths(spark, sf_dir):
    return index(spark, sf_dir, "docs_idx").docs.select(F.col("doc_key").alias("doc_id"), F.col("len").cast("long").alias("len"), "norm")


@_query(f"select doc_id, n_chars, {_norm('n_chars')} as norm from documents")
def quantized_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", fieldnorm(F.col("n_chars")).alias("norm"))


@_query(f"with {_sql_index()} select term, round(ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)), 6) as idf from t join n using (part)")
def inverse_document_frequency(spark, sf_dir):
    tables = index(spark, sf_dir, "docs_idx")
    return tables.terms.join(tables.stats, "part").select("term", F.round(idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@_query(f"with {_sql_index()} select term, key as doc_id, tf, norm from p")
def postings(spark, sf_dir):
    p = index(spark, sf_dir, "docs_idx").postings
    return p.select("term", F.col("doc_key").alias("doc_id"), F.col("tf").cast("long").alias("tf"), "norm")


@_query(f"with {_sql_index()} select term, round(ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (max_tf * 2.2::double) / (max_tf + 1.2::double * (0.25::double + 0.75::double * min_norm / avgdl)), {DECIMALS}) as bound from t join n using (part)")
def term_bounds(spark, sf_dir):
    tables = index(spark, sf_dir, "docs_idx")
    bound = upper_bound(F.col("max_tf"), F.col("min_norm"), F.col("avgdl"), F.col("weight"))
    return search.weighted_terms(tables).select("term", F.round(bound, DECIMALS).alias("bound"))


# Ranked search


def _add_search(name: str, words: str, limit: int = 10, offset: int = 0, prune: bool = False) -> None:
    def run(spark, sf_dir):
        return _named(search.search(index(spark, sf_dir, "docs_idx"), words, limit, offset, decimals=DECIMALS, prune=prune))

    run.__name__ = name
    _query(_sql_search(words, limit, offset))(run)


_add_search("search_one_term", "the")
_add_search("search_three_terms", "the and idiot", 20)
_add_search("search_repeated_terms", "the the and")
_add_search("search_rare_terms", "moron worthless of license", 25)
_add_search("search_offset", "the and", 10, 5)
_add_search("search_no_match", "zzzzqqqq")
_add_search("search_beyond_matches", "idiot", 5000)
_add_search("search_limit_zero", "the", 0)
_add_search("search_eight_terms", "the of and to in is for that", 10)
_add_search("search_pruned", "moron the of and", 10, prune=True)


@_query(_sql_search("the and", k1=2.0, b=0.3))
def search_k1_b(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "flat_idx"), "the and", 10, decimals=DECIMALS))


@_query(_sql_search("él été aux", 15, pattern=r"[^\p{L}\p{N}]+"))
def search_unicode(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "unicode_idx"), "él été aux", 15, decimals=DECIMALS))


@_query()
def search_english(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "english_idx"), "the licensed works", 10, decimals=DECIMALS))


@_query(_sql_search("the and", 10))
def search_implicit_index(spark, sf_dir):
    catalog = Catalog()
    for name in ("docs_idx", "en_idx"):
        catalog.add(SPECS[name], lambda name=name: index(spark, sf_dir, name))
    return _named(catalog.search("documents", "text", "the and", 10, decimals=DECIMALS))


@_query(f"with {_sql_index()},\n{_sql_matches('the and')} select key as doc_id, score, row_number() over (order by score, key) as rank from m order by score, key limit 50")
def ranked_rows(spark, sf_dir):
    # The rank is numbered over the 50 best rows only.
    found = search.search(index(spark, sf_dir, "docs_idx"), "the and", 50, decimals=DECIMALS)
    return _named(found).withColumn("rank", F.row_number().over(Window.orderBy("score", "doc_id")).cast("long"))


@_query(
    f"with {_sql_index()},\n{_sql_matches('the')}, m2 as (select key, -round(sum({_sql_score()}), {DECIMALS}) as score from p join t using (part, term) join n using (part) join (values ('de', 1)) as q(term, qf) using (term) group by key) select * from (select 'the' as query, key as doc_id, score from m order by score, key limit 10) union all select * from (select 'de' as query, key as doc_id, score from m2 order by score, key limit 10)"
)
def union_of_rankings(spark, sf_dir):
    tables = index(spark, sf_dir, "docs_idx")
    parts = [_named(search.search(tables, q, 10, decimals=DECIMALS)).select(F.lit(q).alias("query"), "doc_id", "score") for q in ("the", "de")]
    return parts[0].unionByName(parts[1])


# Standalone scores

_ALL = f"with {_sql_index()},\n{_sql_matches('the idiot')}, s as (select doc_id, lang, source, coalesce(score, 0.0::double) as score from documents left join m on key = doc_id)"


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return standalone.scored(docs, index(spark, sf_dir, "docs_idx"), "the idiot", decimals=DECIMALS)


@_query(f"{_ALL} select doc_id, score from s")
def standalone_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "score")


@_query(f"{_ALL} select count(*) filter (where score < 0)::bigint as matching, count(*)::bigint as total, round(avg(score), {DECIMALS}) as avg_score from s")
def standalone_aggregates(spark, sf_dir):
    return _scored(spark, sf_dir).agg(F.count_if(F.col("score") < 0).alias("matching"), F.count("*").alias("total"), F.round(F.avg("score"), DECIMALS).alias("avg_score"))


@_query(f"{_ALL} select lang, count(*)::bigint as matching, min(score) as best from s where score < 0 group by lang")
def matches_by_language(spark, sf_dir):
    return _scored(spark, sf_dir).where("score < 0").groupBy("lang").agg(F.count("*").alias("matching"), F.min("score").alias("best"))


@_query("select 0::bigint as different")
def search_equals_standalone(spark, sf_dir):
    found = search.matches(index(spark, sf_dir, "docs_idx"), "the idiot", decimals=DECIMALS)
    other = _scored(spark, sf_dir).where("score < 0").select(F.col("doc_id").alias("doc_key"), F.col("score").alias("other"))
    both = found.join(other, "doc_key", "full_outer")
    return both.agg(F.count_if(F.coalesce(F.abs(F.col("score") - F.col("other")) > 2e-4, F.lit(True))).alias("different"))


# Filters, partial and partitioned indexes, expressions and arrays


@_query(f"with {_sql_index()},\n{_sql_matches('the de')} select key as doc_id, score from m where key in (select doc_id from documents where lang = 'fr' and n_chars > 500) order by score, key limit 10")
def filtered_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _named(search.filtered(index(spark, sf_dir, "docs_idx"), "the de", docs, "doc_id", "lang = 'fr' AND n_chars > 500", 10, decimals=DECIMALS))


@_query(_sql_search("the and", 10, rows="select doc_id as key, text, '' as part from documents where lang = 'en'"))
def partial_index(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "en_idx"), "the and", 10, decimals=DECIMALS))


@_query(_sql_search("de la", 20, rows="select doc_id as key, text, coalesce(lang, chr(0)) as part from documents"))
def partitioned_index(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "lang_idx"), "de la", 20, decimals=DECIMALS))


@_query(_sql_search("de la", 20))
def partitioned_index_global_statistics(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "lang_idx"), "de la", 20, scope="global", decimals=DECIMALS))


@_query(_sql_search("src3 fr de", 15, rows="select doc_id as key, concat_ws(' ', source, lang, text) as text, '' as part from documents"))
def expression_index(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "concat_idx"), "src3 fr de", 15, decimals=DECIMALS))


@_query(_sql_search("error 42", 25, rows="select event_id as key, concat_ws(' ', event_type, json_extract_string(props, '$.k')) as text, '' as part from events", key="event_id"))
def json_expression_index(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "props_idx"), "error 42", 25, decimals=DECIMALS), "event_id")


@_query(_sql_search("the error", 25, rows="select conv_id as key, string_agg(text, ' ' order by turn) filter (where text <> '') as text, '' as part from conversations group by conv_id", key="conv_id"))
def text_array_index(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "turns_idx"), "the error", 25, decimals=DECIMALS), "conv_id")


@_query("select conv_id, string_agg(text, ' ' order by turn) filter (where text <> '') as text from conversations group by conv_id")
def flattened_arrays(spark, sf_dir):
    return table(spark, sf_dir, "turns").select("conv_id", flatten_array(F.col("turns")).alias("text"))


@_query(_sql_search("the article", 10, rows="select page_id as key, regexp_replace(html, '<[^>]*>', ' ', 'g') as text, '' as part from pages", key="page_id"))
def html_expression_index(spark, sf_dir):
    return _named(search.search(index(spark, sf_dir, "pages_idx"), "the article", 10, decimals=DECIMALS), "page_id")


# Joins


@_query(f"with {_sql_index()},\n{_sql_matches('the idiot')}, h as (select key, score from m order by score, key limit 50) select doc_id, score, source, quality from h join documents on key = doc_id join labels using (doc_id)")
def search_joined_labels(spark, sf_dir):
    found = search.search(index(spark, sf_dir, "docs_idx"), "the idiot", 50, decimals=DECIMALS)
    rows = search.with_rows(found, table(spark, sf_dir, "documents"), "doc_id")
    return rows.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "score", "source", "quality")


@_query(f"with {_sql_index()},\n{_sql_matches('the idiot')} select doc_id, quality, toxic from labels where doc_id in (select key from (select key from m order by score, key limit 50))")
def semi_join_of_search(spark, sf_dir):
    found = search.search(index(spark, sf_dir, "docs_idx"), "the idiot", 50, decimals=DECIMALS)
    return table(spark, sf_dir, "labels").join(found, F.col("doc_id") == F.col("doc_key"), "left_semi").select("doc_id", "quality", "toxic")


@_query(f"with {_sql_index()},\n{_sql_matches('the and')}, h as (select key from m order by score, key limit 100) select source, count(*)::bigint as n from h join documents on key = doc_id group by source")
def facets_of_search(spark, sf_dir):
    found = search.search(index(spark, sf_dir, "docs_idx"), "the and", 100, decimals=DECIMALS)
    return search.facets(found, table(spark, sf_dir, "documents"), "doc_id", "source")


@_query(f"with {_sql_index()},\n{_sql_matches('of the')} select doc_id, score from (select key, score from m order by score, key limit 100) join documents on key = doc_id where text ilike '%of the%' order by score, doc_id limit 10")
def phrase_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _named(search.phrase(index(spark, sf_dir, "docs_idx"), "of the", docs, "doc_id", "text", 10, 100, decimals=DECIMALS))


@_query(f"with {_sql_index('select p_partkey as key, p_name as text, ' + chr(39) * 2 + ' as part from part')},\n{_sql_matches('red ring')} select p_brand, count(*)::bigint as n_lines, round(sum(l_quantity), 2) as quantity from (select key from m order by score, key limit 20) join part on key = p_partkey join lineitem on l_partkey = p_partkey group by p_brand")
def part_search_aggregate(spark, sf_dir):
    found = search.search(index(spark, sf_dir, "parts_idx"), "red ring", 20, decimals=DECIMALS)
    rows = search.with_rows(found, table(spark, sf_dir, "part"), "p_partkey")
    lines = table(spark, sf_dir, "lineitem").join(rows, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_brand").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# Batches


def _sql_batch(queries: str, limit: int, where: str = "true") -> str:
    return f"""q as (select query_id, term, count(*)::bigint as qf from (select query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as term from ({queries})) group by all),
s as (select query_id, key, -round(sum({_sql_score()}), {DECIMALS}) as score from q join t using (term) join p using (part, term) join n using (part) group by query_id, key),
r as (select query_id, key as doc_id, score, row_number() over (partition by query_id order by score, key) as rank from s where {where} qualify rank <= {limit})"""


_BENCHMARK = "select item_id as query_id, text from benchmark"
_BATCH = f"with {_sql_index()},\n{_sql_batch(_BENCHMARK, 10)}"


def _benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _batch(spark, sf_dir):
    return search.search_batch(index(spark, sf_dir, "docs_idx"), _benchmark(spark, sf_dir), 10, decimals=DECIMALS)


@_query(f"{_BATCH} select query_id, doc_id, score, rank from r")
def search_batch(spark, sf_dir):
    return _named(_batch(spark, sf_dir)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@_query(f"{_BATCH} select query_id, count(quality)::double / 10 as precision from r left join (select doc_id, quality from labels where quality = 1) using (doc_id) group by query_id")
def precision_at_ten(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("doc_key"))
    return evaluate.precision_at_k(_batch(spark, sf_dir), good, 10)


@_query(f"{_BATCH}, h as (select query_id, 1.0::double / min(rank) as rr from r join labels using (doc_id) where quality = 1 group by query_id) select avg(coalesce(rr, 0))::double as mrr from (select distinct query_id from r) left join h using (query_id)")
def mean_reciprocal_rank(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("doc_key"))
    return evaluate.reciprocal_rank(_batch(spark, sf_dir), good, 10).agg(F.avg("rr").alias("mrr"))


@_query(f"with {_sql_index()}, q as (select distinct query_id, term from (select item_id as query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as term from benchmark)) select item_id as query_id, count(distinct key)::bigint as n from benchmark left join q on query_id = item_id left join p using (term) group by item_id")
def match_counts(spark, sf_dir):
    return standalone.match_counts(index(spark, sf_dir, "docs_idx"), _benchmark(spark, sf_dir))


_EVERY_50TH = "select doc_id as query_id, text from documents where doc_id % 50 = 0"


@_query(f"with {_sql_index()},\n{_sql_batch(_EVERY_50TH, 5, 'query_id <> key')} select query_id, doc_id, score, rank from r")
def more_like_this(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    found = search.more_like_this(index(spark, sf_dir, "docs_idx"), rows, 5, decimals=DECIMALS)
    return _named(found).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# Vectors


@_query(f"with {_sql_index()} select key as doc_id, 'docs_idx:{{' || string_agg(term || ':' || tf, ',' order by term) || '}}' as vector from p group by key")
def vector_text(spark, sf_dir):
    spec = SPECS["docs_idx"]
    docs = spec.documents(table(spark, sf_dir, "documents"))
    entries = F.transform(frequencies(F.col("tokens")), lambda e: F.concat_ws(":", e["term"], e["tf"].cast("string")))
    return docs.select(F.col("doc_key").alias("doc_id"), F.concat(F.lit(f"{spec.name}:{{"), F.array_join(entries, ","), F.lit("}")).alias("vector"))


# Maintenance

_LIVE = "select doc_id as key, text, '' as part from documents where doc_id not in (select doc_id from labels where quality = 0)"


@_query(_sql_search("the and", 10, rows=_LIVE))
def search_after_deletes(spark, sf_dir):
    dead = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("doc_key"))
    return _named(search.search(without(index(spark, sf_dir, "docs_idx"), dead), "the and", 10, decimals=DECIMALS))


@_query(_sql_search("the and", 10))
def search_of_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    halves = [build(docs.where(c), SPECS["docs_idx"]) for c in ("doc_id % 2 = 0", "doc_id % 2 = 1")]
    return _named(search.search(union(*halves), "the and", 10, decimals=DECIMALS))


@_query(_sql_search("the and", 10, rows=_LIVE))
def index_lifecycle(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    store = IndexStore.create(spark, path, docs.where("lang = 'en'"), SPECS["docs_idx"])
    store.append(docs.where("lang <> 'en' OR lang IS NULL"))
    store.delete(table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("doc_key")))
    store.flush()
    store.optimize()
    return _named(search.search(store.tables(), "the and", 10, decimals=DECIMALS))


@_query(_sql_search("the and the of", 10))
def sql_search_function(spark, sf_dir):
    register_search(index(spark, sf_dir, "docs_idx"), "docs_search")
    return spark.sql(f"select doc_key as doc_id, round(score, {DECIMALS}) as score from docs_search('the and the of', 10)")


_BACK = "select doc_id as key, text, '' as part from documents where doc_id % 2 = 0 or doc_id not in (select doc_id from labels where quality = 0)"


@_query(_sql_search("the and", 10, rows=_BACK))
def delete_then_append(spark, sf_dir):
    """Keys that come again after their deletion are documents again."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    store = IndexStore.create(spark, path, docs, SPECS["docs_idx"])
    gone = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("doc_key"))
    store.delete(gone)
    store.append(docs.where("doc_id % 2 = 0").join(gone, docs["doc_id"] == gone["doc_key"], "left_semi"))
    return _named(search.search(store.tables(), "the and", 10, decimals=DECIMALS))


@_query(_sql_search("omega the and", 10, rows="select doc_id as key, case when lang = 'en' then 'omega ' || text else text end as text, '' as part from documents"))
def updated_index(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    store = IndexStore.create(spark, path, docs, SPECS["docs_idx"])
    store.update(docs.where("lang = 'en'").withColumn("text", F.concat(F.lit("omega "), "text")))
    return _named(search.search(store.tables(), "omega the and", 10, decimals=DECIMALS))


@_query(f"with {_sql_index()} select term, key as doc_id, tf, norm, key not in (select doc_id from labels where quality = 0 and doc_id is not null) as live from p where term in ('the', 'and')")
def index_dump(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    store = IndexStore.create(spark, path, docs.where("doc_id % 2 = 0"), SPECS["docs_idx"])
    store.append(docs.where("doc_id % 2 <> 0"))
    store.delete(table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("doc_key")))
    rows = store.dump().where(F.col("term").isin("the", "and"))
    return rows.select("term", F.col("doc_key").alias("doc_id"), F.col("tf").cast("long").alias("tf"), "norm", "live")


@_query(_sql_search("the and", 10))
def streamed_index(spark, sf_dir):
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}"
    store = IndexStore.create(spark, f"{folder}/index", docs.where("false"), SPECS["docs_idx"])
    stream = spark.readStream.schema(docs.schema).format("parquet").load(f"{sf_dir}/documents.parquet*")
    feed(stream, store, f"{folder}/checkpoint").awaitTermination()
    return _named(search.search(store.tables(), "the and", 10, decimals=DECIMALS))


@_query(f"with {_sql_index()} select * from (select 'avg_len' as item, round(avgdl, {DECIMALS}) as value from n union all select 'terms', count(*)::double from t union all select 'total_docs', n::double from n union all select 'total_len', total::double from n)")
def index_summary(spark, sf_dir):
    index(spark, sf_dir, "docs_idx")
    store = _STORES[(spark.sparkContext.applicationId, sf_dir, "docs_idx")]
    rows = store.summarize().where(F.col("item").isin("avg_len", "terms", "total_docs", "total_len"))
    return rows.select("item", F.col("value").cast("double").alias("value"))
