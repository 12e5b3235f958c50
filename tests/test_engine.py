"""Search, filters, indexes, maintenance, types and the error contract."""

import logging
import math
import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexispark.functions.scoring import fieldnorm_of
from lexispark.operators import evaluate, likeness, search, standalone
from lexispark.operators.build import build, union, without
from lexispark.plans.catalog import Catalog
from lexispark.plans.query import Bm25Query, Bm25Vector, to_bm25query
from lexispark.plans.spec import IndexSpec
from lexispark.plans.sqlsearch import register_search
from lexispark.sources.readers import read_documents
from lexispark.sources.store import Conflict, IndexStore
from lexispark.streaming.ingest import feed

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
SPEC = IndexSpec("idx", "id", "body", "ascii_simple", table="docs")


def texts(n, seed=5):
    rng = random.Random(seed)
    return [(i, f"g{i % 7}", " ".join(rng.choices(WORDS, weights=range(10, 0, -1), k=rng.randint(1, 60)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, body string")


def brute(rows, query, k1=1.2, b=0.75):
    """The formula, word by word."""
    docs = {i: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for i, _, t in rows}
    docs = {i: w for i, w in docs.items() if w}
    n, avg = len(docs), sum(map(len, docs.values())) / max(len(docs), 1)
    df = Counter(w for ws in docs.values() for w in set(ws))
    out = {}
    for i, ws in docs.items():
        tf, s = Counter(ws), 0.0
        for w, qf in Counter(x for x in re.split("[^a-z0-9]+", query.lower()) if x).items():
            if tf[w]:
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                s += idf * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * fieldnorm_of(len(ws)) / avg)) * qf
        if s:
            out[i] = -s
    return out


@pytest.fixture(scope="module")
def rows():
    return texts(400)


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    return IndexStore.create(spark, str(tmp_path_factory.mktemp("index") / "a"), frame(spark, rows), SPEC).tables()


@pytest.mark.parametrize("query", ["alpha", "kappa theta", "alpha alpha beta", "nothing", "", "!!!", " ".join(WORDS)])
def test_search_equals_brute_force(tables, rows, query):
    expected = brute(rows, query)
    found = {r.doc_key: r.score for r in search.search(tables, query, None).collect()}
    assert found == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}
    top = [r.doc_key for r in search.search(tables, query, 15, decimals=6).collect()]
    assert top == sorted(expected, key=lambda k: (round(expected[k], 6), k))[:15]


@pytest.mark.parametrize("query", ["kappa alpha", "iota kappa alpha beta", " ".join(WORDS), "zzz"])
def test_pruned_search_is_exact(tables, query):
    plain = [tuple(r) for r in search.search(tables, query, 8, decimals=6).collect()]
    assert [tuple(r) for r in search.search(tables, query, 8, decimals=6, prune=True).collect()] == plain


def test_limits(tables):
    every = [r.doc_key for r in search.search(tables, "alpha", None, decimals=6).collect()]
    assert [r.doc_key for r in search.search(tables, "alpha", 5, 3, decimals=6).collect()] == every[3:8]
    assert search.search(tables, "alpha", 0).count() == 0
    assert search.search(tables, "alpha", 10_000).count() == len(every)
    with pytest.raises(ValueError):
        search.search(tables, "alpha", -1)


def test_standalone_equals_search(spark, tables, rows):
    scored = {r.id: r.score for r in standalone.scored(frame(spark, rows), tables, "kappa beta beta").collect()}
    expected = brute(rows, "kappa beta beta")
    assert scored == {i: pytest.approx(expected.get(i, 0.0), abs=1e-9) for i, _, _ in rows}


def test_filter_keeps_whole_statistics_and_fills_the_limit(spark, tables, rows):
    found = search.filtered(tables, "alpha", frame(spark, rows), "id", "grp = 'g3'", 12, decimals=6).collect()
    expected = {k: v for k, v in brute(rows, "alpha").items() if k % 7 == 3}
    assert [r.doc_key for r in found] == sorted(expected, key=lambda k: (round(expected[k], 6), k))[:12]


def test_batch_and_more_like_this(spark, tables, rows):
    queries = spark.createDataFrame([(1, "alpha kappa"), (2, "zzz"), (3, "eta eta")], "query_id long, text string")
    found = search.search_batch(tables, queries, 5, decimals=6).collect()
    for q, text in ((1, "alpha kappa"), (3, "eta eta")):
        expected = brute(rows, text)
        mine = [r.doc_key for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        assert mine == sorted(expected, key=lambda k: (round(expected[k], 6), k))[:5]
    assert not [r for r in found if r.query_id == 2]
    like = search.more_like_this(tables, frame(spark, rows[:3]).selectExpr("id AS query_id", "body AS text"), 4).collect()
    assert len(like) == 12 and all(r.query_id != r.doc_key for r in like)


@pytest.mark.parametrize("by", [(), ("grp",)])
def test_more_like_this_in_blocks_equals_the_shuffled_search(spark, rows, by, monkeypatch):
    monkeypatch.setattr(likeness, "ENTRIES", 300)
    monkeypatch.setattr(likeness, "COMMON", 4)
    monkeypatch.setattr(likeness, "SCORES", 64)
    many = [*rows, *[(1000 + i, f"g{i % 7}", b) for i, _, b in rows[:30]], (2000, "g1", None), (2001, "g1", "unheard of")]
    built = build(frame(spark, many), replace(SPEC, partition_by=by))
    asked = frame(spark, [r for r in many if r[0] % 5 == 0] + [(2000, "g1", None), (7777, "g1", "")]).selectExpr("id AS query_id", "body AS text")
    found = search.more_like_this(built, asked, 4, decimals=4)
    left = likeness.best_of_blocks(built, search.weighted_terms(built), asked, 5, 4)  # all that leaves the blocks
    assert left.count() <= 5 * asked.count() and left.select("query_id", "doc_key").distinct().count() == left.count()
    plain = search.more_like_this(replace(built, vectors=None), asked, 4, decimals=4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select(*found.columns).collect()))


def test_counts_facets_phrases(spark, tables, rows):
    queries = spark.createDataFrame([(1, "kappa"), (2, "zzz")], "query_id long, text string")
    assert {r.query_id: r.n for r in standalone.match_counts(tables, queries).collect()} == {1: len(brute(rows, "kappa")), 2: 0}
    found = search.search(tables, "alpha", 50)
    assert sum(r.n for r in search.facets(found, frame(spark, rows), "id", "grp").collect()) == 50
    hits = search.phrase(tables, "alpha beta", frame(spark, rows), "id", "body", 10, 400).collect()
    assert hits and all("alpha beta" in rows[r.doc_key][2] for r in hits)


def test_precision_and_rank(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, doc_key long, rank int")
    good = spark.createDataFrame([(11,)], "doc_key long")
    assert {r.query_id: r.precision for r in evaluate.precision_at_k(found, good, 2).collect()} == {1: 0.5, 2: 0.0}
    assert {r.query_id: r.rr for r in evaluate.reciprocal_rank(found, good).collect()} == {1: 0.5, 2: 0.0}
    a = spark.createDataFrame([(1, 1, -2.0), (1, 2, -1.0)], "query_id long, rank int, score double")
    gaps = evaluate.compare_ranks(a, a.where("rank = 1")).collect()
    assert sorted((r.rank, r.gap) for r in gaps if r.gap is not None) == [(1, 0.0)] and len(gaps) == 2


def test_partial_expression_array_and_partitioned(spark, rows):
    df = frame(spark, rows)
    part = build(df, IndexSpec("p", "id", "body", "ascii_simple", where="grp = 'g1'"))
    expected = brute([r for r in rows if r[1] == "g1"], "alpha")
    assert {r.doc_key: r.score for r in search.search(part, "alpha", None).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}
    concat = build(df, IndexSpec("c", "id", "concat(grp, ' ', lower(body))", "ascii_simple", expression=True))
    assert {r.doc_key % 7 for r in search.search(concat, "g4", None).collect()} == {4}
    arrays = build(df.selectExpr("id", "split(body, ' ') AS body"), SPEC)
    assert {r.doc_key: r.score for r in search.search(arrays, "kappa", None).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in brute(rows, "kappa").items()}
    split = build(df, IndexSpec("s", "id", "body", "ascii_simple", partition_by=("grp",)))
    local = {r.doc_key: r.score for r in search.search(split, "alpha", None).collect()}
    assert {k: v for k, v in local.items() if k % 7 == 1} == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}
    whole = {r.doc_key: r.score for r in search.search(split, "alpha", None, scope="global").collect()}
    assert whole == {k: pytest.approx(v, abs=1e-9) for k, v in brute(rows, "alpha").items()}


def test_documents_without_lexemes_do_not_count(spark):
    rows = [(1, "a", ""), (2, "a", "  ..."), (3, "a", None), (4, "a", "real words")]
    tables = build(frame(spark, rows), SPEC)
    assert tables.stats.collect()[0].n_docs == 1
    assert [r.id for r in standalone.scored(frame(spark, rows), tables, "real").where("score < 0").collect()] == [4]
    empty = build(frame(spark, rows[:3]), SPEC)
    assert search.search(empty, "real").count() == 0


def test_union_and_deletes(spark, rows):
    df = frame(spark, rows)
    halves = union(build(df.where("id < 200"), SPEC), build(df.where("id >= 200"), SPEC))
    assert {r.doc_key: r.score for r in search.search(halves, "eta", None).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in brute(rows, "eta").items()}
    live = without(halves, df.where("id % 3 = 0").selectExpr("id AS doc_key"))
    expected = brute([r for r in rows if r[0] % 3], "eta")
    assert {r.doc_key: r.score for r in search.search(live, "eta", None).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}


def test_store_lifecycle(spark, rows, tmp_path):
    df, path = frame(spark, rows), str(tmp_path / "s")
    store = IndexStore.create(spark, path, df.where("id < 100"), SPEC)
    with pytest.raises(ValueError, match="already exists"):
        IndexStore.create(spark, path, df, SPEC)
    store.fan_in = 3
    for a in (100, 200, 300):
        store.append(df.where(f"id >= {a} AND id < {a + 100}"))
    assert len(store.manifest().segments) < 4
    store.delete(df.where("id < 50").selectExpr("id AS doc_key"))
    store.update(spark.createDataFrame([(60, "g", "omega omega")], "id long, grp string, body string"))
    state = [r for r in rows if r[0] >= 50 and r[0] != 60] + [(60, "g", "omega omega")]
    for _ in range(2):
        got = {r.doc_key: r.score for r in search.search(IndexStore(spark, path).tables(), "omega alpha", None).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in brute(state, "omega alpha").items()}
        store.optimize()
    m = store.manifest()
    assert len(m.segments) == 1 and not m.tombstones and store.pending_files().count() > 3
    assert {r.item: r.value for r in store.summarize().collect()}["total_docs"] == str(len(state))
    assert store.vacuum() > 3 and store.vacuum() == 0
    kept = store.tables().cached()
    assert search.search(kept, "omega", None).count() == 1 and kept.postings.is_cached
    kept.released()
    with pytest.raises(ValueError, match="does not exist"):
        IndexStore(spark, str(tmp_path / "none")).tables()


def test_search_as_a_sql_function(spark, rows):
    tables = build(frame(spark, rows), SPEC)
    register_search(tables, "own_search")
    for query in ("alpha", "eta theta eta", "nowhere"):
        got = {r.doc_key: r.score for r in spark.sql("select * from own_search(:q, 1000)", args={"q": query}).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in brute(rows, query).items()}
    best = [r.doc_key for r in search.search(tables, "eta", 3).collect()]
    assert [r.doc_key for r in spark.sql("select * from own_search('eta', 3) order by score, doc_key").collect()] == best
    with pytest.raises(ValueError, match="stemmer"):
        register_search(replace(tables, spec=replace(SPEC, text_config="english")))


def test_errors_of_scoring(spark, rows):
    with pytest.raises(ValueError, match="operator requires index"):
        Catalog().resolve("t", "body", Bm25Query("x"))
    empty = build(frame(spark, rows).where("false"), replace(SPEC, partition_by=("grp",)))
    with pytest.raises(ValueError, match="no child partitions"):
        standalone.scored(frame(spark, rows), empty, "alpha")


def test_deleted_keys_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "g", "alpha beta"), (2, "g", "alpha"), (3, "g", "gamma")], "id long, grp string, body string")
    store = IndexStore.create(spark, str(tmp_path / "s"), df, SPEC)
    store.delete(spark.createDataFrame([(1,), (9,)], "doc_key long"))
    version = store.manifest().version
    store.delete(spark.createDataFrame([(1,), (9,)], "doc_key long"))
    assert store.manifest().version == version  # nothing was live
    again = [(1, "g", "alpha omega omega")]
    store.append(spark.createDataFrame(again, df.schema))
    state = [(2, "g", "alpha"), (3, "g", "gamma"), *again]
    for _ in range(2):
        for query in ("alpha", "omega"):
            got = {r.doc_key: r.score for r in search.search(store.tables(), query, None).collect()}
            assert got == {k: pytest.approx(v, abs=1e-9) for k, v in brute(state, query).items()}
        store.flush()
        store.update(spark.createDataFrame(again, df.schema))
    rows = store.dump().where("live").select("term", "doc_key", "tf").collect()
    assert sorted(map(tuple, rows)) == [("alpha", 1, 1), ("alpha", 2, 1), ("gamma", 3, 1), ("omega", 1, 2)]


def test_levels_bound_what_appends_write(spark, tmp_path):
    df = spark.createDataFrame([(0, "g", "alpha")], "id long, grp string, body string")
    store = IndexStore.create(spark, str(tmp_path / "s"), df, SPEC)
    store.fan_in = 2
    for k in range(1, 8):
        m = store.append(spark.createDataFrame([(k, "g", "alpha")], df.schema))
        assert [s.level for s in m.segments] == [b for b in range(3, -1, -1) if k + 1 >> b & 1]
    written = spark.read.parquet(str(tmp_path / "s/segments/*/docs")).count()
    assert written == 8 * 4 and search.search(store.tables(), "alpha", None).count() == 8


def test_second_writer_of_a_version_fails(spark, tmp_path):
    df = spark.createDataFrame([(0, "g", "alpha")], "id long, grp string, body string")
    store = IndexStore.create(spark, str(tmp_path / "s"), df, SPEC)
    m = store.manifest()
    store.append(df.withColumn("id", df["id"] + 1))
    with pytest.raises(Conflict):
        store._next(m, segments=m.segments)
    assert store.tables().docs.count() == 2


def test_stream_feeds_an_index_once(spark, rows, tmp_path):
    df = frame(spark, rows)
    df.where("id < 200").write.parquet(str(tmp_path / "in/a"))
    store = IndexStore.create(spark, str(tmp_path / "s"), df.where("false"), SPEC)
    for name, condition in (("b", "id >= 200"), ("c", "id < 10")):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
        feed(stream, store, str(tmp_path / "ck")).awaitTermination()
        df.where(condition).write.parquet(str(tmp_path / f"in/{name}"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
    feed(stream, store, str(tmp_path / "ck")).awaitTermination()
    got = {r.doc_key: r.score for r in search.search(store.tables(), "alpha", None).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in brute(rows, "alpha").items()}


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('1\tsay "hi"\n2\tplain\n')
    df = read_documents(spark, str(tmp_path / "a.tsv"), "tsv", "id long, body string")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'say "hi"'), (2, "plain")]
    with pytest.raises(ValueError):
        read_documents(spark, "x", "csv")
    with pytest.raises(ValueError):
        read_documents(spark, "x", "xml")


# Types


def test_query_text_forms():
    assert Bm25Query.parse("idx:two words") == to_bm25query("two words", "idx")
    assert Bm25Query.parse("plain") == to_bm25query("plain") and str(to_bm25query("q", "i")) == "i:q"
    assert Bm25Query.parse("a:b:c").text == "b:c"


@given(st.text(st.characters(exclude_characters="\x00", exclude_categories=["Cs"])), st.none() | st.from_regex("[a-z_]{1,9}", fullmatch=True))
def test_query_bytes(text, name):
    q = Bm25Query(text, name)
    assert Bm25Query.from_bytes(q.to_bytes()) == q


@given(st.dictionaries(st.from_regex("[a-zé]{1,8}", fullmatch=True), st.integers(0, 2**40), max_size=8))
def test_vector_forms(entries):
    v = Bm25Vector("idx", tuple(sorted(entries.items(), key=lambda e: e[0].encode())))
    assert Bm25Vector.parse(str(v)) == v and Bm25Vector.from_bytes(v.to_bytes()) == v


@pytest.mark.parametrize("bad", ["x", "idx:{a}", "idx:{a:b}", "idx:{a:-1}", ":{a:1}"])
def test_bad_vectors(bad):
    with pytest.raises(ValueError):
        Bm25Vector.parse(bad)
    with pytest.raises(ValueError):
        Bm25Vector.from_bytes(b"BM25\x01rest")


# Errors


@pytest.mark.parametrize("options,message", [({"text_config": ""}, "text_config parameter is required"), ({"k1": 0.01}, "out of bounds"), ({"b": 1.5}, "out of bounds")])
def test_option_errors(options, message):
    with pytest.raises(ValueError, match=message):
        IndexSpec(**{"name": "i", "key": "id", "column": "t", "text_config": "simple"} | options)


def test_wrong_type(spark):
    with pytest.raises(TypeError, match="no default operator class"):
        build(spark.range(3), IndexSpec("i", "id", "id", "simple"))


def test_resolution(spark, tables, caplog):
    catalog = Catalog()
    catalog.add(SPEC, lambda: tables)
    catalog.add(IndexSpec("partial", "id", "title", "simple", where="id > 0", table="docs"), lambda: tables)
    assert catalog.resolve("docs", "body", "x") is SPEC and catalog.resolve("docs", "body", to_bm25query("x", "public.idx")) is SPEC
    for call, message in (
        (lambda: catalog.resolve("docs", "body", to_bm25query("x", "gone")), 'index "gone" does not exist'),
        (lambda: catalog.resolve("docs", "title", to_bm25query("x", "idx")), 'index "idx" is not on column "title"'),
        (lambda: catalog.resolve("docs", None, "x"), "must reference a table column"),
        (lambda: catalog.resolve("docs", "other", "x"), "no BM25 index found for text <@> text expression"),
        (lambda: catalog.resolve("docs", "title", "x"), r"1 partial index\(es\) skipped"),
        (lambda: catalog.add(SPEC, lambda: tables), "already exists"),
    ):
        with pytest.raises(ValueError, match=message):
            call()
    catalog.add(IndexSpec("second", "id", "body", "simple", table="docs"), lambda: tables)
    with caplog.at_level(logging.WARNING):
        assert catalog.resolve("docs", "body", "x") is SPEC
    assert "multiple BM25 indexes exist on the same column" in caplog.text
    assert catalog.search("docs", "body", "alpha", 3).count() == 3
    assert str(catalog.to_bm25vector("Alpha beta alpha", "idx")) == "idx:{alpha:2,beta:1}"
    catalog.drop("second")
    with pytest.raises(ValueError):
        catalog.open("second")


# Plans


def test_plan_prunes_and_has_one_shuffle_by_document(tables):
    plan = search.search(tables, "alpha beta", 10)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan.replace(" ", "") or "term IN" in plan
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning(doc_key") == 1


@pytest.mark.parametrize("name", ["search_three_terms", "facets_of_search", "index_lifecycle"])
def test_registered_queries_equal_their_sql(spark, name):
    import duckdb

    from lexispark.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(rel.select(", ".join(columns)).fetchall())
