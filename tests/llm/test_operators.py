"""Training-data operators on odd inputs and against brute force."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.llm import bpe, common, fingerprints, lattice_dedup, line_dedup, mixing, quality, secrets, sharding, simhash_dedup, toxicity
from lexispark.llm.common import Forest, components

#: The smallest of the tables that the driver makes.
SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket string, word_ string, score string, drop string, rate string, p string, kept string"
SOME = "the quick brown fox jumps over the lazy dog and runs away from seven angry bears in a dark forest near old town".split()


def prose(seed, n=120):
    rng = random.Random(seed)
    return "\n".join(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(12)) for _ in range(n // 12))


@pytest.fixture(scope="module")
def rows():
    base = prose(1)
    words = base.split(" ")
    near = " ".join(words[:50] + ["changed"] + words[51:])
    out = [
        (7, base), (3, base), (12, near), (None, "no id here\n" + SOME[0]), (None, None), (4, None), (5, ""), (6, "   \n\n "),
        (20, "x"), (21, "long " * 30_000), (22, " ".join(SOME)), (22, " ".join(SOME)), (23, "émoji 😀 ñandú\r\nA password = \"hunter2hunter2\" here"),
        (24, "AKIA" + "Q" * 16 + " and token:short token=abcdefgh1 " + "0123456789abcdef" * 3), (-5, prose(2)),
    ]
    out += [(100 + i, prose(100 + i)) for i in range(25)]
    return [(i, t, None if k % 5 == 0 else "en" if k % 2 else "fr", None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), "a", "b", "c", "d", "e", "f", "g", "h") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


# Components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1080)]
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    expected = {x: forest.find(x) for a, b in edges if a != b for x in (a, b)}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == expected
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 1 Line dedup


def plain_lines(rows):
    occ, marks = {}, {}
    for i, t in rows:
        if t:
            mark = xxhash.xxh64_intdigest(t.encode(), 42)
            marks[(i, t)] = mark - ((mark >> 63) << 64)
            for k, line in enumerate(t.split("\n")):
                if n := line_dedup.normalised(line.lower().encode()):
                    occ.setdefault(n, []).append((i is not None, i or 0, marks[(i, t)], k))
    keys = list(occ)
    forest = Forest()
    for i in range(len(keys)):
        for j in range(i):
            if line_dedup.similar(keys[i].decode(), keys[j].decode()):
                forest.join(i, j)
    best = {}
    for i, k in enumerate(keys):
        r = forest.find(i)
        best[r] = min(best.get(r, occ[k][0]), min(occ[k]))
    gone = {o for i, k in enumerate(keys) for o in occ[k] if o != best[forest.find(i)]}
    seen, out = set(), []
    for i, t in rows:
        if not t:
            out.append((i, t))
            continue
        again = (i, t) in seen
        seen.add((i, t))
        keep = [
            line for k, line in enumerate(t.split("\n"))
            if not (line_dedup.normalised(line.lower().encode()) if again else (i is not None, i or 0, marks[(i, t)], k) in gone)
        ]
        out.append((i, "\n".join(keep)))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_lines_equal_brute_force(spark, docs, rows, none):
    expected = plain_lines([r[:2] for r in rows])
    found = line_dedup.dedup_lines(docs)
    got = found.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(expected, key=key)
    assert {r.drop for r in got} == {"e"} and found.columns == [*docs.columns, "n_lines", "n_dropped"]
    kept = line_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == sum(1 for (_, t), (_, old, *_) in zip(expected, rows, strict=True) if t == old or re.search("[A-Za-z0-9]", t or ""))
    assert line_dedup.dedup_lines(none).count() == 0


def test_fuzzy_lines_meet(spark):
    rng = random.Random(9)
    line = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(60)]
    variants = [" ".join(line[:k] + ["zz"] + line[k + 1 :]) for k in range(0, 60, 3)] + [" ".join(line)]
    rows = [(i, v) for i, v in enumerate(variants)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(plain_lines(rows)) and sum(t == "" for t in got.values()) > 5


def test_hot_groups_are_dealt_in_parts(spark, monkeypatch):
    rng = random.Random(11)
    line = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(80)]
    rows = [(i, " ".join(line[: i % 80] + [f"q{i}"] + line[i % 80 + 1 :])) for i in range(160)]
    monkeypatch.setattr(line_dedup, "SOME", 10)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(plain_lines(rows))


def test_lines_link_by_edit_similarity_alone(spark):
    rng = random.Random(12)
    lines = []
    for n in [1, 2, 3] * 10 + [10, 20, 40] * 6:
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
        lines += [" ".join(words), " ".join([*words[:-1], words[-1][:4] + "z"])]
        if n > 3:  # one word of ten is another
            lines.append(" ".join("".join(rng.choices("klmnop", k=5)) if i % 10 == 4 else w for i, w in enumerate(words)))
    rows = list(enumerate(lines))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    forest = Forest()
    for i in range(len(lines)):
        for j in range(i):
            if line_dedup.similar(lines[i], lines[j]):
                forest.join(i, j)
    assert {i for i, t in got.items() if t} == {forest.find(i) for i in range(len(lines))}


def counts_of(line, n, places=1024):
    """How often the hashed n-grams of a line occur: an edit moves 2n of these at most."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    grams = sum(codes[k : len(codes) - n + 1 + k] * 31**k for k in range(n)) % places if len(codes) >= n else np.empty(0, np.int64)
    return np.bincount(grams, minlength=places).astype(np.int16)


@pytest.mark.skipif(not os.path.exists(f"{SMALL}/documents.parquet"), reason="needs the small tables")
def test_recall_of_line_candidates(spark):
    """Against all pairs of lines of edit similarity 0.8, found without any sketch: counts only rule pairs out."""
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r.text]
    lines = sorted({line_dedup.normalised(x.lower().encode()).decode() for t in texts for x in t.split("\n")} - {""}, key=lambda x: (len(x), x))
    size = np.array([len(x) for x in lines])
    two, three = (np.array([counts_of(x, n) for x in lines]) for n in (2, 3))
    pairs = []
    for j, line in enumerate(lines):
        first, most = int(np.searchsorted(size, 0.8 * len(line) - 1e-9)), 0.2 * len(line) + 1e-9
        near = np.flatnonzero(np.abs(two[first:j] - two[j]).sum(axis=1) <= 4 * most) + first
        near = near[np.abs(three[near] - three[j]).sum(axis=1) <= 6 * most]
        pairs += [(i, j) for i in near.tolist() if line_dedup.similar(lines[i], line)]
    rows = [(k, x) for k, x in enumerate(lines)]
    distinct = line_dedup.occurrences(spark.createDataFrame(rows, "doc_id long, text string"))
    links = line_dedup.candidate_links(distinct.select(F.col("doc_id").alias("node"), *line_dedup.SKETCH), distinct.where("short is not null").select(F.col("doc_id").alias("node"), "short"))
    forest = Forest()
    for a, b in links.collect():
        forest.join(a, b)
    met = sum(forest.find(i) == forest.find(j) for i, j in pairs)
    assert len(pairs) >= 40 and met >= 0.97 * len(pairs)


@pytest.mark.parametrize(("size", "share", "least"), [(40, 0.1, 0.97), (40, 0.2, 0.9), (200, 0.1, 0.95), (200, 0.15, 0.8)])
def test_lines_with_exchanged_words_meet(size, share, least):
    rng = random.Random(size)
    met = 0
    for _ in range(400):
        line, left = [], size
        while left > 0:
            line.append("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))))
            left -= len(line[-1]) + 1
        other, spend = list(line), int(share * size)
        for k in rng.sample(range(len(line)), len(line)):
            if len(line[k]) <= spend:
                spend -= len(line[k])
                other[k] = "".join(rng.choices("qrstuvwxyz", k=len(line[k])))
        met += meet(" ".join(line), " ".join(other))
    assert met >= least * 400


def meet(a, b):
    """Whether two lines are in one group of some table and agree on enough bytes of the sketch."""
    for kind in line_dedup.CLASSES:
        if all(kind.least <= len(x) <= kind.most for x in (a, b)):
            codes = line_dedup.sketches([a.encode(), b.encode()], kind.gram)
            same = codes[0, : line_dedup.HASHES] == codes[1, : line_dedup.HASHES]
            near = line_dedup._near(*line_dedup._nibbles(codes), np.array([0]), np.array([1]), kind.nibbles)[0]
            if near and same.sum() >= kind.agree and same[line_dedup._TRIPLES[: kind.tables]].all(axis=1).any():
                return True
    return False


def test_classes_of_lines_overlap():
    """Two similar lines are both short, or both in one class of sketches."""
    for longer in range(1, 200):
        for shorter in range(int(np.ceil(0.8 * longer - 1e-9)), longer + 1):
            assert longer <= line_dedup.SHORT or any(c.least <= shorter and longer <= c.most for c in line_dedup.CLASSES)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    assert line_dedup.edit_distance(a, b) == row[-1]
    assert line_dedup.edit_distances(b, ["", a, a + "xy", a]).tolist()[:2] == [len(b), row[-1]]
    assert line_dedup.edit_distances(b, [a, "", a]).tolist() == [row[-1], len(b), row[-1]]
    assert not any(line_dedup._at_most(a, b, most) for most in range(row[-1]))


def test_similar_links_equal_brute_force():
    rng = random.Random(9)
    lines = ["".join(rng.choices("ab", k=rng.randint(20, 80))) for _ in range(6)] + [""]
    for _ in range(120):
        line = list(rng.choice(lines))
        for _ in range(rng.randint(1, 12)):
            line[rng.randrange(len(line) + 1) : rng.randrange(len(line) + 1)] = rng.choice("abc")
        lines.append("".join(line))
    found, forest = Forest(), Forest()
    for i, j in line_dedup.similar_links(lines, lambda i: (np.arange(i), np.array([-abs(len(lines[i]) - len(x)) for x in lines[:i]]))):
        assert found.join(i, j)
    for i in range(len(lines)):
        for j in range(i):
            if max(map(len, (lines[i], lines[j]))) * 0.2 + 1e-9 >= line_dedup.edit_distance(lines[i], lines[j]):
                forest.join(i, j)
    assert [found.find(i) for i in range(len(lines))] == [forest.find(i) for i in range(len(lines))]


# 2 Sharding


def test_shards(spark, docs, rows, none, tmp_path):
    got = sharding.shard(docs, 5, store=str(tmp_path / "map")).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=key)
    places = Counter((r.shard, r.slot) for r in got)
    assert max(places.values()) == 1
    for s in range(5):
        assert sorted(x for n, x in places if n == s) == list(range(sum(n == s for n, _ in places)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    stored = sharding.SlotMap.load(spark, str(tmp_path / "map"), 2)
    assert all(stored.shard_of[r.virtual_slot] == r.shard for r in got)
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shard_of == [s % 5 for s in range(sharding.SLOTS)]
    assert sharding.shard(none, 5).count() == 0


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"text {i}") for i in range(2000)] + [(7, f"other {i}") for i in range(2000)] + [(i, "x") for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    held = Counter()
    for r in got:
        held[r.shard] += r.size
    assert max(held.values()) < 1.01 * min(held.values())
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_rebalancing_evens_bytes_with_few_moves():
    rng = random.Random(2)
    sizes = {s: rng.randint(50, 5000) for s in range(8192)}
    old = sharding.SlotMap.even(24)
    new = old.rebalanced(sizes)
    loads = [sum(b for s, b in sizes.items() if new.shard_of[s] == n) for n in range(24)]
    assert max(loads) - min(loads) < 0.002 * sum(loads) / 24
    assert len(new.moved) < 1000 and new.version == 2
    more = new.rebalanced(sizes, 25)
    assert all(more.shard_of[s] == 24 or more.shard_of[s] == new.shard_of[s] for s in range(8192) if s not in more.moved)
    with pytest.raises(ValueError):
        new.rebalanced(sizes, 3)


# 3 Mixing


def test_mixing(spark, docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 20)
    mixed = mixing.mix(docs, keep=0.6)
    assert mixed.count() == docs.count()
    cells = mixing.rake(docs, rounds=10).collect()
    total, mass = sum(r.w for r in cells), sum(r.tokens for r in cells)
    for dim in ("source", "topic"):
        power = mixing.Targets().powers[dim]
        natural = Counter()
        raked = Counter()
        for r in cells:
            natural[r[f"cell_{dim}"]] += r.tokens / mass
            raked[r[f"cell_{dim}"]] += r.w / total
        want = {v: s**power for v, s in natural.items()}
        if dim == "topic":  # the margin that was raked last holds exactly
            assert all(raked[v] == pytest.approx(want[v] / sum(want.values()), rel=1e-6) for v in want)
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    apart = mixing.rake(docs, rounds=10).collect()
    assert sorted((r[0], r[1], r[2], r.tokens, round(r.w, 6)) for r in apart) == sorted((r[0], r[1], r[2], r.tokens, round(r.w, 6)) for r in cells)
    expected = sum(r.p * r.weight * r.n for r in mixed.withColumn("n", mixing.token_count(F.col("text"))).collect())
    assert expected == pytest.approx(0.6 * mass, rel=1e-9)


def test_raking_goes_on_until_margins_hold(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 900), f"s{rng.randrange(9) * rng.randrange(9)}", rng.choice(("en", "en", "en", "de", "fr", "es"))) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    gaps = {}
    for least in (1.0, 1e-9):
        monkeypatch.setattr(mixing, "TOLERANCE", least)
        cells = mixing.rake(table, rounds=1).collect()
        whole, by = sum(r.w for r in cells), Counter()
        for r in cells:
            by[r.cell_lang] += r.w
        gaps[least] = max(abs(by[k] / whole - t) for k, t in {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}.items())
    assert gaps[1e-9] <= 1e-9 < gaps[1.0]


def test_sample_meets_targets_with_a_hot_source(spark):
    rows = [(i, "w " * 20, "en", "hot" if i % 10 else f"s{i // 10 % 2}") for i in range(20_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = mixing.Targets(powers={"source": 0.0}, named={})
    kept = Counter(r.source for r in mixing.sample(table, targets).collect())
    assert all(n / kept.total() == pytest.approx(1 / 3, abs=0.02) for n in kept.values()) and len(kept) == 3


# 4 Byte-level BPE


def test_bpe_round_trip(spark, docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    whole = bpe.encoding(path, P.PATTERN)
    coded = bpe.encode(docs, path, P.PATTERN)
    expected = sorted(((i, whole.encode_ordinary(t or "")) for i, t, *_ in rows), key=key)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=key) == expected
    decoded = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(coded, path).collect()), key=key)
    assert decoded == sorted(((i, t or "") for i, t, *_ in rows), key=key)
    digest = sorted((tuple(r) for r in bpe.encode(docs, path, P.PATTERN, finish=bpe.digests(path), schema=bpe.DIGEST).collect()), key=key)
    assert digest == sorted(((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.decode_bytes(ids)).hexdigest()) for i, ids in expected), key=key)
    assert bpe.encode(none, path, P.PATTERN).count() == 0


def test_bpe_small_chunks(spark, docs, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    before = sorted((tuple(r) for r in bpe.encode(docs, path, P.PATTERN).collect()), key=key)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 40)
    batches = list(bpe._words(P.PATTERN, 3)(iter(docs.select("doc_id", "text").coalesce(1).toArrow().to_batches())))
    assert len({bytes(c.as_py()) for b in batches for c in b.column("chunk")}) > 5
    assert before == sorted((tuple(r) for r in bpe.encode(docs, path, P.PATTERN).collect()), key=key)


@given(st.lists(st.integers(0, (1 << 21) - 1), max_size=50))
def test_packed_positions(values):
    data, _ = bpe.pack(np.array(values, np.int64))
    assert bpe.unpack(data).tolist() == values


# 5 Toxicity, 10 Quality


def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)]
        toxic, bad = i % 4 == 0, i % 3 == 0
        if toxic:
            words[10], words[30] = "dumbhead", "Dumbfolk"
        lines = [" ".join(words[k : k + 12]) for k in range(0, 60, 12)]
        if bad:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), {x[0]: x for x in labels}


def test_classifiers_on_held_out_rows(spark, docs, none):
    train, labels, truth = labelled(spark)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    chain, machine = quality.train(train, labels), toxicity.train(train, labels)
    good = {r.doc_id: r.score for r in quality.with_quality(train, chain).collect()}
    toxic = {r.doc_id: r.score for r in toxicity.with_toxicity(train, machine).collect()}
    assert np.mean([(good[i] >= 0.5) == truth[i][1] for i in held]) > 0.97
    assert np.mean([(toxic[i] >= 0.7) == truth[i][2] for i in held]) > 0.97
    for scored in (quality.with_quality(docs, chain), toxicity.with_toxicity(docs, machine)):
        got = scored.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        by_text = {}
        for r in got:
            by_text.setdefault(r.text or "", set()).add(round(r.score, 9))
        assert all(len(s) == 1 for s in by_text.values())
    assert quality.with_quality(none, chain).count() == 0 and toxicity.with_toxicity(none, machine).count() == 0
    kept = quality.keep_good(train, labels)
    assert kept.columns == train.columns and set(r.doc_id for r in kept.collect()) >= {i for i, x in truth.items() if x[1]}


def test_labels_outside_training_are_not_used(spark):
    train, labels, truth = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(train, labels), toxicity.train(train, flipped)
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_classifiers_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score < 0.7 for r in toxicity.with_toxicity(docs, toxicity.train(docs, empty)).collect()} == {True}
    assert quality.with_quality(docs, quality.train(docs, empty)).count() == docs.count()


def test_repeated_ids_do_not_swell_the_sample(spark):
    rows = [(1, f"text {k}") for k in range(500)] + [(i, "x") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    found = common.labelled_sample(docs, labels, "quality", 10).collect()
    picked = [r.doc_id for r in found]
    assert len(found) <= 20 and len(set(picked)) == len(picked)
    every = {r.doc_id: r.text for r in common.labelled_sample(docs, labels, "quality", 100).collect()}
    assert every.get(1, "text 0") == "text 0"


def pair_task(n, seed=1):
    """Texts toxic by which two words meet, never by one of them."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        insult, label = rng.randrange(2), i % 2
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(30)] + [("vork", "blem")[insult], ("zund", "kelp")[insult if label else 1 - insult]]
        rng.shuffle(words)
        rows.append((np.array(toxicity.all_terms(" ".join(words))), label))
    return [t for t, _ in rows], [k for _, k in rows]


def test_machine_learns_pairs_that_weights_miss():
    terms, labels = pair_task(1500)
    known, rest = (terms[:1000], labels[:1000]), (terms[1000:], np.array(labels[1000:]))
    machine = toxicity.fit(*known)
    rows = [m[m >= 0] for m in (machine.place[t] for t in rest[0])]
    assert ((machine.scores(rows) >= 0.5) == rest[1]).mean() > 0.97
    linear = toxicity.Machine(machine.place, machine.weight, np.zeros_like(machine.factor), machine.bias)
    assert ((linear.scores(rows) >= 0.5) == rest[1]).mean() < 0.7


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_machine_scores_equal_direct_sums(seed):
    rng = np.random.default_rng(seed)
    machine = toxicity.Machine(np.empty(0), rng.normal(size=12), rng.normal(size=(12, 4)), 0.3)
    rows = [rng.choice(12, int(rng.integers(0, 8)), replace=False) for _ in range(5)]
    for row, score in zip(rows, machine.scores(rows), strict=True):
        z = 0.3 + machine.weight[row].sum() + sum(machine.factor[a] @ machine.factor[b] for k, a in enumerate(row) for b in row[:k])
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_every_line_takes_part_in_the_fit(monkeypatch):
    """Documents that differ only after their first hundred lines are told apart, in chains of any length."""
    head = ["Some plain words stand in this line."] * 100
    texts = ["\n".join([*head, *(["Good words again follow here."] * 120 if k % 2 else ["@@## !! %% $$ ++ ==" ] * 120)]) for k in range(8)]
    labels = [k % 2 for k in range(8)]
    for run in (16, 64):
        monkeypatch.setattr(quality, "FIT_RUN", run)
        chain = quality.fit([quality.line_features(t)[0] for t in texts], labels)
        assert ((quality.qualities(texts, chain) >= 0.5) == np.array(labels, bool)).all()


def test_quality_equals_enumeration():
    """A document's quality: P(good) of each line summed over all labellings, weighted by length plus one."""
    rng = np.random.default_rng(3)
    width = 3 * quality.BASE + 2
    chain = quality.Chain(rng.normal(size=width), rng.uniform(0.5, 2, width), rng.normal(size=width) / 5, 0.2, rng.normal(size=4))
    for text in ("", "one line", "Ab c\n\n12!! x\nfour words stand here\n??"):
        x, n = quality.line_features(text)
        score, good, whole = chain.emissions(x), np.zeros(len(n)), 0.0
        for labels in np.ndindex(*[2] * len(n)):
            p = np.exp(sum(s * y for s, y in zip(score, labels, strict=True)) + sum(chain.stay[2 * a + b] for a, b in zip(labels, labels[1:])))
            whole += p
            good += p * np.array(labels)
        assert abs(quality.qualities([text], chain)[0] - (good / whole * (n + 1)).sum() / (n + 1).sum()) < 1e-9


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    score, stay = rng.normal(size=8), rng.normal(size=4)
    p, pairs = quality.marginals(score, sizes, stay)
    expected, counts, at = [], np.zeros(4), 0
    for n in sizes:
        mass, good, trans = 0.0, np.zeros(n), np.zeros(4)
        for bits in np.ndindex(*(2,) * n):
            w = np.exp(sum(score[at + k] * b for k, b in enumerate(bits)) + sum(stay[2 * a + b] for a, b in zip(bits, bits[1:], strict=False)))
            mass += w
            good += w * np.array(bits)
            for a, b in zip(bits, bits[1:], strict=False):
                trans[2 * a + b] += w
        expected.extend(good / mass)
        counts += trans / mass
        at += n
    assert p == pytest.approx(expected) and pairs == pytest.approx(counts)


def test_line_features():
    x, n = quality.line_features("Ab c\n\n12!! x")
    assert n.tolist() == [4, 0, 6] and x.shape == (3, 3 * quality.BASE + 2)
    assert x[0, 0] == pytest.approx(1 / 3) and x[1, 12] == 1 and x[2, 5] == pytest.approx((2 / 6) ** 0.5)
    assert (x[1, quality.BASE : 2 * quality.BASE] == x[0, : quality.BASE]).all()


# 6 Fingerprints


def test_fingerprints_with_edits(spark, docs, rows, none):
    def order(r):
        mark = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return (r[0] is None, -(r[0] or 0), mark - ((mark >> 63) << 64))

    ordered = sorted(rows, key=order)
    expected = Counter()
    for r, nxt in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        a, b = r[1] or "", nxt[1] or ""
        expected[(r[0], len(a), hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest())] += 1
    got = fingerprints.with_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    plain = {r.text or "": r.fingerprint for r in fingerprints.with_fingerprint(docs).collect()}
    assert all(plain[t or ""] == r.fingerprint for r in got for i, t, *_ in rows if i == r.doc_id and i is not None and i != 22 and len(t or "") == r.n_chars)
    assert fingerprints.with_edits(none).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    row = fingerprints.with_edits(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=600, max_size=1500), st.binary(max_size=90), st.binary(max_size=90))
def test_equal_substrings_share_interior_phrases(text, left, right):
    (names, _) = fingerprints.phrase_names([text], 2)[1]
    (others, _) = fingerprints.phrase_names([left + text + right], 2)[1]
    inner = names[8:-8].tolist()
    assert not inner or any(others[i : i + len(inner)].tolist() == inner for i in range(len(others)))


def plain_stir(x):
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & (1 << 64) - 1
    return x ^ x >> 33


def plain_phrases(symbols, named):
    """Names of the phrases of one text, symbol by symbol: runs, rounds of coin tossing, phrases at local minima."""

    def toss(values):
        out = []
        for before, own in zip([0, *values], values):
            low = ((before ^ own) & -(before ^ own)).bit_length() - 1
            out.append(0 if before == own else 2 * low + (own >> low & 1))
        return out

    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    labels = [x for x, _ in runs]
    for _ in range(4 if named else 3):  # 64-bit names are tossed to 128 labels first
        labels = toss(labels)
    names = [x if named else int(fingerprints._BYTE_NAMES[x]) for x, _ in runs]
    names = [plain_stir((x + n * 0xD1B54A32D192ED03) & (1 << 64) - 1) if n > 1 else x for x, (_, n) in zip(names, runs)]
    phrases = [[]]
    for k, name in enumerate(names):
        if 0 < k < len(names) - 1 and labels[k] < labels[k - 1] and labels[k] <= labels[k + 1]:
            phrases.append([])
        phrases[-1].append(name)
    return [plain_stir((sum(x * int(fingerprints._PLACE[min(k, 4095)]) for k, x in enumerate(p)) + len(p)) & (1 << 64) - 1) for p in phrases]


def plain_sketch(data):
    levels, symbols = [], list(data)
    for k in range(3 if data else 0):
        symbols = plain_phrases(symbols, k > 0)
        levels.append(symbols)
    least = {}
    for k, names in enumerate(levels, 1):
        for x in names if k > 1 or len(levels[1]) < fingerprints.FEW else ():
            place = x % fingerprints.BINS if k > 1 else fingerprints.BINS + x % fingerprints.SHORT_BINS
            least[place] = min(least.get(place, 1 << 24), max(x >> 20 & (1 << 24) - 1, 1))
    return least


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    both = max(a, default=0) >= fingerprints.BINS and max(b, default=0) >= fingerprints.BINS
    a, b = ({k: v for k, v in x.items() if both or k < fingerprints.BINS} for x in (a, b))
    same = sum(b.get(k) == v for k, v in a.items())
    return 2 * same / (len(a.keys() | b.keys()) + same)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=400), st.text("ab c", max_size=400).map(str.encode)), min_size=2, max_size=4))
def test_fingerprints_equal_a_plain_version(texts):
    texts = [*texts, texts[0] + texts[1], b"", b"aaaaaa" * 30]
    found, plain = fingerprints.sketches(texts), [plain_sketch(t) for t in texts]
    for row, least in zip(found, plain, strict=True):
        assert {k: int(v) for k, v in enumerate(row) if v} == least
    for a, b in zip(range(len(texts)), range(1, len(texts))):
        assert fingerprints.likeness(found[a : a + 1], found[b : b + 1])[0] == pytest.approx(plain_likeness(plain[a], plain[b]))


def test_likeness_follows_shared_text():
    a, b, c = (prose(s, 360).encode() for s in (31, 32, 33))
    half = a[: len(a) // 2] + b[: len(a) // 2]
    s = fingerprints.sketches([a, half, c, a, b""])
    assert 0.3 < fingerprints.likeness(s[:1], s[1:2])[0] < 0.75
    assert fingerprints.likeness(s[:1], s[2:3])[0] < 0.1
    assert fingerprints.text_of(s[0]) == fingerprints.text_of(s[3]) and set(fingerprints.text_of(s[4])) == {"0"}


# 7 Lattice near-dedup


def test_e8_decoding():
    assert len(lattice_dedup.NEIGHBOURS) == 240 and ((lattice_dedup.NEIGHBOURS**2).sum(axis=1) == 2).all()
    y = np.random.default_rng(0).normal(size=(300, 8)) * 3
    near = lattice_dedup.decode(y)
    d = ((y - near) ** 2).sum(axis=1)
    assert all((((y - near - v) ** 2).sum(axis=1) >= d - 1e-9).all() for v in lattice_dedup.NEIGHBOURS)


def embeddings(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 32))
    out = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.3])
        out.append((i, [float(x) for x in v], int(i % 3 == 0)))
    same = [float(x) for x in base[0]]
    return out + [(1000, same, 1), (1001, same, 1), (1002, [2 * x for x in same], 1), (1003, same, None), (1004, None, 1), (1005, [0.0] * 32, 1), (1006, [float("nan"), *same[1:]], 1), (1007, [None, *same[1:]], 1), (1008, same[:8], 1), (1009, same[:8], 1), (1010, [], 1), (1011, [1e300] * 32, 1), (1012, [1e-300] * 32, 1)]


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rows = embeddings()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("x")).withColumn("rep", F.lit("x"))
    unit = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = (x / np.linalg.norm(x), label)
    n, forest = Counter(), Forest()
    for i, (a, la) in unit.items():
        for j, (b, lb) in unit.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= 0.93:
                n[i] += 1
                n[j] += 1
                forest.join(i, j)
    expected = {i: (n[i], forest.find(i), forest.find(i) == i) for i, _, _ in rows}
    for part in (4096, 7):
        monkeypatch.setattr(lattice_dedup, "PART", part)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_groups(df).collect()}
        assert got == expected
    assert lattice_dedup.near_groups(df.where("false")).count() == 0


def test_full_cells_need_little_memory():
    """Thousands of near vectors in one cell are compared block by block, not as a square."""
    import tracemalloc

    n = 6000
    rng = np.random.default_rng(2)
    v = rng.normal(size=64) + rng.normal(size=(n, 64)) * 0.02
    columns = {"cell": np.zeros(n, np.int64), "one": np.zeros(n, np.int32), "two": np.zeros(n, np.int32), "own_part": np.zeros(n, np.int32), "rep": np.arange(n), "copies": np.ones(n, np.int64), "label": np.zeros(n, np.int64)}
    batch = pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns.values()), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64).cast(pa.list_(pa.float64()))], names=[*columns, "v"])
    tracemalloc.start()
    links = sum(b.num_rows for b in lattice_dedup._forest(0.93)(iter([batch])))
    counted = sum(int(b.column("n").to_numpy().sum()) for b in lattice_dedup._counts(0.93)(iter([batch.rename_columns(["component", *batch.schema.names[1:]])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == n - 1 and counted == n * (n - 1) and peak < 500e6


# 8 SimHash near-dedup


def plain_simhash(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, docs, rows, none):
    fps = [plain_simhash(r[1], 4) for r in rows]
    forest = Forest()
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                forest.join(i, j)
    least = {}
    for k, r in enumerate(rows):
        least.setdefault(forest.find(k), []).append(r[0])
    best = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    expected = sorted(((r[0], fps[k] - ((fps[k] >> 63) << 64), best[forest.find(k)]) for k, r in enumerate(rows)), key=key)
    assert sorted((tuple(r) for r in simhash_dedup.near_groups(docs).collect()), key=key) == expected
    assert simhash_dedup.near_groups(none).count() == 0


def plain_similar(rows, least=0.8, width=5):
    """(doc_id, component_id) by Jaccard similarity of all pairs' shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    forest = Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j])):
                forest.join(i, j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best.setdefault(forest.find(k), []).append(i)
    return sorted(((i, min((x for x in best[forest.find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=key)


@pytest.mark.parametrize("parted", [False, True])
def test_similar_documents_equal_brute_force(spark, docs, rows, none, monkeypatch, parted):
    if parted:  # groups in pairs of parts
        monkeypatch.setattr(simhash_dedup, "SOME", 3)
    rng = random.Random(8)
    more = []
    for i in range(12):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(150)]
        for j in range(6):
            changed = list(words)
            for k in rng.sample(range(150), j):
                changed[k] = "new"
            more.append((1000 + 10 * i + j, " ".join(changed)))
    every = [r[:2] for r in rows] + more
    df = spark.createDataFrame(every, "doc_id long, text string")
    expected = plain_similar(every)
    assert sorted((tuple(r) for r in simhash_dedup.similar_groups(df).collect()), key=key) == expected
    kept = simhash_dedup.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    best = {c for _, c in plain_similar([r[:2] for r in rows]) if c is not None}
    assert sorted(i for i in ids if i is not None) == sorted(best) and ids.count(None) == 2
    assert simhash_dedup.similar_groups(none).count() == 0 and simhash_dedup.keep_one(none).count() == 0


def test_repeated_passages_do_not_part_similar_documents(spark):
    rng = random.Random(4)
    rows = []
    for i in range(20):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + words[40:54] * 40))]
    expected = plain_similar(rows)
    found = simhash_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=key) == expected and len({c for _, c in expected}) == 20


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_near_links_equal_brute_force(spark, agree):
    rng = np.random.default_rng(agree)
    centres = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    codes = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False))) for c in np.repeat(centres, 8)])
    table = spark.createDataFrame([(x,) for x in codes.view(np.int64).tolist()], "fp long")
    seen, forest = Forest(), Forest()
    for src, dst in simhash_dedup.near_links(table, 3, agree).collect():
        assert ((src ^ dst) & (2**64 - 1)).bit_count() <= 3
        seen.join(src, dst)
    signed = codes.view(np.int64).tolist()
    assert {x for x in seen.up} <= set(signed)
    for i, a in enumerate(codes.tolist()):
        for j in range(i):
            if (a ^ int(codes[j])).bit_count() <= 3:
                forest.join(signed[i], signed[j])
    assert [seen.find(x) for x in signed] == [forest.find(x) for x in signed]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1000), st.sampled_from([3, 4]), st.sampled_from([1, 2, 3]), st.sampled_from([3, 512]), st.sampled_from([40, 4 << 20]))
def test_gray_index_finds_all_links(seed, distance, agree, block, steps):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for c in np.repeat(centres, 30)])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash_dedup, "BLOCK", block)
        patch.setattr(simhash_dedup, "STEPS", steps)
        layout = simhash_dedup.Layout(distance, agree)
        forest, seen = Forest(), Forest()
        for t in range(len(layout.key_bits)):
            permuted = layout.permute(codes, t)
            assert (layout.restore(permuted, t) == codes).all()
            rank = np.sort(simhash_dedup.gray_rank(permuted))
            ordered = rank ^ (rank >> np.uint64(1))
            places, starts = simhash_dedup._shared_groups([rank >> np.uint64(64 - layout.key_bits[t])])
            if not len(places):
                continue
            back = layout.restore(ordered[places], t)
            for i, j in zip(*simhash_dedup.spanning_links(ordered[places], starts, distance), strict=True):
                assert (int(back[i]) ^ int(back[j])).bit_count() <= distance
                assert seen.join(int(back[i]), int(back[j])) or t
        for i in range(len(codes)):
            for j in range(i):
                if (int(codes[i]) ^ int(codes[j])).bit_count() <= distance:
                    forest.join(int(codes[i]), int(codes[j]))
        assert all(seen.find(int(c)) == forest.find(int(c)) for c in codes)


@pytest.mark.skipif(not os.path.exists(f"{SMALL}/documents.parquet"), reason="needs the small tables")
def test_gray_index_prunes(spark):
    """Of the fingerprints of `documents` as one group the index looks at few pairs, of a dense cluster at fewer."""
    fps = simhash_dedup.fingerprints(spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet"))
    codes = np.unique(np.array([r.fp for r in fps.collect()], np.int64).view(np.uint64))
    cluster = np.unique([np.uint64(sum(1 << int(b) for b in np.random.default_rng(k).choice(64, 2, replace=False))) for k in range(1500)])
    for own, most in ((codes, 0.5), (cluster, 0.6)):
        rank = np.sort(simhash_dedup.gray_rank(own))
        ordered = rank ^ (rank >> np.uint64(1))
        index = simhash_dedup.GrayIndex(ordered, np.zeros(1, np.int64))
        i, j = simhash_dedup.spanning_links(ordered, np.zeros(1, np.int64), 4, index=index)
        assert len(index.levels) > 3 and index.compared < most * len(own) * (len(own) - 1) / 2
        forest, pairs = Forest(), np.argwhere(np.triu(np.bitwise_count(ordered[:, None] ^ ordered[None, :]) <= 4, 1))
        assert len(i) == sum(forest.join(a, b) for a, b in pairs.tolist())


def test_whole_groups_are_never_parted():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 6, 300))
    for size in (1, 7, 100, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + size]), pa.array(np.arange(300)[a : a + size])], names=["k", "v"]) for a in range(0, 300, size)]
        found = list(simhash_dedup.whole_groups(iter(batches), ("k",), ("k", "v")))
        assert np.concatenate([v for _, v in found]).tolist() == list(range(300))
        assert all(not set(a[0]) & set(b[0]) for k, a in enumerate(found) for b in found[:k])


# 9 Secret scans


def plain_spans(text):
    out = []
    for order, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        flags = re.ASCII | (re.IGNORECASE if rule.pattern.startswith("(?i)") else 0)
        for m in re.finditer(rule.pattern.removeprefix("(?i)"), text or "", flags):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, rule.kind, m.end()))
    return sorted(out)


def test_secrets_equal_brute_force(spark, docs, rows, none):
    texts = [
        'PassWord: "abc12345" token=token:abcdefgh1 api_key=  "x/y+z.==-" apikey=12345678', "😀😀 secret=abcdefgh 😀 passwd='12345678'", "AKIA" * 5, "AKIAAAAA" + "A" * 11,
        "f" * 31 + " " + "f" * 32, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36 + " xoxb-1234567890 http://u:p@h", "token=" + "a" * 5000, "password\npassword=longenough",
        "KKEN tokKen=abcdefghi", "secret=\n=abcdefgh", "api-key=abcdefgh api__key=abcdefgh",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1, "password=otherpass1")], "doc_id long, text string")
    for frame, pairs in ((df, [*enumerate(texts), (None, texts[0]), (1, "password=otherpass1")]), (docs, [r[:2] for r in rows])):
        got = sorted(((r.doc_id, [(s.start, s.order, s.kind, s.end) for s in r.found]) for r in secrets.scan(frame).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert got == sorted(((i, plain_spans(t)) for i, t in pairs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert secrets.scan(none).count() == 0


def holds(query, text):
    if query is True or isinstance(query, str):
        return query is True or query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query("[0-9a-f]{32,}") is True and secrets.trigram_query("ab|abcd") is True
    assert secrets.trigram_query("(abc|xyz)d*") == ("or", ("abc", "xyz"))
    assert secrets.trigrams(secrets.trigram_query(r"api_?key\d")) >= {"key", "pik", "pi_"}


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([r.pattern for r in secrets.BASE_RULES + secrets.MORE_RULES] + ["(foo|ba?r)+x{2}baz", "a(bc|de)f.gh[ij]k", "x?yz{3}w"]), st.data())
def test_matches_satisfy_their_query(pattern, data):
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII)))
    assert holds(secrets.trigram_query(pattern), text)


def test_native_operators_run_no_python(docs):
    for frame in (secrets.digest(secrets.scan(docs)), mixing.mix(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan


def test_rows_of_a_crowd_of_lines_grow_with_its_lines_only(spark, monkeypatch):
    rng = random.Random(21)
    line = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(80)]
    rows = [(i, " ".join(line[: i % 80] + [f"q{i}"] + line[i % 80 + 1 :])) for i in range(160)]
    rows += [(200 + i, f"abc {i:04d}") for i in range(40)]
    monkeypatch.setattr(line_dedup, "CROWD", 12)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(plain_lines(rows))
    lines = line_dedup.occurrences(spark.createDataFrame(rows[:160], "doc_id long, text string"))
    crowd = lines.select(F.lit(1).cast("long").alias("root"), F.col("doc_id").alias("node"), *line_dedup.SKETCH, F.lit("x" * 20).alias("line"))
    assert line_dedup.meetings(crowd).count() == 160 * line_dedup.CLASSES[1].tables


def test_distances_end_early_only_above_the_most():
    rng = random.Random(22)
    for _ in range(60):
        a = "".join(rng.choices("abc d", k=rng.randrange(60, 300)))
        others = ["".join(c if rng.random() > share else rng.choice("xyz") for c in a)[: rng.randrange(40, 300)] for share in (0.05, 0.15, 0.3, 0.6)] + [a + "xy", ""]
        exact = line_dedup.edit_distances(a, others)
        for part in (others, others[2:4], others[3:]):
            most = np.array([0.2 * max(len(a), len(x)) for x in part])
            true = np.array([line_dedup.edit_distance(a, x) for x in part])
            found = line_dedup.edit_distances(a, part, most)
            assert ((found <= most) == (true <= most)).all() and (found <= true).all()
            assert all((line_dedup.edit_distance(a, x, m) <= m) == (t <= m) for x, m, t in zip(part, most, true, strict=True))
        assert exact.tolist() == [line_dedup.edit_distance(a, x) for x in others]


def test_steps_leave_neither_shuffles_nor_tables(spark):
    """Disk has what is still to be read, not all that was ever written: else large inputs fill it."""

    def shuffles():
        return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().toString().count("shuffle_")

    def settled(most):
        for _ in range(100):
            if shuffles() <= most:
                return True
            time.sleep(0.1)
        return False

    folder = common.shared_folder(spark)
    rows = [(i, "\n".join(f"{'abcdefg ' * 4}{j % 50} line" for j in range(i, i + 30))) for i in range(60)]
    docs, before, had = spark.createDataFrame(rows, "doc_id long, text string"), shuffles(), set(os.listdir(folder))
    common.stored(docs.repartition(5, "doc_id").groupBy("text").count(), "some")
    common.cut(docs.repartition(5, "doc_id").groupBy("text").count())
    assert settled(before)
    gone = line_dedup.repeats(docs)
    assert settled(before + 20)  # components look at every round's links, which are few
    assert {f.split("-")[1] for f in set(os.listdir(folder)) - had if f.startswith(("line", "distinct", "similar"))} == {"drops"}
    assert gone.count() > 0


def test_common_subsequences_rule_pairs_out_first():
    def least(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return max(len(a), len(b)) - row[-1]

    rng, ruled = random.Random(23), 0
    for _ in range(40):
        a = "".join(rng.choices("abcdé 日", k=rng.randrange(40, 200)))
        others = ["".join(c if rng.random() > share else rng.choice(["x", "", "yz"]) for c in a) for share in (0.1, 0.2, 0.3, 0.6)]
        most, true = np.array([0.2 * max(len(a), len(x)) + 1e-9 for x in others]), line_dedup.edit_distances(a, others)
        bound = np.array([least(a, x) for x in others])
        assert (bound <= true).all()
        for found in (line_dedup.edit_distances(a, others, most), np.array([line_dedup.edit_distance(a, x, m) for x, m in zip(others, most, strict=True)])):
            assert found[bound > most].tolist() == bound[bound > most].tolist() and ((found <= most) == (true <= most)).all()
            assert found[true <= most].tolist() == true[true <= most].tolist()
        ruled += (bound > most).sum()
    assert ruled > 40


def test_small_groups_of_lines_are_verified_together():
    """Most groups have two lines: numpy, Arrow and Spark steps for each of them took longer than the comparison."""
    rng, rows, true = random.Random(25), [], Forest()
    for group in range(80):
        first = rng.choice(["abc", "".join(rng.choices("abcdefgh ij", k=rng.randrange(20, 400))), "日本 語é" * 12])
        own = []
        for k in range(rng.choice([1, 2, 2, 2, 3, 12])):
            line = "".join(c if rng.random() > 0.03 * k else rng.choice("xyz") for c in first) + "w" * k
            own.append((len(rows) + k, line))
        rows += [(group, node, line) for node, line in own]
    codes = pa.RecordBatch.from_arrays(line_dedup._sketched([x[2].encode() for x in rows]), names=list(line_dedup.SKETCH))
    n = len(rows)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in rows]), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows]), *codes.columns],
        names=["root", "part", "own", "met", "node", "line", *line_dedup.SKETCH],
    )
    agree = {k: c.agree for k, c in enumerate(line_dedup.CLASSES)}
    bytes_of = [np.column_stack([codes.column(c).fill_null(0).to_numpy() for c in own]).view(np.uint8)[:, : line_dedup.HASHES] for own in line_dedup._OF]
    for i, (group, _, line) in enumerate(rows):
        for j, (other, _, text) in enumerate(rows[:i]):
            both = [codes.column(own[0])[i].is_valid and codes.column(own[0])[j].is_valid for own in line_dedup._OF]
            seen = any(b and (bytes_of[k][i] == bytes_of[k][j]).sum() >= agree[k] for k, b in enumerate(both))
            if group == other and (seen or max(len(line), len(text)) <= line_dedup.SHORT) and line_dedup.similar(line, text):
                true.join(i, j)
    for batches in ([batch], [batch.slice(k, 7) for k in range(0, n, 7)], [batch.slice(k, 1) for k in range(n)], [batch.slice(0, 0), batch]):
        out, found = list(line_dedup._verify(iter(batches))), Forest()
        assert all(found.join(i, j) for x in out for i, j in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
        assert [found.find(i) for i in range(n)] == [true.find(i) for i in range(n)]
        assert len(out) <= len(batches) + 1
    assert len({true.find(i) for i in range(n)}) < n


def test_common_subsequences_decide_most_pairs(monkeypatch):
    rng, steps, decided = random.Random(26), [], 0
    taken = line_dedup._steps
    monkeypatch.setattr(line_dedup, "_steps", lambda *x: steps.append(x) or taken(*x))
    for _ in range(200):
        a = "".join(rng.choices("abcdé 日", k=rng.randrange(10, 1500)))
        share = rng.choice([0.02, 0.1, 0.2, 0.5])
        b = "".join(c if rng.random() > share else rng.choice(["x", "", "yz"]) for c in a)
        most = 0.2 * max(len(a), len(b)) + 1e-9
        true = line_dedup.edit_distance(a, b) <= most
        before = len(steps)
        assert line_dedup._within(a, b, most) == true
        decided += len(steps) == before
    assert decided > 80


def test_lines_of_a_text_are_normalised_together():
    rng = random.Random(27)
    texts = ["", "\n", " \n \n", "a" + " " * 1000 + "b\n" + "." * 999, "  A-b\r\n\tc\x0b d \n\n e "]
    texts += ["".join(rng.choices("ab. \n\t-É日\x1c", k=rng.randrange(60))) for _ in range(300)]
    for text in texts:
        octets = text.lower().encode()
        assert line_dedup._normalised_lines(octets) == [line_dedup.normalised(x) for x in octets.split(b"\n")]


def test_sketches_take_no_shingles_of_two_lines():
    rng = random.Random(28)
    lines = [bytes(rng.choices(b"abcdefgh", k=rng.choice([0, 1, 3, 4, 5, 6, 7, 50, 3000]))) for _ in range(300)]
    for kind in line_dedup.CLASSES:
        assert (line_dedup.sketches(lines, kind.gram) == np.vstack([line_dedup.sketches([x], kind.gram) for x in lines])).all()


def test_links_of_a_batch_are_stars():
    rng = random.Random(29)
    node = np.array(rng.sample(range(-500, 500), 300))
    for pairs in ([], [(3, 3)], [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]):
        true = Forest()
        for i, j in pairs:
            true.join(int(node[i]), int(node[j]))
        out = line_dedup._stars(node, *np.array(pairs, np.int64).reshape(-1, 2).T)
        found = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
        assert len(found) == len(out) and found == {int(x): true.find(int(x)) for x in node if true.find(int(x)) != x}


def test_texts_of_line_dedup_are_shuffled_once(spark):
    rows = [(i, "\n".join(f"{'abcdefg ' * 4}{j % 50} line" for j in range(i, i + 30))) for i in range(60)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(re.findall(r"Exchange hashpartitioning\((cast\()?place_", plan)) == 1
