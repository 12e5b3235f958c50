"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into longer phrases, and so on. Runs of one
symbol become one; deterministic coin tossing then gives each symbol a label from a small
alphabet that depends on itself and a few symbols before it, and phrases begin where labels are
locally least. A phrase is named by a hash of its symbols' names. Where a phrase begins depends
on a bounded neighbourhood only, so equal substrings get the same interior phrases wherever
they stand. The fingerprint samples the names of two levels (about 10 and 30 bytes) by one
minimum for each of BINS bins; likeness is estimated from equal bins. Texts of few phrases have
the names of the first level in bins of their own, which count only between two such texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import SLICE_BYTES, tidy

BINS = 64
#: Bins of the first level, for short texts.
SHORT_BINS = 32
LEVELS = (2, 3)
#: With fewer phrases than this on the first sampled level, a text is short.
FEW = 16

_RNG = np.random.default_rng(61)
_BYTE_NAMES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _toss_table(size: int) -> np.ndarray:
    """Labels for all pairs (before, own) of symbols below `size`: the lowest bit that differs, and its value."""
    own = np.arange(size, dtype=np.int64)
    x = own[None, :] ^ own[:, None]
    low = np.bitwise_count((x & -x) - 1).astype(np.int64)
    return np.where(x == 0, 0, 2 * low + (own[None, :] >> low & 1)).astype(np.uint8).reshape(-1)


#: From bytes to 16 labels, from 128 to 16, from 16 to 8, from 8 to 6.
_TOSS = {n: _toss_table(n) for n in (256, 128, 16, 8)}


def _toss(labels: np.ndarray, size: int, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing below 256 symbols; a text's first symbol is tossed against 0."""
    before = np.concatenate((labels[:1], labels[:-1]))
    before[first] = 0
    return _TOSS[size][before.astype(np.uint16) * np.uint16(size) + labels]


def _toss_wide(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.concatenate((names[:1], names[:-1]))
    before[first] = 0
    x = names ^ before
    low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64) & np.uint64(63)
    return (np.uint64(2) * low + (names >> low & np.uint64(1))).astype(np.uint8)


def _level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts one level up, and where each text's begin.

    `symbols` holds the texts' symbols one after another, bytes or 64-bit names, `starts` the
    first of each text; no text is empty.
    """
    fresh = np.empty(len(symbols), bool)
    fresh[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
    fresh[starts] = True
    at = np.flatnonzero(fresh)
    run = np.diff(np.concatenate((at, [len(symbols)])))
    symbols = symbols[at]
    first = np.searchsorted(at, starts)
    if symbols.dtype == np.uint8:
        names = _BYTE_NAMES[symbols]
        labels = _toss(symbols, 256, first)
    else:
        names = symbols
        labels = _toss(_toss_wide(symbols, first), 128, first)
    long_ = np.flatnonzero(run > 1)
    if len(long_):
        names = names.copy()
        names[long_] = _stir(names[long_] + run[long_].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    labels = _toss(_toss(labels, 16, first), 8, first)
    # A phrase begins at each text's start and where a label is under its neighbours' in the text.
    begin = np.zeros(len(labels), bool)
    begin[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] <= labels[2:])
    begin[first[1:] - 1] = False  # what follows a text's last symbol is another text
    begin[first] = True
    heads = np.flatnonzero(begin)
    size = np.diff(np.concatenate((heads, [len(labels)])))
    place = np.arange(len(labels)) - np.repeat(heads, size)
    sums = np.add.reduceat(names * _PLACE[np.minimum(place, len(_PLACE) - 1)], heads)
    return _stir(sums + size.astype(np.uint64)), np.searchsorted(heads, first)


def phrase_names(texts: list[bytes], levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from 1: names of all texts' phrases and where each text's begin; no text is empty."""
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts, out = np.cumsum(size) - size, []
    for _ in range(levels):
        symbols, starts = _level(symbols, starts)
        out.append((symbols, starts))
    return out


def sketches(texts: list[bytes]) -> np.ndarray:
    """(texts, BINS + SHORT_BINS) numbers of 24 bits: the least name in each bin, 0 for an empty bin."""
    none, width = np.uint32(1 << 24), BINS + SHORT_BINS
    out = np.full((len(texts), width), none, np.uint32)
    full = [i for i, t in enumerate(texts) if t]
    if full:
        found = phrase_names([texts[i] for i in full], max(LEVELS))
        owners = np.array(full, np.int64)
        counts = [np.diff(np.concatenate((s, [len(n)]))) for n, s in found]
        few = counts[LEVELS[0] - 1] < FEW
        for k, (names, _) in enumerate(found, 1):
            take = few if k not in LEVELS else np.ones(len(full), bool)
            first, bins = (0, BINS) if k in LEVELS else (BINS, SHORT_BINS)
            rows = np.repeat(owners, counts[k - 1])
            if not take.all():
                keep = np.repeat(take, counts[k - 1])
                rows, names = rows[keep], names[keep]
            value = ((names >> np.uint64(20)) & np.uint64((1 << 24) - 1)).astype(np.uint32)
            np.minimum.at(out.reshape(-1), rows * width + first + (names % np.uint64(bins)).astype(np.int64), np.maximum(value, 1))
    out[out == none] = 0
    return out


def text_of(sketch: np.ndarray) -> str:
    """A sketch as 6 hexadecimal digits for each bin."""
    return sketch.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of phrases in common (Dice) of sketches row by row; 1 for two empty texts."""
    short = (a[:, BINS:] > 0).any(axis=1) & (b[:, BINS:] > 0).any(axis=1)
    counts = np.repeat(np.column_stack([np.ones(len(a), bool), short]), (BINS, SHORT_BINS), axis=1)
    used = (((a > 0) | (b > 0)) & counts).sum(axis=1)
    same = ((a == b) & (a > 0) & counts).sum(axis=1)
    return np.where(used == 0, 1.0, 2 * same / np.maximum(used + same, 1))


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """`docs` with a string column `name` of every whole text; null is empty, equal texts are equal."""
    rows = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text_of(s) for s in _sliced(texts)], pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, (name, "string")]))


def _sliced(texts: list[bytes]) -> np.ndarray:
    """`sketches` over parts of about SLICE_BYTES, for the memory of a task."""
    parts, a, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > a and held + len(t) > SLICE_BYTES:
            parts.append(sketches(texts[a:i]))
            a, held = i, 0
        held += len(t)
    parts.append(sketches(texts[a:]))
    return np.concatenate(parts)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each bucket in order, the last one (`extra`) being the next bucket's first."""

    def solve(ids: list, texts: list[str], last: str) -> pa.RecordBatch:
        after = [*texts[1:], last]
        edited = [(t[: len(t) - len(t) // 2] + x[: len(t) // 2]).encode("utf-8", "surrogatepass") for t, x in zip(texts, after, strict=True)]
        own = _sliced([t.encode("utf-8", "surrogatepass") for t in [*texts, last]])
        changed = _sliced(edited)
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([text_of(s) for s in own[:-1]]),
            pa.array([text_of(s) for s in changed]),
            pa.array(likeness(own[:-1], changed)),
            pa.array(likeness(own[:-1], own[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for doc_id, text, extra in zip(batch.column("doc_id"), batch.column("text"), batch.column("extra"), strict=True):
            text = text.as_py() or ""
            # A full slice waits for the row after its last; so does a bucket's end for its extra row.
            if texts and (extra.as_py() or held > SLICE_BYTES):
                yield solve(ids, texts, text)
                ids, texts, held = [], [], 0
            if not extra.as_py():
                ids.append(doc_id.as_py())
                texts.append(text)
                held += len(text)
    if texts:
        raise RuntimeError("a bucket came without the first row of the next one")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds an id is not above: buckets descend with ids; ids that are null come last."""
    if not bounds:
        return F.lit(0)
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= key))
    return F.when(key.isNull(), F.lit(len(bounds))).otherwise(above)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text as the next document edits it.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next):
    documents stand by descending doc_id, nulls last, equal ids by a hash of the text; after
    the last comes the first. The last half of a text's code points gives way to as many (or
    all) of the next text's first. Null texts are empty. Ids are cut into ranges; each range's
    first document is also sent to the end of the range before, so that texts are shuffled
    once. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)]
    bounds = sorted(set(rows.select("doc_id").approxQuantile("doc_id", cuts, 0.1 / parts) if cuts else []))
    placed = rows.withColumn("bucket", _bucket(F.col("doc_id"), [int(b) for b in bounds]))
    mark = F.xxhash64("text").alias("mark")
    # As many heads as buckets at most: their number is the number of partitions.
    heads = rows.select("doc_id", _bucket(F.col("doc_id"), [int(b) for b in bounds]).alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head_id")).collect()
    order = sorted(h.bucket for h in heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    schema = "head_bucket int, head_id long, before int"
    ends = docs.sparkSession.createDataFrame([(h.bucket, h.head_id, before[h.bucket]) for h in heads], schema)
    first = placed.join(F.broadcast(ends), (placed["bucket"] == ends["head_bucket"]) & placed["doc_id"].eqNullSafe(ends["head_id"]))
    # Among rows of the head's id, the one that the order below puts first.
    extra = first.groupBy("before").agg(F.min_by("text", mark).alias("text"))
    extra = extra.select(F.col("before").alias("bucket"), F.lit(True).alias("extra"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("mark"), "text")
    every = placed.select("bucket", F.lit(False).alias("extra"), "doc_id", mark, "text").unionByName(extra)
    ordered = every.repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "mark")
    return ordered.select("doc_id", "text", "extra").mapInArrow(
        tidy(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
