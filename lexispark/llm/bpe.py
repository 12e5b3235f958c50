"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are split into pre-tokens. Inside a chunk of texts (bounded bytes and words) each distinct
pre-token gets a rank, and every text becomes its ranks in order: the positions. A chunk's words are
counted in one reading of the input and its positions written in another. Only a chunk's
distinct words are shuffled by word, dealt by word over buckets, where each distinct word of the whole
corpus is encoded once; the ids go back to the chunks and are put in the place of the ranks.
Decoding looks every id up in the token-byte table, whose size is the vocabulary's.

A chunk is named by the digest of its words, so texts and ids can only meet if they come from
the same split (chunks of the same words in the same order share a name, and their ids serve
both); should an input give its rows in another order when read again, the operator
fails and never mixes ids up.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import give_back, tidy

#: Bounds of a chunk, for the memory of a task: characters of text, distinct words and texts.
CHUNK_CHARS = 16 << 20
CHUNK_WORDS = 400_000
CHUNK_ROWS = 200_000


@cache
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens={})


@cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes by id."""
    words = vocabulary(path)
    table = [b""] * (max(words.values()) + 1)
    for token, rank in words.items():
        table[rank] = token
    return table


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2**21 as 1 to 3 bytes of 7 bits; the bytes and each number's length."""
    n = 1 + (ranks >= 1 << 7).astype(np.int64) + (ranks >= 1 << 14)
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint8)
    out[at] = (ranks & 127) | np.where(n > 1, 128, 0)
    for k in (1, 2):
        has = np.flatnonzero(n > k)
        out[at[has] + k] = ((ranks[has] >> (7 * k)) & 127) | np.where(n[has] > k + 1, 128, 0)
    return out, n


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], data[:-1] < 128)))
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.concatenate((first, [len(data)]))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


def _named(raw: list[bytes], rank: np.ndarray) -> bytes:
    """A digest of the words in the order of their ranks: equal names mean equal ranks."""
    words = [raw[i] for i in np.argsort(rank).tolist()]
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return hashlib.blake2b(sizes.tobytes() + b"".join(words), digest_size=16).digest()


def _raw(words) -> list[bytes]:
    return [w.encode() for w in words]  # Spark's strings are valid UTF-8


def _words(pattern: str, buckets: int):
    """An Arrow function: every chunk's distinct pre-tokens with their ranks, a row for each bucket of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, squeeze = regex.compile(pattern).findall, zstandard.ZstdCompressor(3)
        seen: Counter[str] = Counter()
        size = rows = 0

        def close() -> pa.RecordBatch:
            raw = _raw(seen)
            rank = _by_frequency(np.fromiter(seen.values(), np.int64, len(seen)))
            bucket = np.fromiter(map(xxhash.xxh32_intdigest, raw), np.int64, len(raw)) % buckets
            order = np.argsort(bucket, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))) if len(raw) else order
            places, words = [], []
            for at in np.split(order, heads[1:]) if len(raw) else ():
                own = [raw[i] for i in at.tolist()]
                head = np.array([len(own), *map(len, own)], np.uint32).tobytes()
                places.append(squeeze.compress(rank[at].astype(np.uint32).tobytes()))
                words.append(squeeze.compress(head + b"".join(own)))
            columns = [pa.array(bucket[order][heads].astype(np.int32)), pa.array([_named(raw, rank)] * len(words), pa.binary()), pa.array(places, pa.binary()), pa.array(words, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "places", "words"])

        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or ""
                seen.update(find(text))
                rows, size = rows + 1, size + len(text)
                if size >= CHUNK_CHARS or len(seen) >= CHUNK_WORDS or rows >= CHUNK_ROWS:
                    yield close()
                    seen, size, rows = Counter(), 0, 0
        if rows:
            yield close()

    return run


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    """Each word's rank, frequent ones first, so that most positions take one or two bytes."""
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    return rank


def _positions(pattern: str):
    """An Arrow function: every text as the ranks of its pre-tokens in their order, of the same chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        place: defaultdict[str, int] = defaultdict(count().__next__)
        ids: list = []
        bodies: list[np.ndarray] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            rank = _by_frequency(np.bincount(np.concatenate(bodies), minlength=len(place)))
            name = _named(_raw(place), rank)
            for a in range(0, len(ids), 1000):
                some = bodies[a : a + 1000]
                data, n = pack(rank[np.concatenate(some)])
                ends = np.cumsum(np.concatenate(([0], n)))[np.cumsum([0, *map(len, some)])].tolist()
                blob = data.tobytes()
                part = [blob[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.binary()), pa.array(ids[a : a + 1000], pa.int64()), pa.array(part, pa.binary())], names=["chunk", "doc_id", "body"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py() or ""
                found = find(text)
                bodies.append(np.fromiter(map(place.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id.as_py())
                size += len(text)
                if size >= CHUNK_CHARS or len(place) >= CHUNK_WORDS or len(ids) >= CHUNK_ROWS:
                    yield from close()
                    place, ids, bodies, size = defaultdict(count().__next__), [], [], 0
        if ids:
            yield from close()

    return run


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, known, now = encoding(path, pattern)._encode_single_piece, {}, None
        squeeze, loose = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != now:  # sorted by bucket: a word's chunks come together, and it is encoded once
                    known, now = {}, bucket
                data = loose.decompress(words)
                count = int(np.frombuffer(data, np.uint32, 1)[0])
                ends = (4 * count + 4 + np.cumsum(np.frombuffer(data, np.uint32, count, 4))).tolist()
                ids, start = [], 4 * count + 4
                for end in ends:
                    w = data[start:end]
                    ids.append(known.get(w) or known.setdefault(w, piece(w)))
                    start = end
                flat = np.array([x for i in ids for x in i], np.uint32)
                out.append(squeeze.compress(np.array([count, *map(len, ids)], np.uint32).tobytes() + flat.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("places"), pa.array(out, pa.binary())], names=["chunk", "places", "ids"])

    return run


def _assemble(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
    """Ids of every text of one chunk, by position."""
    loose, parts = zstandard.ZstdDecompressor(), []
    for places, ids in zip(dictionary.column("places").to_pylist(), dictionary.column("ids").to_pylist(), strict=True):
        at = np.frombuffer(loose.decompress(places), np.uint32).astype(np.int64)
        data = np.frombuffer(loose.decompress(ids), np.uint32)
        parts.append((at, data[1 : 1 + data[0]].astype(np.int64), data[1 + data[0] :]))
    total = sum(len(x[0]) for x in parts)
    top = max((int(x[0].max()) for x in parts), default=-1) + 1
    size, begin = np.zeros(top, np.int64), np.full(top, -1, np.int64)
    pool = np.concatenate([x[2] for x in parts]) if parts else np.empty(0, np.uint32)
    shift = 0
    for at, n, flat in parts:  # the same words may come twice, from two equal chunks
        size[at], begin[at] = n, shift + np.cumsum(n) - n
        shift += len(flat)
    ids_of, bodies = texts.column("doc_id").to_pylist(), texts.column("body").to_pylist()
    ends, out, n_tokens = [0], [], 0
    for body in bodies:
        ranks = unpack(np.frombuffer(body, np.uint8))
        if len(ranks) and (int(ranks.max()) >= top or (begin[ranks] < 0).any() or total < top):
            raise RuntimeError("the input gave its rows in another order when read again; store it first")
        n = size[ranks]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out.append(pool[np.repeat(begin[ranks], n) + step].astype(np.int32))
        n_tokens += len(step)
        ends.append(n_tokens)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))
    return pa.table({"doc_id": pa.array(ids_of, pa.int64()), "ids": lists})


def encode(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, finish: Callable[[pa.Table], pa.Table] | None = None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text, as tiktoken's encode_ordinary gives them.

    Null and empty texts have no ids; repeated rows, equal texts and rows without an id are
    encoded like any other; other columns play no part; an empty table gives no rows. `path` names a rank file
    that every machine has. `finish` may turn a chunk's rows into others (of `schema`) where
    they arise, so that ids needn't leave their task.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 8 * parts
    rows = docs.select(F.col("doc_id").cast("long"), "text")  # the same columns for both readings: the same partitions
    words = rows.mapInArrow(tidy(_words(pattern, buckets)), "bucket int, chunk binary, places binary, words binary")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_encoder(path, pattern)), "chunk binary, places binary, ids binary")
    texts = rows.mapInArrow(tidy(_positions(pattern)), "chunk binary, doc_id long, body binary")

    def assemble(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = _assemble(a, b)
        out = finish(out) if finish else out
        give_back()
        return out

    return texts.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(assemble, schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """`coded` with a binary column `decoded`: each id joined to the token-byte table, in order.

    The table has as many rows as the vocabulary, whatever the corpus: every task holds it.
    Null ids decode to no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path).__getitem__
        for batch in batches:
            decoded = [b"".join(map(table, ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*coded.dtypes, ("decoded", "binary")]))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(path: str, with_ids: bool = False) -> Callable[[pa.Table], pa.Table]:
    """A function from (doc_id, ids) to DIGEST rows, and the ids if asked for.

    The decoded bytes come from the ids alone, by the same join with the token-byte table.
    """

    def run(coded: pa.Table) -> pa.Table:
        table = token_bytes(path)
        written, known = _written(path).__getitem__, table.__getitem__
        sha, lists = hashlib.sha256, coded.column("ids").combine_chunks()
        n, a, b = [], [], []
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i in range(len(coded)):
            ids = flat[ends[i] : ends[i + 1]].tolist()
            n.append(len(ids))
            a.append(sha(b",".join(map(written, ids))).hexdigest())
            b.append(sha(b"".join(map(known, ids))).hexdigest())
        out = {"doc_id": coded.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
        return pa.table(out | ({"ids": lists} if with_ids else {}))

    return run


@cache
def _written(path: str) -> list[bytes]:
    return [b"%d" % i for i in range(len(token_bytes(path)))]
