"""SimHash near-duplicate documents by a Gray-order hierarchical index.

A document's fingerprint has a bit for each bit that over half of its word shingles' hashes
set. Fingerprints within `distance` bits are linked; a component is what links connect.

The search sorts fingerprints by Gray rank, in which neighbours share long bit patterns. The
upper nodes of the distributed index are those patterns: 64 bits are cut into distance + 2
segments, of which two fingerprints within `distance` agree on two at least, so for each pair
of segments the fingerprints are permuted to begin with them and grouped by that shared
masked pattern. Inside every group, of two codes or a million, `GrayIndex` factors the bits that
runs of Gray neighbours share into further nodes, and a search drops a whole run as soon as the
differences accumulated on the way down exceed `distance`, or if links have joined all of it
with the code that asks. A task emits the links of a spanning forest of each group, never all
pairs; exact copies are one row before any search.

`near_groups` links by bits alone. `similar_groups` finds pairs of a likeness: its tables lead
with random masks over 128 bits, the same index searches their groups, and shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import Forest, components, dealt_parts, dropped, merged, packed, pair_of_parts, parts_of, per_slice, probably_in, stored, tidy, unpacked

SEED = 42
#: Children of a node of the in-group index.
FANOUT = 4
#: Codes that search the index at a time, and steps to children that one search may hold before it is halved.
BLOCK, STEPS = 512, 4 << 20

_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every `width`-word shingle of the ASCII-lower-cased text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    lanes = _LANES[hashes.view(np.uint8).reshape(n, 8)]  # eight 8-bit counters in each number
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    bits = sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every row's whole text; null is empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((majority(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(per_slice(work), "doc_id long, fp long")


class Layout:
    """The segments of a fingerprint and the permutations that bring some of them to the front.

    Of distance + agree segments, two fingerprints within `distance` bits agree on `agree` at
    least. More agreement means longer keys and smaller groups, for more tables.
    """

    def __init__(self, distance: int, agree: int = 2) -> None:
        n = distance + agree
        widths = [64 // n + (i < 64 % n) for i in range(n)]
        low = [64 - sum(widths[: i + 1]) for i in range(n)]
        self.parts = list(zip(low, widths, strict=True))
        fronts = list(combinations(range(n), agree))
        self.orders = [[*front, *(i for i in range(n) if i not in front)] for front in fronts]
        self.key_bits = [sum(widths[i] for i in front) for front in fronts]

    def permute(self, codes: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros_like(codes)
        for i in self.orders[table]:
            low, width = self.parts[i]
            out = (out << np.uint64(width)) | ((codes >> np.uint64(low)) & np.uint64((1 << width) - 1))
        return out

    def restore(self, codes: np.ndarray, table: int) -> np.ndarray:
        out, at = np.zeros_like(codes), 64
        for i in self.orders[table]:
            low, width = self.parts[i]
            at -= width
            out |= ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(low)
        return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order; equal leading bits stay equal leading bits."""
    for s in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(s))
    return codes


class GrayIndex:
    """A tree for each of several groups of codes: a node holds the bits that all its codes share.

    The groups stand one after another, each in Gray order; `starts` has the first place of each.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray) -> None:
        self.codes = codes
        self.compared = 0  # codes that searches looked at one by one
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # from the leaves' parents up
        ones, any_, last, bounds = codes, codes, np.arange(len(codes)), np.append(starts, len(codes))
        while not self.levels or (np.diff(bounds) > 1).any():
            parents = -(-np.diff(bounds) // FANOUT)
            before = np.cumsum(parents) - parents
            first = np.repeat(bounds[:-1], parents) + FANOUT * (np.arange(int(parents.sum())) - np.repeat(before, parents))
            end = np.append(first[1:], len(ones))
            ones, any_, last = np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(any_, first), last[end - 1]
            self.levels.append((ones | ~any_, ones, first, last))  # shared bits, their values, the first child, the last code
            bounds = np.append(before, len(first))
        self.mark(np.arange(len(codes)))

    def mark(self, label: np.ndarray) -> None:
        """Take the codes' labels: a node whose codes have one label is nothing new to a code of that label."""
        self.label, self.shared = label, []
        low = high = label
        for _, _, first, _ in self.levels:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.shared.append(np.where(low == high, low, -1))

    def later(self, asking: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of all codes j after i in its group, within `distance` bits and of another label."""
        node, who = group, np.arange(len(asking))
        seen, mask, own = np.zeros(len(asking), np.int64), np.zeros(len(asking), np.uint64), self.codes[asking]
        for depth in range(len(self.levels) - 1, -1, -1):
            shared, ones, first, last = self.levels[depth]
            bits = shared[node]
            seen = seen + np.bitwise_count((ones[node] ^ own[who]) & bits & ~mask)  # differences add up on the way down
            live = (seen <= distance) & (last[node] > asking[who]) & (self.shared[depth][node] != self.label[asking[who]])
            node, who, seen, mask = node[live], who[live], seen[live], bits[live]
            below = np.append(first[1:], len(self.levels[depth - 1][0]) if depth else len(self.codes))
            count = below[node] - first[node]
            if count.sum() > STEPS and len(asking) > 1:
                half = len(asking) // 2
                parts = [self.later(asking[x], group[x], distance) for x in (slice(half), slice(half, None))]
                return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]])
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            node, who, seen, mask = np.repeat(first[node], count) + step, np.repeat(who, count), np.repeat(seen, count), np.repeat(mask, count)
        i, j = asking[who], node
        self.compared += len(j)
        hit = (j > i) & (np.bitwise_count(self.codes[i] ^ self.codes[j]) <= distance) & (self.label[i] != self.label[j])
        return i[hit], j[hit]


def spanning_links(codes: np.ndarray, starts: np.ndarray, distance: int, also: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, index: GrayIndex | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) places of a spanning forest of the codes within `distance` bits in each group.

    `also` says which of such pairs are links. Codes ask the index block by block; what links
    have joined by then is not looked at again, so that dense clusters cost far less than all
    their pairs.
    """
    index = index or GrayIndex(codes, starts)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    label, out = np.arange(len(codes)), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    a, end = 0, 0
    while end < len(codes):
        a, end = end, min(len(codes), end + min(BLOCK, max(16, end)))  # the first blocks are small: they join most of a cluster
        i, j = index.later(np.arange(a, end), group[a:end], distance)
        if also is not None and len(i):
            keep = also(i, j)
            i, j = i[keep], j[keep]
        label, i, j = merged(label, i, j)
        if len(i):
            out.append((i, j))
            index.mark(label)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _shared_groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by keys: the places of those whose keys another row has, and the first of each group among them."""
    cuts = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in keys])))
    size = np.diff(np.append(cuts, len(keys[0])))
    places = np.flatnonzero(np.repeat(size > 1, size))
    size = size[size > 1]
    return places, np.cumsum(size) - size


def _to_ranks(layout: Layout):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for t, bits in enumerate(layout.key_bits):
                rank = gray_rank(layout.permute(fps, t))
                key = (rank >> np.uint64(64 - bits)).astype(np.int64)
                low = (rank & np.uint64((1 << (64 - bits)) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int8)), pa.array(key), pa.array(low)], names=["t", "key", "low"])

    return run


def _links(layout: Layout, distance: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_bits = np.array(layout.key_bits)
        for t, key, low in whole_groups(batches, ("t", "key"), ("t", "key", "low")):
            places, starts = _shared_groups([t, key])
            if not len(places):
                continue
            t, rank = t[places], key[places].astype(np.uint64) << (64 - key_bits[t[places]]).astype(np.uint64) | low[places].astype(np.uint64)
            codes = rank ^ (rank >> np.uint64(1))
            i, j = spanning_links(codes, starts, distance)
            for table in np.unique(t[i]):
                of = t[i] == table
                src, dst = (layout.restore(codes[x[of]], int(table)).view(np.int64) for x in (i, j))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return tidy(run)


def near_links(fps: DataFrame, distance: int = 4, agree: int = 2) -> DataFrame:
    """(src, dst) links that connect all fingerprints `fp` within `distance` bits; best given once each."""
    layout = Layout(distance, agree)
    ranks = fps.select("fp").mapInArrow(_to_ranks(layout), "t byte, key long, low long")
    ordered = ranks.repartition("t", "key").sortWithinPartitions("t", "key", "low")
    return ordered.mapInArrow(_links(layout, distance), "src long, dst long")


def near_groups(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs`.

    component_id is the smallest doc_id that links reach, the row's own included; null only if
    no row of the component has an id. Null or blank texts have fingerprint 0 and link like any
    other. Columns other than doc_id and text play no part; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, width), "simhash")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(near_links(least, distance))
    placed = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(placed.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# Near-duplicates by similarity: 128 bits find candidates, shingle sets decide

#: Bits that lead a table's permutation, tables over each half of the 128 bits, and candidates' distance.
LEAD, MASKS, WIDE_DISTANCE = 14, 48, 32
#: Documents of one group of candidates that a task verifies, as in line dedup: see `parts_of`.
SOME, MANY, PART = 200, 32, 4000


def _remixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each shingle, for 64 more bits that are independent of the first."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _node(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a sequence of shingles: equal texts (in lower case, spaces aside) have one."""
    name = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return name - ((name >> 63) << 64)


def _wide(width: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, width) for t in batch.column("text").to_pylist()]
        sets = [np.unique(h) for h in hashes]  # likeness is that of sets: repeats don't count
        columns = [
            batch.column("doc_id"),
            pa.array([_node(h) for h in hashes], pa.int64()),
            pa.array(np.fromiter((majority(h) for h in sets), np.uint64, len(sets)).view(np.int64)),
            pa.array(np.fromiter((majority(_remixed(h)) for h in sets), np.uint64, len(sets)).view(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "fp2"])

    return per_slice(work)


def _leads() -> list[list[int]]:
    """For each mask LEAD random bits, then the others: the order in which a table reads a code's bits."""
    rng = np.random.default_rng(64)
    return [rng.permutation(64).tolist() for _ in range(MASKS)]


def _spread(order: list[int]) -> np.ndarray:
    """Where each value of each byte of a code goes under a permutation of its bits."""
    out = np.zeros((8, 256), np.uint64)
    value = np.arange(256, dtype=np.uint64)
    for place, bit in enumerate(order):
        out[bit // 8] |= (value >> np.uint64(bit % 8) & np.uint64(1)) << np.uint64(63 - place)
    return out


def _to_wide_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spreads = [_spread(order) for order in _leads()]
    for batch in batches:
        halves = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "fp2")]
        octets = [h.view(np.uint8).reshape(-1, 8) for h in halves]
        for half in (0, 1):
            for m, spread in enumerate(spreads):
                code = np.zeros(batch.num_rows, np.uint64)
                for k in range(8):
                    code |= spread[k][octets[half][:, k]]
                rank = gray_rank(code)
                columns = [
                    pa.array(np.full(batch.num_rows, 2 * m + half, np.int16)),
                    pa.array((rank >> np.uint64(64 - LEAD)).astype(np.int32)),
                    pa.array((rank & np.uint64((1 << (64 - LEAD)) - 1)).astype(np.int64)),
                    pa.array(halves[1 - half]),
                    batch.column("node"),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "key", "low", "other", "node"])


def _wide_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of nodes within WIDE_DISTANCE of 128 bits, in groups that share a masked pattern.

    Of these bits at most half differ in one of the two halves: its tables' index finds the pair.
    """
    for t, key, low, other, node in whole_groups(batches, ("t", "key"), ("t", "key", "low", "other", "node")):
        places, starts = _shared_groups([t, key])
        if not len(places):
            continue
        rank = (key[places].astype(np.uint64) << np.uint64(64 - LEAD)) | low[places].astype(np.uint64)
        codes, other, node = rank ^ (rank >> np.uint64(1)), other[places].view(np.uint64), node[places]

        def near(i: np.ndarray, j: np.ndarray, codes=codes, other=other) -> np.ndarray:
            return np.bitwise_count(codes[i] ^ codes[j]) + np.bitwise_count(other[i] ^ other[j]) <= WIDE_DISTANCE

        i, j = spanning_links(codes, starts, WIDE_DISTANCE // 2, near)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["src", "dst"])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by `keys` (the first of `names`), cut so that no group is parted."""
    held: list[list[np.ndarray]] = []  # pieces of one group that may go on

    def joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*pieces, strict=True)]

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(now[0]):
            continue
        last = np.logical_and.reduce([x == x[-1] for x in now[: len(keys)]])
        end = len(last) - int(last.sum())
        if held and not end and all(h[0] == x[0] for h, x in zip(held[0][: len(keys)], now, strict=False)):
            held.append(now)
            continue
        if held or end:
            yield joined([*held, [x[:end] for x in now]])
        held = [[x[end:] for x in now]]
    if held:
        yield joined(held)


def _shingle_sets(width: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, width) for t in batch.column("text").to_pylist()]
        sets = pa.array([np.unique(h).view(np.int64) for h in hashes], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([_node(h) for h in hashes], pa.int64()), sets], names=["node", "shingles"])

    return per_slice(work)


def _verified(least: float):
    """Spanning links of the documents of each part of a group whose shingle sets are `least` alike (Jaccard)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        forest, out = Forest(), []
        sets = [np.asarray(r[3], np.int64) for r in rows]
        a, b = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in (1, 2))
        size = np.array([len(x) for x in sets])
        for i in range(1, len(rows)):
            close = np.bitwise_count(a[:i] ^ a[i]) + np.bitwise_count(b[:i] ^ b[i]) <= WIDE_DISTANCE
            close &= (np.minimum(size[:i], size[i]) >= least * np.maximum(size[:i], size[i]) - 1e-9)
            for j in np.flatnonzero(close).tolist():
                if forest.find(i) == forest.find(j):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= least * (size[i] + size[j] - both) - 1e-9:
                    forest.join(i, j)
                    out.append((rows[i][0], rows[j][0]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            lists = batch.column("shingles")
            for k, (root, part, node, fp, fp2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "part", "node", "fp", "fp2")), strict=True)):
                if (root, part) != now:
                    if len(rows) > 1:
                        yield solve(rows)
                    now, rows = (root, part), []
                rows.append((node, fp, fp2, lists[k].values.to_numpy()))
        if len(rows) > 1:
            yield solve(rows)

    return tidy(run)


def similar_groups(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row of `docs`: groups of documents at least `least` alike.

    Likeness is the Jaccard similarity of the sets of `width`-word shingles. Two 64-bit
    SimHashes of each document stand in MASKS tables each, led by LEAD random bits and sorted by
    Gray rank; documents that share a masked pattern and differ in WIDE_DISTANCE of the 128
    bits at most, in half as many of the table's own 64, are candidates, and candidates are linked only if their shingle sets are alike.
    Equal word sequences are one node from the start. component_id is the smallest doc_id
    that links reach, null only where no row of a group has an id.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_wide(width), "doc_id long, node long, fp long, fp2 long"), "wide-simhash")
    nodes = stored(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.min("doc_id").alias("holder")), "simhash-nodes")
    ranks = nodes.select("node", "fp", "fp2").mapInArrow(tidy(_to_wide_ranks), "t short, key int, low long, other long, node long")
    ordered = ranks.repartition("t", "key").sortWithinPartitions("t", "key", "low")
    roots = stored(components(ordered.mapInArrow(tidy(_wide_links), "src long, dst long")).select("node", F.col("component").alias("root")), "simhash-roots")
    some = stored(probably_in(nodes, F.col("node"), roots, F.col("node")).join(roots, "node"), "simhash-candidates")
    parts = some.groupBy("root").agg(parts_of(F.count("*"), SOME, MANY, PART).alias("parts"))
    # Shingles come from one document of each node: only those are read again.
    holders = probably_in(docs.select(F.col("doc_id").cast("long"), "text"), F.col("doc_id"), some, F.col("holder"))
    sets = probably_in(holders.mapInArrow(_shingle_sets(width), "node long, shingles array<long>"), F.col("node"), some, F.col("node"))
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    dealt = some.join(sets, "node").join(parts, "root")
    dealt = dealt.select("root", "node", "fp", "fp2", "shingles", *dealt_parts(F.col("node")))
    dealt = dealt.select("root", pair_of_parts(), "node", "fp", "fp2", "shingles").repartition("root", "part").sortWithinPartitions("root", "part", "node")
    found = components(dealt.mapInArrow(_verified(least), "src long, dst long"))
    dropped(roots, some)
    placed = nodes.select("node", "holder").join(found, "node", "left").select("node", "holder", F.coalesce("component", "node").alias("group_"))
    ids = placed.groupBy("group_").agg(F.min("holder").alias("component_id"))
    return rows.select("doc_id", "node").join(placed.join(ids, "group_").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of `docs` without near-duplicates: the smallest doc_id of each group stays (see `similar_groups`).

    Of repeated rows of that id one stays; rows without an id can't be told apart and all stay.
    """
    kept = similar_groups(docs, width, least).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    with_id = packed(docs, "doc_id").join(kept, F.col("doc_id").cast("long") == F.col("kept_id"))
    # The join has dealt and sorted the rows by this key, so that the window adds no shuffle.
    w = Window.partitionBy("kept_id").orderBy("kept_id")
    single = with_id.withColumn("copy_", F.row_number().over(w)).where("copy_ = 1").select(*unpacked(docs.columns, doc_id=F.col("doc_id")))
    return single.unionByName(docs.where(F.col("doc_id").isNull()))
