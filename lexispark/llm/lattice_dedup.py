"""Near-duplicate embeddings by lattice hashing, with cosines verified in double precision.

Each of TABLES hashes projects a unit vector onto 8 * BLOCKS random directions and decodes every
8 coordinates to the nearest point of the E8 lattice; the points together are the vector's
cell. A vector also looks into the neighbouring cells it is nearest to. Vectors of one label that
meet in a cell are compared, and the links of a spanning forest leave it. Then each component's
vectors come together and all its links are counted, those too that no cell has shown. Equal
vectors are one row from the start, and vectors travel only to cells where they meet another.
Cells and components too full for a task are compared in pairs of parts, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.common import components, merged, stored, tidy

TABLES = 6
BLOCKS = 2
PROBES = 8
#: Cells to a projected unit vector, for each root of a dimension: projections shrink with it.
SCALE = 0.375
SEED = 20
#: Vectors of one part of a cell or component, and of a block that is compared with all of two parts.
PART, BLOCK = 4096, 512


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: all of (+-1, +-1, 0...) and of halves with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1.0, -1.0), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _neighbours()


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum: round, and mend an odd sum where that costs least."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the even points and those moved by a half, the nearer."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def projections(dim: int) -> np.ndarray:
    """TABLES matrices of orthonormal directions (Gaussian ones where there are too few dimensions)."""
    rng = np.random.default_rng(SEED + dim)
    out = []
    for _ in range(TABLES):
        g = rng.normal(size=(dim, 8 * BLOCKS))
        out.append(np.linalg.qr(g)[0] if dim >= 8 * BLOCKS else g / np.sqrt(dim))
    return np.array(out)


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(rows, TABLES, 1 + PROBES) 64-bit names of each vector's own cell and of the neighbours it looks into."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.uint64)
    mix = np.random.default_rng(SEED).integers(1, 1 << 63, size=(TABLES, 8 * BLOCKS), dtype=np.uint64) | np.uint64(1)
    for t, matrix in enumerate(projections(unit.shape[1])):
        y = unit @ matrix * (SCALE * unit.shape[1] ** 0.5)
        parts = [decode(y[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)]
        own = (np.hstack(parts) * 2).astype(np.int64).astype(np.uint64)
        gain = np.hstack([(y[:, 8 * b : 8 * b + 8] - parts[b]) @ NEIGHBOURS.T for b in range(BLOCKS)])
        best = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
        base = (own * mix[t]).sum(axis=1, dtype=np.uint64)
        steps = np.concatenate([((NEIGHBOURS * 2).astype(np.int64).astype(np.uint64) * mix[t, 8 * b : 8 * b + 8]).sum(axis=1, dtype=np.uint64) for b in range(BLOCKS)])
        out[:, t, 0] = base
        out[:, t, 1:] = base[:, None] + steps[best]  # a sum of products: a step in the lattice is a step in the sum
        salt = np.uint64(t * 0x9E3779B97F4A7C15 % (1 << 64))
        out[:, t] = _stir(out[:, t] ^ _stir(label.astype(np.int64).astype(np.uint64) + salt)[:, None])
    return out


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    # Scaled by the largest component first: squares of huge or tiny ones would leave the range.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _by_dimension(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = np.asarray(pa.compute.list_value_length(batch.column("v")))
    for d in np.unique(n):
        yield batch.filter(pa.array(n == d))


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _by_dimension(whole) if whole.num_rows else ():
            found = cells(_unit(batch), batch.column("label").to_numpy())
            n, per = batch.num_rows, TABLES * (1 + PROBES)
            own = np.zeros((n, TABLES, 1 + PROBES), bool)
            own[:, :, 0] = True
            rep = np.repeat(batch.column("rep").to_numpy(), per)
            yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1).view(np.int64)), pa.array(own.reshape(-1)), pa.array(rep)], names=["cell", "own", "rep"])


def _near_blocks(batch: pa.RecordBatch, least: float, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i before j, of near vectors of one label, block by block; `apart`: only of different parts."""
    unit, label, part = _unit(batch), batch.column("label").to_numpy(), batch.column("own_part").to_numpy()
    for a in range(0, len(unit), BLOCK):
        i, j = np.nonzero(unit[a : a + BLOCK] @ unit[a:].T >= least)
        i, j = i + a, j + a
        keep = (i < j) & (label[i] == label[j])
        if apart:
            keep &= part[i] != part[j]
        yield i[keep], j[keep]


def _per_group(key: str, solve: Callable[[pa.RecordBatch, bool], pa.RecordBatch | None]) -> Callable:
    """An Arrow function that solves each pair of parts of each group: rows sorted by key, one and two, of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            pieces = [x for x in (held, batch) if x is not None]
            if not pieces:
                return
            whole = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
            keys = np.stack([whole.column(c).to_numpy() for c in (key, "one", "two")], axis=1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            ends = np.append(cuts[1:], len(keys))
            for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                if batch is not None and b == len(keys):
                    held = whole.slice(a)  # may go on in the next batch
                elif b - a > 1:
                    for part in _by_dimension(whole.slice(a, b - a)):
                        if part.num_rows > 1 and (found := solve(part, keys[a, 1] != keys[a, 2])) is not None:
                            yield found

    return tidy(run)


def _forest(least: float) -> Callable:
    """Links (src, dst) of a spanning forest of each cell's near vectors, by pairs of parts."""

    def solve(batch: pa.RecordBatch, apart: bool) -> pa.RecordBatch | None:
        rep, label, out = batch.column("rep").to_numpy(), np.arange(batch.num_rows), []
        for i, j in _near_blocks(batch, least, apart):
            label, i, j = merged(label, i, j)
            out.append((rep[i], rep[j]))
        src, dst = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"]) if len(src) else None

    return _per_group("cell", solve)


def _counts(least: float) -> Callable:
    """(rep, n): how many vectors, copies counted, each vector of a component links to, by pairs of parts."""

    def solve(batch: pa.RecordBatch, apart: bool) -> pa.RecordBatch | None:
        rep, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
        n = np.zeros(len(rep))
        for i, j in _near_blocks(batch, least, apart):
            n += np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n.astype(np.int64))], names=["rep", "n"])

    return _per_group("component", solve)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """A row (with parts) for each pair of parts that it takes part in, those of a pair together."""
    own_part = F.pmod(F.hash("rep"), F.col("parts"))
    dealt = rows.withColumn("own_part", own_part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(key, F.least("own_part", "other").alias("one"), F.greatest("own_part", "other").alias("two"), "own_part", "rep", "copies", "label", "v")
    return dealt.repartition(key, "one", "two").sortWithinPartitions(key, "one", "two", "rep")


def _usable(v: Column, label: Column) -> Column:
    """Vectors with something to compare: a label, finite components only, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & label.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def near_groups(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding, label).

    Rows that are null, all zero, hold null or non-finite components, or have no label link with
    nothing and are their own component; so do vectors of different lengths with each other.
    Repeated ids are separate rows and answer alike. Labels that aren't whole numbers count by a
    64-bit hash. Other columns play no part; an empty table gives no rows.
    """
    whole = isinstance(vectors.schema["label"].dataType, T.IntegralType)
    v, label = F.col("embedding").cast("array<double>"), F.col("label").cast("long")
    if not whole:
        label = F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v"), label.alias("label"))
    good = rows.where(_usable(F.col("v"), F.col("label")) & F.col("vec_id").isNotNull())
    reps = stored(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    named = stored(reps.select("rep", "v", "label").mapInArrow(_to_cells, "cell long, own boolean, rep long"), "lattice-cells")
    full = named.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 and owners > 0")
    full = full.select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    met = named.join(full, "cell").select("cell", "rep", "parts").distinct()
    links = _dealt(met.join(reps, "rep"), "cell").mapInArrow(_forest(least), "src long, dst long")
    joined = stored(components(links).select(F.col("node").alias("rep"), "component"), "lattice-components")
    parts = joined.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = joined.join(parts, "component").join(reps, "rep")
    counted = _dealt(members, "component").mapInArrow(_counts(least), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("others"))
    answers = reps.join(counted, "rep", "left").join(joined, "rep", "left")
    answers = answers.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    placed = good.join(answers, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(_usable(F.col("v"), F.col("label")) & F.col("vec_id").isNotNull(), F.lit(False)))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = placed.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle(least: float = 0.93) -> str:
    """DuckDB SQL for `near_groups(embeddings)`: cosines of all pairs of a label, and what they reach."""
    return f"""
with recursive v as (select row_number() over () as rid, vec_id, label, embedding::double[] as e from embeddings),
good as (select * from v where vec_id is not null and label is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as materialized (select a.rid as a, b.rid as b from good a join good b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= {least}),
reach as (select rid, rid as to_rid from v union select rid, b from reach join links on a = to_rid),
n as (select a as rid, count(*)::bigint as n from links group by a),
c as (select reach.rid, min(v.vec_id) as component_id from reach join v on v.rid = to_rid group by reach.rid)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept
from v join c using (rid) left join n using (rid)"""
