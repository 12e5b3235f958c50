"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources.shared import shared_folder

#: Bytes of text that one step of an Arrow function holds as Python objects at a time.
SLICE_BYTES = 2 << 20


#: Spark's setting by which an action deletes its shuffles when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Actions inside delete their shuffles when they end: for those whose result is stored."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with _shuffles_go(df.sparkSession):  # a table has the setting of when it was made
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; for tables too wide for `cut`."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that `stored` gave, once nothing reads them again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, *parts: str) -> DataFrame:
    """The columns `parts`, and all others in a struct `row_`: names inside it clash with no operator's own."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in parts]
    return df.select(*parts, (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("row_"))


def unpacked(columns: list[str], **parts: Column) -> list[Column]:
    """The columns of the table that `packed` took, in their order; `parts` are those kept outside the struct."""
    return [parts[c].alias(c) if c in parts else F.col("row_")[c].alias(c) for c in columns]


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a key's MD5; plain SQL can repeat it."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def in_training(doc_id: Column) -> Column:
    """Labels may be learnt from these rows only; the rest is held out."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most `per_class` training rows of each class.

    The rows are those with the smallest hash of the id, so the sample is the same on every
    run; its bound makes the broadcast and the model's input independent of the corpus.
    Rows without an id or label teach nothing; an id with several labels counts by the largest,
    one with several texts by the least of them, so that repeated ids don't swell the sample.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & in_training(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_class rows of two numbers: a proven bound.
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def gathered(sample: DataFrame, values: str) -> tuple[list[np.ndarray], list[int]]:
    """(arrays, labels) of a bounded sample (doc_id string, label int, an array column), by doc_id.

    Values stay in Arrow's buffers all the way: as Python objects they'd take ten times as much.
    """
    table = sample.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    lists = table.column(values).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(table):
        return [], []
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], table.column("label").to_pylist()


def slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of about `limit` bytes each, one row at least."""
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        if i > start and held + (n or 0) > limit:
            yield start, i
            start, held = i, 0
        held += n or 0
    if start < len(column):
        yield start, len(column)


def give_back() -> None:
    """Return a task's freed memory to the machine: workers are used again and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """An Arrow function that gives memory back when its partition is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def per_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> Callable:
    """An Arrow function that applies `work` to slices of every batch, bounded by text bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text)):
                yield work(batch.slice(a, b - a))

    return tidy(run)


#: Bits of a bitmap of keys: its table has a row for each 64 of them at most, whatever the corpus.
BITMAP = 1 << 24


def _bit(key: Column) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP))
    return F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def _bitmap(keys: DataFrame, key: Column) -> DataFrame:
    word, bit = _bit(key)
    return keys.select(word.alias("word_"), bit.alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))


def probably_in(df: DataFrame, key: Column, keys: DataFrame, other: Column) -> DataFrame:
    """The rows of `df` whose key may be among `keys`: all that are, few others.

    A filter before an exact join, to keep wide rows out of its shuffle. The broadcast bitmap
    has BITMAP / 64 rows at most; when keys fill it, the filter passes more rows, never fewer.
    """
    bits = _bitmap(keys, other)
    word, bit = _bit(key)
    return df.join(F.broadcast(bits), word == bits["word_"]).where(F.col("bits_").bitwiseAND(bit) != 0).select(*df.columns)


def surely_out(df: DataFrame, key: Column, keys: DataFrame, other: Column) -> DataFrame:
    """The rows of `df` that `probably_in` leaves: none of them has a key among `keys`."""
    bits = _bitmap(keys, other)
    word, bit = _bit(key)
    out = df.join(F.broadcast(bits), word == bits["word_"], "left")
    return out.where(F.col("bits_").isNull() | (F.col("bits_").bitwiseAND(bit) == 0)).select(*df.columns)


def parts_of(n: Column, some: int, many: int, most: int) -> Column:
    """Parts of a group of n rows: of `some` rows up to `many` parts, then as few as `most` rows allow."""
    return F.greatest(F.least(F.ceil(n / some), F.lit(many)), F.ceil(n / most)).cast("int")


def dealt_parts(key: Column) -> list[Column]:
    """A row for each pair of parts that a row of a group with `parts` parts takes part in."""
    own = F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("own")
    return ["parts", own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")]


def pair_of_parts() -> Column:
    """One number for a pair of parts; for a group of one part that is the group itself."""
    return (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("part")


class Forest:
    """Union-find over hashable keys; `join` says whether it linked two separate trees."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels after the links i-j, and those of the links that joined two groups, i and j).

    A group's label is the place of its first member. The links taken are a forest.
    """
    some, other = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(i := i[apart := label[i] != label[j]]):
        j = j[apart]
        high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
        order = np.lexsort((low, high))  # each group joins the first one that it has a link to
        order = order[np.append(True, np.diff(high[order]) > 0)]
        some.append(i[order])
        other.append(j[order])
        up = np.arange(len(label))
        up[high[order]] = low[order]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return label, np.concatenate(some), np.concatenate(other)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Alternating large-star and small-star rounds: each is two aggregations and joins over the
    links, whose number never grows, and depth falls geometrically. Lineage is cut every
    round. `edges` has two long columns src and dst, neither null.
    """
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = cut(now)
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
