"""An index as Parquet tables: segments, tombstones and versioned manifests.

A folder holds segments (documents with their term frequencies, postings by term, term and
corpus statistics), tombstones and manifests. Files are never changed: each operation writes
new ones and then the next manifest, which names what is live, so that readers see one version
or the next. Postings are range-partitioned and sorted by term, so a query's terms prune files
and row groups.

A tombstone names the segment of each document that it hides, with what the document added to
the statistics there. So a key that comes again, in a later segment, is live, and statistics of
live documents are those of the segments less those of the tombstones: no posting is counted anew.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.build import IndexTables, build, from_vectors, postings_of, stats_of, terms_of, union
from lexispark.plans.spec import IndexSpec


@dataclass(frozen=True)
class Segment:
    """A folder of tables; `level` says how many joinings its documents have been through."""

    name: str
    level: int = 0


@dataclass(frozen=True)
class Tombstone:
    """A folder of hidden documents, and the segments that hold them."""

    name: str
    segments: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    spec: IndexSpec
    segments: tuple[Segment, ...]
    tombstones: tuple[Tombstone, ...] = ()

    def folders(self) -> set[str]:
        return {x.name for x in (*self.segments, *self.tombstones)}

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Manifest:
        x = json.loads(text)
        spec = IndexSpec(**x["spec"] | {"partition_by": tuple(x["spec"]["partition_by"])})
        tombstones = tuple(Tombstone(t["name"], tuple(t["segments"])) for t in x["tombstones"])
        return cls(x["version"], spec, tuple(Segment(**s) for s in x["segments"]), tombstones)


class Conflict(RuntimeError):
    """Another writer published this version first; the operation may be tried again."""


class IndexStore:
    """One index in a folder; every method reads the newest manifest first."""

    #: Segments of a level that make one of the next.
    fan_in = 8

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Manifests: small files, read and written by the driver through Hadoop's file systems

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return folder, folder.getFileSystem(conf)

    def _versions(self) -> list[str]:
        folder, fs = self._fs()
        if not fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(folder))
        return sorted(x for x in names if x.endswith(".json") and not x.startswith("."))

    def _read(self, name: str) -> Manifest:
        folder, fs = self._fs()
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, name))
        try:
            return Manifest.of(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        names = self._versions()
        if not names:
            raise ValueError(f'index "{self.path}" does not exist')
        return self._read(names[-1])

    def _publish(self, m: Manifest) -> Manifest:
        """Write the manifest beside the others and rename it: of two writers of a version the second fails."""
        jvm, (folder, fs) = self.spark._jvm, self._fs()
        fs.mkdirs(folder)
        new, name = (jvm.org.apache.hadoop.fs.Path(folder, x) for x in (f".new-{uuid.uuid4().hex}", f"{m.version:08d}.json"))
        out = fs.create(new, False)
        try:
            out.write(bytearray(m.text().encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(name), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {m.version} of {self.path} exists already") from e
            raise
        return m

    def _next(self, m: Manifest, **changes) -> Manifest:
        """The next version; tombstones hide nothing in segments that have gone, and go with the last of these."""
        new = replace(m, version=m.version + 1, **changes)
        names = {s.name for s in new.segments}
        left = tuple(Tombstone(t.name, tuple(s for s in t.segments if s in names)) for t in new.tombstones)
        return self._publish(replace(new, tombstones=tuple(t for t in left if t.segments)))

    # Files

    def _write_segment(self, tables: IndexTables, level: int = 0) -> Segment:
        name = f"segments/{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        tables.vectors.write.parquet(f"{at}/vectors")  # texts are split here, once; all else reads what was written
        tables = from_vectors(tables.spec, self.spark.read.schema(tables.vectors.schema).parquet(f"{at}/vectors"))
        # By term, then document: a term of very many documents is split over files.
        ordered = tables.postings.repartitionByRange(parts, "part", "term", "doc_key").sortWithinPartitions("part", "term", "doc_key")
        ordered.write.parquet(f"{at}/postings")
        tables.docs.write.parquet(f"{at}/docs")
        postings, docs = self.spark.read.parquet(f"{at}/postings"), self.spark.read.parquet(f"{at}/docs")
        terms_of(postings).repartitionByRange(parts, "part", "term").sortWithinPartitions("part", "term").write.parquet(f"{at}/terms")
        stats_of(docs).coalesce(1).write.parquet(f"{at}/stats")
        return Segment(name, level)

    def _write_tombstone(self, m: Manifest, keys: DataFrame) -> Tombstone | None:
        """Hide the live documents of the given keys (doc_key), each in its segment."""
        keys, at = keys.select("doc_key").distinct(), f"tombstones/{uuid.uuid4().hex}"
        found = [self._live_vectors(m, s).join(keys, "doc_key", "left_semi").select(F.lit(s.name).alias("segment"), "part", "doc_key", "len", "norm", "entries") for s in m.segments]
        reduce(DataFrame.unionByName, found).write.parquet(f"{self.path}/{at}/vectors")
        gone = self.spark.read.schema(found[0].schema).parquet(f"{self.path}/{at}/vectors")
        gone.select("segment", "doc_key").write.parquet(f"{self.path}/{at}/docs")
        terms = postings_of(gone, "segment").groupBy("segment", "part", "term").agg(F.count("*").alias("df"))
        terms.sortWithinPartitions("part", "term").write.parquet(f"{self.path}/{at}/terms")
        gone.groupBy("segment", "part").agg(F.count("*").alias("n_docs"), F.sum("len").cast("long").alias("total_len")).write.parquet(f"{self.path}/{at}/stats")
        touched = self.spark.read.parquet(f"{self.path}/{at}/stats").select("segment").distinct().collect()  # as many as segments
        return Tombstone(at, tuple(sorted(r.segment for r in touched))) if touched else None

    # Operations

    @classmethod
    def create(cls, spark: SparkSession, path: str, df: DataFrame, spec: IndexSpec) -> IndexStore:
        """Build the first segment; fails if the folder has an index already."""
        store = cls(spark, path)
        if store._versions():
            raise ValueError(f'index "{path}" already exists')
        store._publish(Manifest(1, spec, (store._write_segment(build(df, spec)),)))
        return store

    def append(self, df: DataFrame) -> Manifest:
        """Add rows as a new segment; rows that aren't documents are left out. A full level becomes one segment of the next."""
        m = self.manifest()
        return self._compact(self._next(m, segments=(*m.segments, self._write_segment(build(df, m.spec)))))

    def delete(self, keys: DataFrame) -> Manifest:
        """Mark documents (doc_key) as deleted; statistics count live documents at once. Later rows of a key are live."""
        m = self.manifest()
        new = self._write_tombstone(m, keys)
        return self._next(m, tombstones=(*m.tombstones, new)) if new else m

    def update(self, df: DataFrame) -> Manifest:
        """Replace documents by key, in one version: a tombstone for the old rows and a segment of the new ones."""
        m = self.manifest()
        gone = self._write_tombstone(m, df.select(F.col(m.spec.key).alias("doc_key")))
        tombstones = (*m.tombstones, gone) if gone else m.tombstones
        return self._compact(self._next(m, segments=(*m.segments, self._write_segment(build(df, m.spec))), tombstones=tombstones))

    def _compact(self, m: Manifest) -> Manifest:
        """Join levels that are full, from the lowest up: a document is written once for each level at most."""
        while full := sorted(level for level, n in Counter(s.level for s in m.segments).items() if n >= self.fan_in):
            m = self._join(m, tuple(s for s in m.segments if s.level == full[0]), full[0] + 1)
        return m

    def _join(self, m: Manifest, some: tuple[Segment, ...], level: int) -> Manifest:
        """One segment of the live documents of several."""
        vectors = reduce(DataFrame.unionByName, [self._live_vectors(m, s) for s in some])
        joined = self._write_segment(from_vectors(m.spec, vectors), level)
        return self._next(m, segments=(*(s for s in m.segments if s not in some), joined))

    def flush(self) -> Manifest:
        """Join the segments of the lowest level, however few, into one of the next."""
        m = self.manifest()
        low = min(s.level for s in m.segments)
        some = tuple(s for s in m.segments if s.level == low)
        return self._compact(self._join(m, some, low + 1)) if len(some) > 1 else m

    def optimize(self) -> Manifest:
        """One segment of the live documents, no tombstones."""
        m = self.manifest()
        if len(m.segments) < 2 and not m.tombstones:
            return m
        return self._join(m, m.segments, max(s.level for s in m.segments))

    # Reading

    def _tombstones(self, m: Manifest, of: str, segments: set[str]) -> DataFrame | None:
        """One table of all tombstones that touch some of the segments; rows of others are left out."""
        names = [t.name for t in m.tombstones if segments & set(t.segments)]
        rows = self.spark.read.parquet(*(f"{self.path}/{x}/{of}" for x in names)) if names else None
        return None if rows is None else rows.where(F.col("segment").isin(sorted(segments)))

    def _less_dead(self, m: Manifest, rows: DataFrame, segment: str) -> DataFrame:
        dead = self._tombstones(m, "docs", {segment})
        return rows if dead is None else rows.join(dead.select("doc_key"), "doc_key", "left_anti").select(*rows.columns)

    def _live_vectors(self, m: Manifest, segment: Segment) -> DataFrame:
        return self._less_dead(m, self.spark.read.parquet(f"{self.path}/{segment.name}/vectors"), segment.name)

    def _segment(self, m: Manifest, name: str) -> IndexTables:
        at = f"{self.path}/{name}"
        return IndexTables(m.spec, *(self.spark.read.parquet(f"{at}/{t}") for t in ("docs", "postings", "terms", "stats", "vectors")))

    def _live(self, m: Manifest) -> IndexTables:
        """All segments less what tombstones hide; bounds of terms stay those of the segments, so that none is too low."""
        parts = []
        for s in m.segments:
            tables = self._segment(m, s.name)
            parts.append(replace(tables, docs=self._less_dead(m, tables.docs, s.name), postings=self._less_dead(m, tables.postings, s.name), vectors=self._live_vectors(m, s)))
        whole = union(*parts) if len(parts) > 1 else parts[0]
        names = {s.name for s in m.segments}
        gone = self._tombstones(m, "terms", names)
        if gone is None:
            return whole
        minus = gone.select("part", "term", (-F.col("df")).alias("df"))
        terms = whole.terms.unionByName(minus, allowMissingColumns=True).groupBy("part", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_norm").alias("min_norm"))
        less = self._tombstones(m, "stats", names).select("part", (-F.col("n_docs")).alias("n_docs"), (-F.col("total_len")).alias("total_len"))
        stats = whole.stats.unionByName(less).groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").cast("long").alias("total_len"))
        return replace(whole, terms=terms.where("df > 0"), stats=stats.where("n_docs > 0"))

    def tables(self) -> IndexTables:
        return self._live(self.manifest())

    def summarize(self) -> DataFrame:
        """(item, value): version, parameters, segments and the statistics of live documents."""
        m = self.manifest()
        whole = self._live(m)
        stats = whole.stats.agg(F.sum("n_docs").alias("n"), F.sum("total_len").alias("len")).first()
        terms = whole.terms.select("term").distinct().count()
        items = {
            "name": m.spec.name, "text_config": m.spec.text_config, "k1": m.spec.k1, "b": m.spec.b, "version": m.version,
            "segments": len(m.segments), "tombstones": len(m.tombstones), "total_docs": stats.n or 0, "total_len": stats.len or 0,
            "avg_len": round((stats.len or 0) / stats.n, 4) if stats.n else 0.0, "terms": terms,
        }
        return self.spark.createDataFrame([(k, str(v)) for k, v in items.items()], "item string, value string")

    def dump(self) -> DataFrame:
        """(segment, level, live, part, term, doc_key, tf, norm): every posting of every live segment, hidden ones marked."""
        m = self.manifest()
        out = []
        for s in m.segments:
            rows = self._segment(m, s.name).postings
            dead = self._tombstones(m, "docs", {s.name})
            live = F.lit(True)
            if dead is not None:
                rows = rows.join(dead.select("doc_key", F.lit(True).alias("hidden")), "doc_key", "left")
                live = F.col("hidden").isNull()
            out.append(rows.select(F.lit(s.name).alias("segment"), F.lit(s.level).alias("level"), live.alias("live"), "part", "term", "doc_key", "tf", "norm"))
        return reduce(DataFrame.unionByName, out)

    def _pending(self) -> list[str]:
        names = self._versions()
        old = set().union(*(self._read(x).folders() for x in names[:-1])) if names else set()
        return sorted(old - self.manifest().folders())

    def pending_files(self) -> DataFrame:
        """(folder) of segments and tombstones that no longer belong to the newest version."""
        return self.spark.createDataFrame([(x,) for x in self._pending()], "folder string")

    def vacuum(self) -> int:
        """Delete the folders and manifests of earlier versions; returns how many folders went. Readers of those versions must be done.

        Deletion goes through Hadoop's file systems, so any path that Spark writes will do. The
        number of folders follows the versions, not the data.
        """
        jvm, (manifests, fs) = self.spark._jvm, self._fs()
        old, gone = self._versions()[:-1], 0
        for folder in self._pending():
            gone += fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"), True)
        for name in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(manifests, name), False)
        return gone
