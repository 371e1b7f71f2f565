"""The document index as a log of segments: a commit writes what its batch holds, and no more.

A segment is one batch of jobs as Parquet: the last job of each url, upserts under op=upsert, deletes (the url alone) under
op=delete. A manifest names the segments in order, and a reader sees those of the newest manifest: a document is current
unless a later segment names its url. Segments never change; small neighbours are merged into one, so that there are
never more than `most`, and a document is rewritten a number of times that grows with the logarithm of the index.

A manifest becomes visible by a rename that fails where its version is taken, so of two writers that took the same
version one takes the next. A batch that comes again is known by the number that the manifest keeps for its stream.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarn.functions.urls import index_host
from tarn.operators.index import last_of_each
from tarn.schemas import DOCUMENT

#: Segments that a reader has to look through, at most.
MOST = 8
#: A neighbour is merged with while it is at most this many times as large as what is merged already.
GROWTH = 2


@dataclass
class Segment:
    name: str
    version: int
    bytes: int
    jobs: int


@dataclass
class Manifest:
    """version 0 is the empty index. batches: the last batch of each stream that has committed."""

    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    segments: list[Segment] = field(default_factory=list)
    jobs: int = 0

    @staticmethod
    def of(text: str) -> Manifest:
        raw = json.loads(text)
        return Manifest(raw["version"], raw["batches"], [Segment(**s) for s in raw["segments"]], raw["jobs"])


class SegmentStore:
    """Reads and commits of the index at `root`, a folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, most: int = MOST):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    # ---------------------------------------------------------------- manifests

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that have a manifest, in order."""
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version."""
        if version is None:
            known = self.versions()
            if not known:
                return Manifest()
            version = known[-1]
        return Manifest.of(self.spark.read.text(f"{self.root}/manifests/v{version:012}.json", wholetext=True).first()[0])

    def _publish(self, manifest: Manifest) -> bool:
        """Whether the manifest became that of its version; false if the version was taken."""
        jvm, fs = self.spark._jvm, self._fs()
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"manifests/v{manifest.version:012}.json")
        fs.mkdirs(final.getParent())
        out = fs.create(draft)
        out.write(json.dumps(asdict(manifest)).encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True

    # ---------------------------------------------------------------- reading

    def _segment(self, segment: Segment) -> DataFrame:
        rows = self.spark.read.schema("collection string, url string, host string, title string, body string, indexed_at long, op string").option("basePath", f"{self.root}/segments/{segment.name}").parquet(f"{self.root}/segments/{segment.name}")
        return rows.withColumn("version", F.lit(segment.version).cast("long"))

    def _current(self, segments: list[Segment], later: list[Segment] = []) -> DataFrame:  # noqa: B006
        """Rows of the segments whose url no later segment, among them or after them, names."""
        every = reduce(DataFrame.unionByName, [self._segment(s) for s in segments])
        keys = [self._segment(s).select(F.col("url").alias("_url"), F.col("version").alias("_version")) for s in [*segments[1:], *later]]
        if not keys:
            return every
        last = reduce(DataFrame.unionByName, keys).groupBy("_url").agg(F.max("_version").alias("_version"))
        return every.join(last, (F.col("url") == F.col("_url")) & (F.col("version") < F.col("_version")), "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of the newest version, or of an earlier one whose segments are still there."""
        segments = self.manifest(version).segments
        if not segments:
            return self.spark.createDataFrame([], DOCUMENT)
        return self._current(segments).filter("op = 'upsert'").select(*DOCUMENT.names)

    def rows(self) -> DataFrame:
        """All rows of all segments of the newest version, with op and version: what commits wrote."""
        rows = [self._segment(s) for s in self.manifest().segments]
        return reduce(DataFrame.unionByName, rows)

    def size_bytes(self) -> int:
        """Bytes of the newest version's files, as counted when they were written."""
        return sum(s.bytes for s in self.manifest().segments)

    # ---------------------------------------------------------------- writing

    def _write(self, rows: DataFrame, name: str) -> int:
        """The bytes of a new segment."""
        rows.select(*DOCUMENT.names, "op").write.partitionBy("op").parquet(f"{self.root}/segments/{name}")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/segments/{name}")
        return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def commit(self, jobs: DataFrame, stream: str = "jobs", batch: int | None = None) -> Manifest:
        """One batch of jobs (op, document columns, seq) made durable and visible at once; a batch seen before is skipped.

        The segment holds the last job of each url. Its version is the manifest's, so a writer that loses a race only
        writes its manifest again.
        """
        if batch is not None and batch <= self.manifest().batches.get(stream, -1):
            return self.manifest()
        deleted = F.col("op") == "delete"
        seen = Observation()
        latest = last_of_each(jobs.observe(seen, F.count("*").alias("jobs")).select("op", "collection", "url", "title", "body", "indexed_at", "seq"), ["url"]).withColumn("host", index_host("url"))
        latest = latest.select("op", "url", *[F.when(~deleted, F.col(c)).alias(c) for c in DOCUMENT.names if c != "url"])
        name = uuid.uuid4().hex
        size = self._write(latest, name)
        count = seen.get["jobs"]
        while True:
            now = self.manifest()
            if batch is not None and batch <= now.batches.get(stream, -1):
                return now
            batches = now.batches | ({stream: batch} if batch is not None else {})
            new = Manifest(now.version + 1, batches, [*now.segments, Segment(name, now.version + 1, size, count)], now.jobs + count)
            if self._publish(new):
                return self.compact(new)

    def _run(self, segments: list[Segment]) -> int:
        """Where the newest segments begin that should be one."""
        at, size = len(segments) - 1, segments[-1].bytes
        while at > 0 and (segments[at - 1].bytes <= GROWTH * size or at >= self.most):
            at -= 1
            size += segments[at].bytes
        return at

    def compact(self, manifest: Manifest) -> Manifest:
        """The manifest after merging neighbours, once there are `most` segments; what a commit elsewhere added stays."""
        if len(manifest.segments) < self.most:
            return manifest
        at = self._run(manifest.segments)
        old = manifest.segments[at:]
        if len(old) < 2:
            return manifest
        rows = self._current(old)
        if at == 0:  # nothing older is left for a deletion to hide
            rows = rows.filter("op = 'upsert'")
        name = uuid.uuid4().hex
        merged = Segment(name, old[-1].version, self._write(rows, name), sum(s.jobs for s in old))
        while True:
            now = self.manifest()
            names = [s.name for s in now.segments]
            if not {s.name for s in old} <= set(names):
                return now  # another writer merged some of them
            first = names.index(old[0].name)
            new = Manifest(now.version + 1, now.batches, [*now.segments[:first], merged, *now.segments[first + len(old) :]], now.jobs)
            if self._publish(new):
                return new

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but for the `keep` newest, and segments that those don't name; how many segments went.

        For a time without writers: a segment whose manifest isn't written yet would look like one that none names.
        """
        fs, known = self._fs(), self.versions()
        named = {s.name for v in known[-keep:] for s in self.manifest(v).segments}
        for v in known[:-keep]:
            fs.delete(self._path(f"manifests/v{v:012}.json"), False)
        gone = [s.getPath() for s in fs.listStatus(self._path("segments")) if s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
