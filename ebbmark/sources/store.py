"""A log's files: inserts in Parquet folders, deletes and everything else in a manifest that is swapped whole.

A manifest is never changed: each commit writes a new one under the next number, and a snapshot keeps the one that it
began with. Folders that no manifest in use names are removed by vacuum alone.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Milliseconds after which a claim whose writer wrote no manifest is void.
STALE = 120_000


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local session gets a temporary one; on a cluster, where each machine has its own disk, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ebbmark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@dataclass(frozen=True)
class Manifest:
    """Sizes are what counts and the choice of a compaction's inputs are made from: one entry for each folder of appended rows and each window, never for rows."""

    version: int = 0
    seq: int = 0
    next_rid: int = 0
    deltas: tuple[str, ...] = ()  # folders of appended rows, in order
    windows: tuple[tuple, ...] = ()  # of folders of compacted rows, partitioned by window_id: (folder, whether all its windows are in use, (window_id, rows, first ts, last ts) of those that are)
    sizes: tuple[tuple, ...] = ()  # of each of deltas: (rows, first ts, last ts, bytes)
    deletes: tuple[tuple[int, int, int | None], ...] = ()  # (seq, t1, t2) that compaction has not used up
    window: int = 0  # of the grid that the compacted rows are in; fixed by the first compaction
    adaptive: tuple[float | None, int, int, int] = (None, 0, 0, 0)  # density, flushes, the last one that updated it, failures


def _tuples(value):
    return tuple(map(_tuples, value)) if isinstance(value, list) else value


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))

    def load(self) -> Manifest:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        numbers = [int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))]
        if not numbers:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.path}/manifests/{max(numbers):012}.json"))
        try:
            raw = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Manifest(**{k: _tuples(v) for k, v in raw.items()})

    def commit(self, manifest: Manifest) -> None:
        """Refuses a number that another writer took. A writer claims the number by creating a file, which only one can; a claim without a manifest is void after STALE milliseconds. The manifest then appears whole, by a rename."""
        folder, number = f"{self.path}/manifests", f"{manifest.version:012}"
        final, claim, new = (self._path(f"{folder}/{name}") for name in (f"{number}.json", f"{number}.claim", f".{number}.{uuid.uuid4().hex}"))
        if self._fs.exists(claim) and not self._fs.exists(final) and time.time() * 1000 - self._fs.getFileStatus(claim).getModificationTime() > STALE:
            self._fs.delete(claim, False)
        if self._fs.exists(final) or not self._claimed(claim):
            raise FileExistsError(f"manifest {manifest.version} was written by someone else")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        if not self._fs.rename(new, final):
            raise FileExistsError(f"manifest {manifest.version} was written by someone else")
        self._fs.delete(claim, False)

    def _claimed(self, claim) -> bool:
        try:
            return self._fs.createNewFile(claim)
        except Py4JJavaError:  # some file systems raise where others say no
            return False

    def write(self, rows: DataFrame, name: str, by: str | None = None) -> str:
        """Writes a folder that no other writer can have: its name ends in a number of its own. What was committed is never overwritten."""
        name = f"{name}-{uuid.uuid4().hex[:16]}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        return name

    def size(self, name: str) -> int:
        """Bytes of a folder."""
        return self._fs.getContentSummary(self._path(f"{self.path}/{name}")).getLength()

    def folder(self, entry: tuple) -> DataFrame:
        """Rows of the windows that are in use of a folder of compacted rows; window_id is a partition column, so filters on it prune folders."""
        name, whole, windows = entry
        rows = self.spark.read.schema(f"{self.schema}, window_id BIGINT").parquet(f"{self.path}/{name}")
        return rows if whole else rows.filter(F.col("window_id").isin([w[0] for w in windows]))

    def read(self, manifest: Manifest) -> DataFrame:
        """All inserts: seq, ts, rid and the payload's columns."""
        empty = self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{d}" for d in manifest.deltas])] if manifest.deltas else []
        parts += [self.folder(entry) for entry in manifest.windows]
        return reduce(DataFrame.unionAll, [p.select(*empty.columns) for p in parts]) if parts else empty

    def read_windows(self, manifest: Manifest) -> DataFrame | None:
        """Compacted rows with their window_id."""
        parts = [self.folder(entry) for entry in manifest.windows]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def vacuum(self, keep: list[Manifest]) -> list[str]:
        """Removes data folders that none of the manifests names; their names."""
        used = {name for m in keep for name in (*m.deltas, *(entry[0] for entry in m.windows))}
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory() and s.getPath().getName() != "manifests" and s.getPath().getName() not in used]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone
