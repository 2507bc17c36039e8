"""Sharded storage with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable shard files. Shards of similar size
form a tier (sizes within a factor FANOUT); a tier with enough shards is merged
to files of the target size. A version of the store is a manifest, a table of
live shards. It becomes current when a commit file with the next number appears:
the file is written aside and moved to its name whole, which the file system
grants to one writer only. A writer commits the successor of the version that
its manifest was built on, or nothing. Writers register before they write, so
``vacuum`` leaves what they have not committed yet. Readers of an older version
keep their files until ``vacuum``.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

#: Production parameters: bytes of a merged file, rows of an arriving shard, size ratio between tiers, shards that make a tier worth merging.
TARGET_BYTES = 128 << 20
SHARD_ROWS = 2000
FANOUT = 4
MIN_MERGE = 4
#: Files up to this size are in tier 0.
FLOOR_BYTES = 64 << 10
CODEC = "zstd"
#: Seconds after which a registered writer counts as lost: its files may go, and it can't commit any more.
LEASE = 24 * 3600.0

_MANIFEST = "path string, bytes bigint, rows bigint, tier int, added bigint"


class CommitConflict(RuntimeError):
    """Another writer made the same version first; read the store again and repeat."""


class ShardStore:
    """A versioned table of immutable Parquet shards under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._me = spark, root.rstrip("/"), ""

    def _list(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds since the last change) of what lies in a folder."""
        at, fs = common._fs(self.spark, f"{self.root}/{folder}")
        found = fs.listStatus(at) if fs.exists(at) else []
        return [(x.getPath().getName(), time.time() - x.getModificationTime() / 1000) for x in found]

    def version(self) -> int:
        """The current version; 0 is the empty store."""
        return max((int(name) for name, _ in self._list("commits") if name.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, tier, added): the live shards of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], _MANIFEST)
        name = self._read_text(f"{self.root}/commits/{version:012d}")
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The rows of a version. Shard paths come to the driver, as they do for any file listing; rows do not."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def append(self, df: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """Write ``df`` as small shards, each task its own, and commit them; no shuffle. Returns the version.

        Arrivals may add columns or leave some out; a type that conflicts with
        the store's raises TypeError, and nothing is written.
        """
        begun = self.version()
        stored = self._schema(self.manifest(begun))
        if stored:
            _union(stored, df.schema)
        with self._writer() as write:
            data = write(df.write.option("maxRecordsPerFile", shard_rows))
            return self._commit(begun, self.manifest(begun).unionByName(self._shards(data, begun + 1)))

    def tiers(self, target: int = TARGET_BYTES, min_merge: int = MIN_MERGE) -> DataFrame:
        """(tier, shards, bytes) of the tiers that a compaction would merge; files of half the target or more are finished."""
        live = self.manifest().where(F.col("bytes") * 2 < target)
        return live.groupBy("tier").agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes")).where(F.col("shards") >= min_merge)

    def compact(self, target: int = TARGET_BYTES, min_merge: int = MIN_MERGE) -> int:
        """Merge the shards of each full tier to files of about ``target`` bytes and commit; returns the version.

        A scan packs whole files, largest first, into partitions of the target
        size, so each task reads one run of similar shards and writes one file:
        no shuffle. A merged file has all columns of its shards. Without a full
        tier the version stays.
        """
        begun = self.version()
        # tiers are logarithms of sizes: a handful of rows
        full = [r["tier"] for r in self.tiers(target, min_merge).collect()]
        if not full:
            return begun
        live = self.manifest(begun)
        merging = F.col("tier").isin(full) & (F.col("bytes") * 2 < target)
        after = live.where(~merging)
        packed = _packed_session(self.spark, target)
        with self._writer() as write:
            for tier in sorted(full):
                shards = live.where(merging & (F.col("tier") == tier))
                # a scan names its files, so their paths come to the driver, as in any file listing
                paths = [r["path"] for r in shards.select("path").orderBy("path").collect()]
                data = write(packed.read.schema(self._schema(shards)).parquet(*paths).write)
                after = after.unionByName(self._shards(data, begun + 1))
            return self._commit(begun, after)

    def vacuum(self, lease: float = LEASE) -> int:
        """Delete data folders that no live shard of the current version is in and no writer holds; returns how many went.

        A writer's folders are safe until it has been registered for ``lease``
        seconds; then its registration is deleted first, so that it can't commit.
        """
        # in this order: a folder that is neither held nor live when these are listed was given up before
        data = [name for name, _ in self._list("data")]
        held = set()
        for name, age in self._list("writers"):
            if age > lease:
                common.remove(self.spark, f"{self.root}/writers/{name}")
            else:
                held.add(name)
        live = {r["folder"] for r in self.manifest().select(_folder().alias("folder")).distinct().collect()}
        gone = [name for name in data if name not in live and name.split("-")[0] not in held]
        for name in gone:
            common.remove(self.spark, f"{self.root}/data/{name}")
        return len(gone)

    @contextmanager
    def _writer(self) -> Iterator:
        """Register a writer; yields a function that writes a frame to a data folder of its own and returns the path."""
        me, n = uuid.uuid4().hex, 0
        at, fs = common._fs(self.spark, f"{self.root}/writers/{me}")
        fs.create(at, False).close()

        def write(writer) -> str:
            nonlocal n
            n += 1
            writer.option("compression", CODEC).parquet(f"{self.root}/data/{me}-{n}")
            return f"{self.root}/data/{me}-{n}"

        self._me = me
        try:
            yield write
        finally:
            fs.delete(at, False)

    def _schema(self, shards: DataFrame) -> T.StructType | None:
        """The union of the shards' schemas, or None without shards. A data folder is one write and has one schema, so one footer of each is read."""
        paths = [r["path"] for r in shards.groupBy(_folder()).agg(F.min("path").alias("path")).orderBy("path").collect()]
        return self.spark.read.option("mergeSchema", True).parquet(*paths).schema if paths else None

    def _shards(self, data: str, version: int) -> DataFrame:
        """Manifest rows of the files under ``data``; only file metadata and row counts are read."""
        at, fs = common._fs(self.spark, data)
        if not any(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(at)):
            return self.spark.createDataFrame([], _MANIFEST)
        files = self.spark.read.parquet(data).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.ceil(F.log(F.col("bytes") / FLOOR_BYTES) / math.log(FANOUT))).cast("int")
        return files.select("path", "bytes", "rows", tier.alias("tier"), F.lit(version).cast("bigint").alias("added"))

    def _commit(self, begun: int, manifest: DataFrame) -> int:
        """Make ``manifest`` the successor of version ``begun``, or raise CommitConflict if there is one already."""
        name = uuid.uuid4().hex
        manifest.write.parquet(f"{self.root}/manifests/{name}")
        aside, fs = common._fs(self.spark, f"{self.root}/commits/_{name}")
        out = fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        held, _ = common._fs(self.spark, f"{self.root}/writers/{self._me}")
        if not fs.exists(held):
            raise CommitConflict(f"{self.root}: the writer's lease has ended")
        try:
            if not self._place(aside, f"{self.root}/commits/{begun + 1:012d}"):
                raise CommitConflict(f"{self.root} has gone on from version {begun}")
        finally:
            fs.delete(aside, False)
        return begun + 1

    def _place(self, aside, path: str) -> bool:
        """Give a whole file its final name unless that is taken, in one step of the file system.

        A local file system replaces files when it renames, so the file is
        linked there; others (HDFS and those that follow it) refuse to rename
        to a name that exists.
        """
        at, fs = common._fs(self.spark, path)
        real = fs.resolvePath(aside)
        if real.toUri().getScheme() == "file":
            try:
                os.link(real.toUri().getPath(), os.path.join(os.path.dirname(real.toUri().getPath()), at.getName()))
            except FileExistsError:
                return False
            return True
        return not fs.exists(at) and fs.rename(aside, at)

    def _read_text(self, path: str) -> str:
        return self.spark.read.text(path).first()[0]


def _union(a: T.DataType, b: T.DataType, at: str = "") -> T.DataType:
    """The fields of both types, also inside structs, arrays and maps; a conflict raises TypeError."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f for f in b}
        own = [T.StructField(f.name, _union(f.dataType, other[f.name].dataType, f"{at}.{f.name}") if f.name in other else f.dataType) for f in a]
        return T.StructType([*own, *[f for f in b if f.name not in a.names]])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_union(a.elementType, b.elementType, at))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(_union(a.keyType, b.keyType, at), _union(a.valueType, b.valueType, at))
    if a != b:
        raise TypeError(f"column {at[1:]} is {a.simpleString()} in the store and {b.simpleString()} in the arrival")
    return a


def _packed_session(spark: SparkSession, target: int) -> SparkSession:
    """A session of its own whose scans pack whole small files into partitions of ``target`` bytes; the caller's settings stay."""
    own = spark.newSession()
    for k, v in {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
        own.conf.set(k, v)
    return own


def _folder() -> Column:
    """The data folder of a shard's path."""
    return F.substring_index(F.substring_index("path", "/", -2), "/", 1)
