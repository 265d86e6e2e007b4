"""A table by key in the shared folder that is changed copy-on-write, bucket by bucket."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import merge

_BUCKET = "__lodestone_bucket"


class Conflict(RuntimeError):
    """Another writer has changed the table since it was opened."""


class KeyedTable:
    """Parquet files in buckets of the key's hash, and a manifest that says which ones are the table.

    ``<path>/data/<id>/bucket=n`` holds files that never change; ``<path>/manifests/<version>.json``
    names the folders of each bucket.  A change writes new folders for the buckets that its keys
    fall into, then the next manifest, which appears at once or not at all; readers of the old
    version go on undisturbed.  A writer that fails leaves the old table and files that ``vacuum``
    removes; of two writers on the same version the later gets ``Conflict``.

    The manifest has a line a bucket, so the driver holds no more than the number of buckets, which is
    chosen when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.manifest = self._latest()

    # ---- files

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        target, files = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []

    def _latest(self) -> tuple[int, dict]:
        versions = [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]
        if not versions:
            raise FileNotFoundError(f"no table at {self.path}")
        return max(versions), self._read(max(versions))

    def _read(self, version: int) -> dict:
        target, files = self._fs(f"{self.path}/manifests/{version:012d}.json")
        stream = files.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    @staticmethod
    def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        final = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{version:012d}.json")
        waiting = jvm.org.apache.hadoop.fs.Path(f"{path}/waiting/{uuid.uuid4().hex}")
        files = final.getFileSystem(conf)
        files.mkdirs(final.getParent())
        stream = files.create(waiting)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
        try:
            context.rename(waiting, final, none)  # fails where the version is there
        except Exception as e:
            files.delete(waiting, False)
            if "already exists" in str(e).lower() or files.exists(final):
                raise Conflict(f"version {version} of {path} is there") from None
            raise

    def _put(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows by bucket; the new folders by bucket."""
        folder = f"data/{uuid.uuid4().hex}"
        key, n = self.manifest["key"], self.manifest["buckets"]
        with_bucket = rows.withColumn(_BUCKET, _bucket(F.col(f"`{key}`"), n))
        with_bucket.repartition(_BUCKET).sortWithinPartitions(_BUCKET, F.col(f"`{key}`")).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        names = [x for x in self._names(folder) if x.startswith(_BUCKET)]
        return {x.partition("=")[2]: f"{folder}/{x}" for x in names}

    def _swap(self, folders: dict[str, list[str]]) -> KeyedTable:
        self._commit(self.spark, self.path, self.version + 1, self.manifest | {"folders": folders})
        return KeyedTable(self.spark, self.path)

    # ---- the table

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        """Stores ``df``, whose keys are distinct and not null, as version 1."""
        spark, empty = df.sparkSession, {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": {}}
        table = cls.__new__(cls)
        table.spark, table.path, table.version, table.manifest = spark, path.rstrip("/"), 0, empty
        return table._swap({b: [f] for b, f in table._put(df).items()})

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """The table as of this version, or some of its buckets."""
        schema = T.StructType.fromJson(self.manifest["schema"])
        folders = self.manifest["folders"]
        paths = [f"{self.path}/{f}" for b in (folders if buckets is None else buckets) for f in folders.get(b, [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, incoming: DataFrame) -> list[str]:
        """The buckets that the incoming keys fall into: as many rows as buckets at most."""
        key, n = self.manifest["key"], self.manifest["buckets"]
        rows = incoming.where(F.col(f"`{key}`").isNotNull()).select(_bucket(F.col(f"`{key}`"), n).alias("b")).distinct()
        return sorted(str(r["b"]) for r in rows.collect())

    def upsert(self, incoming: DataFrame, backfill: tuple[str, ...], order: str) -> KeyedTable:
        """As ``merge.upsert``; only the buckets of incoming keys are read and written again."""
        buckets = self.touched(incoming)
        if not buckets:
            return self
        whole = merge.upsert(self.read(buckets), incoming.where(F.col(f"`{self.manifest['key']}`").isNotNull()), self.manifest["key"], backfill, order)
        new = self._put(whole)
        return self._swap(self.manifest["folders"] | {b: [new[b]] for b in buckets})

    def insert_ignore(self, incoming: DataFrame, order: str) -> KeyedTable:
        """As ``merge.insert_ignore``; the new rows become further files of their buckets."""
        buckets = self.touched(incoming)
        if not buckets:
            return self
        fresh = merge.insert_ignore(self.read(buckets), incoming.where(F.col(f"`{self.manifest['key']}`").isNotNull()), self.manifest["key"], order)
        new = self._put(fresh.select(*[f"`{f['name']}`" for f in self.manifest["schema"]["fields"]]))
        folders = self.manifest["folders"]
        return self._swap(folders | {b: folders.get(b, []) + [f] for b, f in new.items()}) if new else self

    def vacuum(self, keep: int = 2) -> int:
        """Removes the manifests before the last ``keep`` and the files that no manifest names any
        more; how many folders went.  No writer may be at work meanwhile."""
        _, files = self._fs(self.path)
        kept, gone = set(), 0
        for version in range(1, self.version + 1):
            target, _ = self._fs(f"{self.path}/manifests/{version:012d}.json")
            if version > self.version - keep and files.exists(target):
                kept |= {f for some in self._read(version)["folders"].values() for f in some}
            else:
                files.delete(target, False)
        for folder in self._names("data"):
            for part in self._names(f"data/{folder}"):
                if part.startswith(_BUCKET) and f"data/{folder}/{part}" not in kept:
                    gone += 1
                    files.delete(self._fs(f"{self.path}/data/{folder}/{part}")[0], True)
            if not any(part.startswith(_BUCKET) for part in self._names(f"data/{folder}")):
                files.delete(self._fs(f"{self.path}/data/{folder}")[0], True)
        return gone


def _bucket(key, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
