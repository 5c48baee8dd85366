"""Versions of a session's tables: several tables change in one commit, readers keep the version they began with."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SCHEMAS


class Conflict(RuntimeError):
    """Another writer has committed since the version that was read."""


class Snapshot:
    """One version: for each table the folder of its rows."""

    def __init__(self, store: Snapshots, session_id: int, version: int, tables: dict[str, str]):
        self.store, self.session_id, self.version, self.tables = store, session_id, version, tables

    def read(self, table: str) -> DataFrame:
        spark = self.store.spark
        path = self.tables.get(table)
        return spark.createDataFrame([], SCHEMAS[table]) if path is None else spark.read.schema(SCHEMAS[table]).parquet(path)

    def commit(self, **changes: DataFrame) -> Snapshot:
        """The next version, with these tables in place of the old ones, or a Conflict.

        Rows go to folders of their own first; a writer that dies meanwhile
        leaves folders that no version names. Then the manifest, complete,
        gets the number of the next version by a rename that does not
        overwrite: of two writers one has its version, the other is refused.
        """
        tables, spark = dict(self.tables), self.store.spark
        for name, df in changes.items():
            fields = spark.createDataFrame([], SCHEMAS[name]).schema
            own = df.withColumn("session_id", F.lit(self.session_id)) if "session_id" in fields.names else df
            tables[name] = f"{self.store.folder(self.session_id)}/data/{uuid.uuid4().hex}/{name}"
            own.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(tables[name])
        self.store.publish(self.session_id, self.version + 1, tables)
        return Snapshot(self.store, self.session_id, self.version + 1, tables)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """The table with rows added, their ids counted on from the highest one; for commit()."""
        fields = self.store.spark.createDataFrame([], SCHEMAS[table]).schema
        old = self.read(table)
        top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        have = rows.columns
        new = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        return old.unionByName(new.withColumn("id", F.col("id") + F.lit(top)).withColumn("session_id", F.lit(self.session_id).cast("long")))


class Snapshots:
    """Sessions under one root folder: session=N/versions/ has a manifest for each version, session=N/data/ the rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def folder(self, session_id: int) -> str:
        return f"{self.root}/session={session_id}"

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def versions(self, session_id: int) -> list[int]:
        at, fs = self._path(f"{self.folder(session_id)}/versions"), self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def open(self, session_id: int, version: int | None = None) -> Snapshot:
        """A version, the newest if none is named; version 0 has no rows."""
        have = self.versions(session_id)
        version = (have[-1] if have else 0) if version is None else version
        if not version:
            return Snapshot(self, session_id, 0, {})
        if version not in have:
            raise LookupError(f"session {session_id} has no version {version}")
        fs, jvm = self._fs(), self.spark._jvm
        stream = fs.open(self._path(self._manifest(session_id, version)))
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self, session_id, version, json.loads(text)["tables"])

    def _manifest(self, session_id: int, version: int) -> str:
        return f"{self.folder(session_id)}/versions/{version:012d}.json"

    def publish(self, session_id: int, version: int, tables: dict[str, str]) -> None:
        fs, jvm = self._fs(), self.spark._jvm
        final = self._path(self._manifest(session_id, version))
        aside = self._path(f"{self.folder(session_id)}/versions/_{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        kept = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(final), kept)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"session {session_id} already has a version {version}") from None
            raise

    def vacuum(self, session_id: int, keep: int = 10) -> int:
        """Forget all but the last versions and the folders that none of them names; how many folders went. Not while someone writes to the session."""
        fs, have = self._fs(), self.versions(session_id)
        named = {p.rsplit("/", 2)[1] for v in have[-keep:] for p in self.open(session_id, v).tables.values()}
        for v in have[:-keep]:
            fs.delete(self._path(self._manifest(session_id, v)), False)
        data, gone = self._path(f"{self.folder(session_id)}/data"), 0
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in named:
                gone += fs.delete(s.getPath(), True)
        return gone
