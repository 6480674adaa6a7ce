"""A store on disk: folders of rows and of deleted keys for each table, and numbered versions that list them.

A commit writes new folders and then one version file, by a rename to a number that no version has; nothing is
overwritten or deleted, so a commit that breaks off leaves the store as it was. Readers keep the version they
opened. Adding rows writes those rows alone, deleting writes keys; compact() folds a table into one sorted
folder, vacuum() removes what no kept version names. One writer at a time: of two, the later one fails.
"""
from __future__ import annotations

import json
import uuid
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from .schemas import TABLES
from .seam import BlockStore
from .tables import Tables, edge_rows, list_sessions, purged, put_rows

SCHEMA_VERSION = 2
ENTITIES = ("blocks", "session_blocks", "edges", "hash_index")
#: What a table's rows are sorted by within their files.
SORT = {"blocks": "block_id", "session_blocks": "session_id", "edges": "from_id", "hash_index": "content_hash", "traces": "call_id", "embedding_cache": "content_hash"}
#: The columns by which deleted blocks leave each table.
OF_BLOCK = {"blocks": ("block_id",), "session_blocks": ("block_id",), "edges": ("from_id", "to_id"), "hash_index": ("block_id",)}


class StoreError(RuntimeError):
    pass


class SchemaMismatch(StoreError):
    pass


class ContextStore(BlockStore):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._exists("_current"):
            raise SchemaMismatch("this folder has a store of an earlier layout")
        numbers = self.versions()
        if numbers:
            self.number = numbers[-1]
            meta = self._meta(self.number)
            if meta.get("schema_version") != SCHEMA_VERSION:
                raise SchemaMismatch(f"store has schema {meta.get('schema_version')}, this code reads {SCHEMA_VERSION}")
            self.parts: dict[str, list[list]] = meta["tables"]
        else:
            if set(self._names("")) - {"_versions"}:
                raise StoreError(f"{self.path} is not empty and has no version of a store")
            self.number, self.parts = -1, {n: [] for n in TABLES}
            self._publish(self.parts)

    @property
    def version(self) -> str:
        return f"v{self.number}"

    # -- files
    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def _exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def _names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(name))] if self._exists(name) else []

    def versions(self) -> list[int]:
        """The numbers of all versions, in order."""
        return sorted(int(n[1:-5]) for n in self._names("_versions") if n.startswith("v") and n.endswith(".json"))

    def _meta(self, number: int) -> dict:
        stream = self.fs.open(self._at(f"_versions/v{number}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as e:
            raise StoreError(f"version {number} of the store can't be read") from e
        finally:
            stream.close()

    def _publish(self, parts: dict[str, list[list]]) -> None:
        number = self.number + 1
        to, fresh = f"_versions/v{number}.json", f"_versions/new-{uuid.uuid4().hex}"
        self.fs.mkdirs(self._at("_versions"))
        out = self.fs.create(self._at(fresh), True)
        out.write(bytearray(json.dumps({"schema_version": SCHEMA_VERSION, "tables": parts}).encode()))
        out.close()
        if self._exists(to) or not self.fs.rename(self._at(fresh), self._at(to)):
            self.fs.delete(self._at(fresh), False)
            raise StoreError(f"version {number} was written by somebody else")
        self.number, self.parts = number, parts

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    # -- reading
    def table(self, name: str) -> DataFrame:
        """Rows folders and, for each folder of keys, what was there before it less those keys."""
        out = None
        for (kind, column), run in groupby(self.parts[name], key=lambda p: (p[0], p[2])):
            folders = [f"{self.path}/{p[1]}" for p in run]
            if kind == "rows":
                df = self.spark.read.schema(TABLES[name]).parquet(*folders)
                out = df if out is None else out.unionByName(df)
            elif out is not None:
                out = out.join(self.spark.read.schema("key string").parquet(*folders).withColumnRenamed("key", column), column, "left_anti").select(*out.columns)
        return self.spark.createDataFrame([], TABLES[name]) if out is None else out

    def edges(self) -> DataFrame:
        return self.table("edges")

    def hash_index(self) -> DataFrame:
        return self.table("hash_index")

    def list_sessions(self) -> DataFrame:
        return list_sessions(self.tables)

    # -- writing
    def change(self, add: dict[str, DataFrame] | None = None, gone: list[tuple[DataFrame, dict[str, tuple[str, ...]]]] = (), replace: dict[str, DataFrame] | None = None) -> ContextStore:
        """One commit: tables are replaced, then keys (one column each) leave the named columns of tables, then rows are added."""
        parts = {n: list(p) for n, p in self.parts.items()}
        row = lambda name, df: ["rows", self._write(name, df.select(*self.spark.createDataFrame([], TABLES[name]).columns).sortWithinPartitions(SORT[name])), None]
        for name, df in (replace or {}).items():
            parts[name] = [row(name, df)]
        for keys, columns in gone:
            folder = self._write("gone", keys.toDF("key"))
            for name, of in columns.items():
                parts[name] += [["gone", folder, column] for column in of]
        for name, df in (add or {}).items():
            parts[name].append(row(name, df))
        self._publish(parts)
        return self

    def commit(self, changed: dict[str, DataFrame] | Tables) -> ContextStore:
        """Replaces the changed tables; the others keep their folders."""
        return self.change(replace={n: getattr(changed, n) for n in ENTITIES} if isinstance(changed, Tables) else changed)

    def put(self, incoming: DataFrame) -> ContextStore:
        """As tables.put, writing new rows alone."""
        incoming = incoming.persist()
        try:
            new, replaced = put_rows(self.tables, incoming)
            return self.change(new, [] if replaced.isEmpty() else [(replaced, {"blocks": ("block_id",)})])
        finally:
            incoming.unpersist()

    def delete(self, ids: DataFrame) -> ContextStore:
        """As tables.delete, writing the ids alone."""
        return self.change(gone=[(ids.select("block_id").distinct(), OF_BLOCK)])

    def purge(self, sessions: DataFrame) -> ContextStore:
        """As tables.purge_sessions, writing the sessions and the ids of blocks that no other session keeps."""
        gone = sessions.select("session_id").distinct()
        return self.change(gone=[(gone, {"session_blocks": ("session_id",)}), (purged(self.tables, gone)[0], OF_BLOCK)])

    def put_edges(self, edges: DataFrame) -> ContextStore:
        return self.change({"edges": edge_rows(self.tables, edges)})

    # -- upkeep
    def compact(self, *names: str) -> ContextStore:
        """Folds the tables (all of them by default) into one folder each."""
        return self.change(replace={n: self.table(n) for n in names or TABLES if len(self.parts[n]) > 1})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the last keep versions, and the folders that none of them names: readers of older versions lose them."""
        numbers = self.versions()
        kept = numbers[-max(1, keep) :]
        named = {p[1] for n in kept for parts in self._meta(n)["tables"].values() for p in parts}
        gone = [f"{t}/{f}" for t in (*TABLES, "gone") for f in self._names(t) if f"{t}/{f}" not in named]
        for n in numbers:
            if n not in kept:
                self.fs.delete(self._at(f"_versions/v{n}.json"), False)
        for f in gone:
            self.fs.delete(self._at(f), True)
        return gone
