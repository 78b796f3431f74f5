"""Versioned snapshots: Parquet tables and a table of JSON entries in one folder of any file system Spark reads."""

from __future__ import annotations

import contextlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import agent_nr
from ..model import ModelError, config

ENTRY = "seq long, kind string, name string, transition long, comment string, value string"


class Store:
    """Entries are appended, never changed; the last one of a name counts."""

    def __init__(self, spark: SparkSession, path: str):
        path = path if "/" in path[:1] or ":" in path or not config.folder else f"{config.folder.rstrip('/')}/{path}"
        self.spark, self.path, self.waiting, self.batch = spark, path.rstrip("/"), [], False

    def fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def exists(self) -> bool:
        fs, where = self.fs()
        return bool(fs.exists(where))

    def clear(self) -> None:
        fs, where = self.fs()
        fs.delete(where, True)

    def put(self, kind: str, name: str, transition: int, value, comment: str = "") -> None:
        self.waiting.append((time.time_ns(), kind, name, transition, comment, json.dumps(value)))
        if not self.batch:
            self.flush()

    def flush(self) -> None:
        """Write the entries that wait, in one go."""
        rows, self.waiting = self.waiting, []
        if rows:
            self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(f"{self.path}/entries")

    @contextlib.contextmanager
    def together(self):
        """Entries put inside are written at the end, unless an outer one still gathers."""
        outer, self.batch = self.batch, True
        try:
            yield
        finally:
            self.batch = outer
            if not outer:
                self.flush()

    def add_table(self, entry: str, name: str, transition: int, frame: DataFrame, **more) -> None:
        file = f"tables/{uuid.uuid4().hex}"
        frame.write.option("compression", config.codec).parquet(f"{self.path}/{file}")
        self.put(entry, name, transition, {**more, "file": file, "schema": frame.schema.jsonValue()})

    def entries(self, kind: str, name: str | None = None) -> list:
        self.flush()
        frame = self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries").filter(F.col("kind") == kind)
        return (frame if name is None else frame.filter(F.col("name") == name)).orderBy("seq").collect()

    def as_of(self, kind: str, name: str, transition: int | None):
        """The entry with the largest transition up to the one asked for; the last written among equal ones."""
        found = [r for r in self.entries(kind, name) if transition is None or r["transition"] <= transition]
        return max(found, key=lambda r: (r["transition"], r["seq"])) if found else None

    def transition_of(self, comment: str) -> int:
        for r in self.entries("snapshot"):
            if r["comment"] == comment:
                return r["transition"]
        raise ModelError(f"no snapshot with the comment {comment!r}")


def numbered_path(spark: SparkSession, path: str) -> str:
    """path-000001 and so on, the first that is free."""
    k = 1
    while Store(spark, f"{path}-{k:06d}").exists():
        k += 1
    return f"{path}-{k:06d}"


def read_agents(spark: SparkSession, path: str, kind: str, transition: int | None = None, comment: str | None = None) -> DataFrame:
    """The table of an agent or edge type as it was, without a simulation."""
    store = Store(spark, path)
    transition = store.transition_of(comment) if comment is not None else transition
    entry = store.as_of("table", kind, transition)
    if entry is None:
        raise ModelError(f"{path} has no version of {kind}")
    got = json.loads(entry["value"])
    from pyspark.sql import types as T

    return spark.read.schema(T.StructType.fromJson(got["schema"])).parquet(f"{store.path}/{got['file']}")


read_edges = read_agents


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(Store(spark, path).as_of("params", "", None)["value"])


def read_globals(spark: SparkSession, path: str, transition: int | None = None, comment: str | None = None) -> dict:
    store = Store(spark, path)
    transition = store.transition_of(comment) if comment is not None else transition
    out: dict = {}
    for name in dict.fromkeys(r["name"] for r in store.entries("global")):
        if (entry := store.as_of("global", name, transition)) is not None:
            out[name] = json.loads(entry["value"])
    return out


def list_snapshots(spark: SparkSession, path: str) -> list[tuple[int, str]] | None:
    store = Store(spark, path)
    if not store.exists():
        return None
    last = {}
    for r in store.entries("snapshot"):
        last[r["transition"]] = r["comment"]
    return sorted(last.items())


def read_metadata(spark: SparkSession, path: str, kind: str, field: str, key: str | None = None):
    found = {json.loads(r["value"])[0]: json.loads(r["value"])[1] for r in Store(spark, path).entries("metadata", f"{kind}.{field}")}
    return found if key is None else found.get(key)


def read_sim_metadata(spark: SparkSession, path: str, key: str | None = None):
    return read_metadata(spark, path, "", "", key)


class SnapshotMethods:
    """Part of Simulation."""

    def create_store(self, path: str | None = None, overwrite: bool | None = None) -> Store:
        if not self.initialized:
            raise ModelError("finish_init() comes before the first snapshot")
        path = path or self.filename
        overwrite = self.overwrite_file if overwrite is None else overwrite
        store = Store(self.spark, path if overwrite else numbered_path(self.spark, path))
        if overwrite and store.exists():
            store.clear()
        self.store, self.versions = store, {}
        with store.together():
            store.put("params", "", 0, self.params)
            for k, v in {"simulation_name": self.name, "model_name": self.model.name, "date": time.strftime("%Y-%m-%dT%H:%M:%S")}.items():
                store.put("metadata", ".", 0, [k, v])
            for (kind, field, key), value in self.metadata.items():
                store.put("metadata", f"{kind}.{field}", 0, [key, value])
            for name, (dims, kind, grid) in self.rasters.items():
                store.add_table("raster", name, 0, grid, dims=dims, kind=kind)
        return store

    def close_store(self) -> None:
        self.store = None

    def write_tables(self, names) -> None:
        """A new version of each table that has changed since its last one."""
        store = self.store or self.create_store()
        with store.together():
            for name in names:
                if self.versions.get(name) == self.last_change.get(name, 0):
                    continue
                self.solid(name)
                frame = self.agents(name) if name in self.model.agents else self.edges(name)
                store.add_table("table", name, self.num_transitions, frame, changed=self.last_change.get(name, 0))
                self.versions[name] = self.last_change.get(name, 0)

    def write_agents(self, types=None) -> None:
        self.write_tables(types or self.model.agents)

    def write_edges(self, types=None) -> None:
        self.write_tables(types or self.model.edges)

    def write_globals(self, fields=None) -> None:
        """A new version of each global that differs from its last one."""
        store = self.store or self.create_store()
        with store.together():
            for name in fields or self.globals:
                value = json.dumps(self.globals[name])
                if self.versions.get(("global", name)) != value:
                    store.put("global", name, self.num_transitions, self.globals[name])
                    self.versions["global", name] = value

    def write_snapshot(self, comment: str = "", ignore=()) -> None:
        with (self.store or self.create_store()).together():
            self.write_globals()
            self.write_agents([a for a in self.model.agents if a not in ignore])
            self.write_edges([e for e in self.model.edges if e not in ignore])
            self.store.put("snapshot", "", self.num_transitions, {"globals_last_change": self.globals_last_change}, comment)

    def write_metadata(self, kind: str, field: str, key: str, value) -> None:
        self.metadata[kind, field, key] = value
        if self.store:
            self.store.put("metadata", f"{kind}.{field}", self.num_transitions, [key, value])

    def write_sim_metadata(self, key: str, value) -> None:
        self.write_metadata("", "", key, value)

    def read_snapshot(self, path: str | None = None, transition: int | None = None, comment: str | None = None, ignore_params: bool = False, writeable: bool = False) -> bool:
        """Restore all from a folder, with the counters of changes; False if it is not there. Ids are stable, so there is nothing to map.

        ``writeable``: later snapshots go to the same store.
        """
        store = Store(self.spark, path or self.filename)
        if not store.exists():
            return False
        if comment is not None:
            transition = store.transition_of(comment)
        if not ignore_params:
            self.params = read_params(self.spark, store.path)
        self.globals |= read_globals(self.spark, store.path, transition)
        self.read_tables([*self.model.agents, *self.model.edges], store.path, transition)
        self.read_rasters(store.path)
        label = store.as_of("snapshot", "", transition)
        self.num_transitions = label["transition"] if label else 0
        self.globals_last_change = (json.loads(label["value"]) or {}).get("globals_last_change", 0) if label else 0
        self.initialized = True
        if writeable:
            self.store = store
            self.versions = {name: self.last_change.get(name, 0) for name in (*self.model.agents, *self.model.edges)} | {("global", k): json.dumps(v) for k, v in self.globals.items()}
        return True

    def read_rasters(self, path: str | None = None) -> None:
        """The grids of a store, without its other tables."""
        from pyspark.sql import types as T

        store = Store(self.spark, path or self.filename)
        for r in store.entries("raster"):
            got = json.loads(r["value"])
            self.rasters[r["name"]] = (tuple(got["dims"]), got["kind"], self.spark.read.schema(T.StructType.fromJson(got["schema"])).parquet(f"{store.path}/{got['file']}"))

    def read_tables(self, names, path: str | None = None, transition: int | None = None, comment: str | None = None) -> None:
        store = Store(self.spark, path or self.filename)
        if comment is not None:
            transition = store.transition_of(comment)
        for name in names:
            try:
                frame = read_agents(self.spark, store.path, name, transition)
            except ModelError:
                continue
            self.loose.discard(name)
            self.last_change[name] = json.loads(store.as_of("table", name, transition)["value"]).get("changed", 0)
            if name in self.model.agents:
                self.agent_tables[name] = frame
                self.used[name] = frame.agg(F.max(agent_nr(F.col("id")))).first()[0] or 0
            else:
                self.edge_tables[name] = frame

    def merge_agents(self, path: str, types=None, transition: int | None = None) -> DataFrame:
        """Add the agents of another store under new ids, before finish_init(). Gives the id mapping (old, new)."""
        maps = None
        for name in types or self.model.agents:
            found = read_agents(self.spark, path, name, transition)
            rows = self.add_agents(name, found.withColumnRenamed("id", "old"))
            own = rows.select("old", F.col("id").alias("new"))
            maps = own if maps is None else maps.unionByName(own)
        return maps

    def merge_edges(self, path: str, idmapping: DataFrame, types=None, transition: int | None = None) -> None:
        """Add the edges of another store, their ends taken through the mapping of merge_agents()."""
        for name in types or self.model.edges:
            rows = read_agents(self.spark, path, name, transition)
            for end in ("from", "to"):
                if end in rows.columns:
                    mapped = rows.join(idmapping.select(F.col("old").alias(end), "new"), end).drop(end).withColumnRenamed("new", end)
                    rows = mapped
            self.add_edges(name, rows)
