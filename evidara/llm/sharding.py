"""Sharding: size-tiered compaction of immutable shards under a versioned manifest.

An arrival is appended as small shards: files that are never changed. Shards of one arrival or one merge form a run; a run of
s bytes stands in tier floor(log(s / base) / log(fan)), 0 at least. Whenever a tier has ``fan`` runs, they are merged into one run of
files of about the target size, which stands in a higher tier, so a row is rewritten once for each tier, not for each arrival.
A merge reads whole shards and shuffles nothing: small scan partitions are joined to one file, large ones are cut by rows.

The manifest of a version lists its runs, a folder of files each, with their rows and bytes; tiers keep their number small,
whatever the number of files. It is written beside its place and renamed there by the holder of the version's lock, so of two
writers one commits and the other has to start from the new version. A lock whose writer was lost is taken over after
``lease`` seconds; a writer that is slower than that finds another's name in the lock and does not commit. Readers take the
highest version or any older one: a merge deletes nothing, so what a reader has planned on stays. ``vacuum`` drops the manifests
behind the newest ``keep`` that were replaced more than ``retain`` seconds ago, with the runs that only they list. Folders that no manifest lists
are no part of the store, whatever a lost task or writer left behind; ``vacuum`` deletes those that are older than the lease.
``shard``, which loads a new store, drops its own intermediate versions at once but for the last two.

Bytes are those of the text column (null: 0), so tiers do not depend on the file format. Null in any column, empty and long
texts, repeated rows and further columns of any name are kept as they are; an empty arrival adds no run; a store without
arrivals is an empty table.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.skew import fresh

#: Bytes of text of an arrival, at most about (and one scan partition at least).
ARRIVAL = 32 << 20


class Conflict(RuntimeError):
    """Another writer committed this version."""


class Store:
    def __init__(self, spark: SparkSession, root: str, schema, target: int = 32 << 20, base: int = 4 << 20, fan: int = 4, size: str = "text", lease: float = 3600):
        self.spark, self.root, self.schema, self.target, self.base, self.fan, self.size, self.lease = spark, root, schema, target, base, fan, size, lease

    # manifest

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.root}/manifests")
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v")) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        found = self._read(self._fs()[1](f"{self.root}/manifests/v{version:09d}.json"))
        if found is None:
            raise LookupError(f"version {version} is not in the store; there are {self.versions()}")
        return json.loads(found)

    def commit(self, read: int, runs: list[dict]) -> dict:
        """Makes ``runs`` version ``read`` + 1, or raises ``Conflict``."""
        made = {"version": read + 1, "runs": runs}
        fs, path = self._fs()
        place, beside = path(f"{self.root}/manifests/v{read + 1:09d}.json"), path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        stream.write(bytearray(json.dumps(made, sort_keys=True).encode()))
        stream.close()
        # the lock file is created by one writer only; a rename alone may replace its target on some stores
        lock, name = path(f"{self.root}/manifests/.lock{read + 1:09d}"), uuid.uuid4().hex
        if not self._locked(lock, name) or fs.exists(place) or not self._holds(lock, name) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise Conflict(f"version {read + 1} is committed by another writer")
        return made

    def _locked(self, lock, name: str) -> bool:
        """Creates the lock with the writer's name; one older than the lease belongs to a lost writer and is moved away first."""
        fs, path = self._fs()
        for _ in range(2):
            try:
                stream = fs.create(lock, False)
            except Exception:
                if not self._stale(lock) or not fs.rename(lock, path(f"{self.root}/manifests/.stale-{uuid.uuid4().hex}")):
                    return False
                continue
            stream.write(bytearray(name.encode()))
            stream.close()
            return True
        return False

    def _holds(self, lock, name: str) -> bool:
        """Whether the lock is still this writer's."""
        return self._read(lock) == name

    def _read(self, at) -> str | None:
        fs, _ = self._fs()
        try:
            stream = fs.open(at)
        except Exception:  # moved away by the writer that took over
            return None
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _stale(self, at) -> bool:
        fs, _ = self._fs()
        return fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > self.lease

    # runs

    def tier(self, n_bytes: int) -> int:
        return max(0, math.floor(math.log(max(n_bytes, 1) / self.base, self.fan))) if n_bytes > self.base else 0

    def _bytes(self) -> Column:
        return F.coalesce(F.octet_length(self.size), F.lit(0)).cast("long")

    def write(self, rows: DataFrame, split: str | None = None, rows_a_file: int = 0) -> list[dict]:
        """Rows as new files, as one run or as one for each value of the column ``split``; not part of the store yet."""
        name = f"run-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        writer = rows.write.mode("error").option("maxRecordsPerFile", rows_a_file)
        (writer.partitionBy(split) if split else writer).parquet(at)
        fs, path = self._fs()
        below = [s.getPath().getName() for s in fs.listStatus(path(at)) if s.isDirectory()] if split else []
        if not (below if split else any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(path(at)))):
            return []
        back = self.spark.read.parquet(at) if split else self.spark.read.schema(self.schema).parquet(at)
        sizes = back.groupBy(*[split] * bool(split)).agg(F.count("*").alias("n"), F.sum(self._bytes()).alias("b")).collect()  # one row for each run
        runs = [(f"{name}/{split}={row[0]}" if split else name, row["n"], row["b"]) for row in sorted(sizes, key=lambda r: r[0])]
        return [{"run": run, "rows": n, "bytes": b, "tier": self.tier(b)} for run, n, b in runs if n]

    def rows(self, runs: list[dict]) -> DataFrame:
        at = [f"{self.root}/{r['run']}" for r in runs]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows(self.manifest(version)["runs"])

    # operations

    def append(self, arrival: DataFrame) -> dict:
        """Adds an arrival as a run of small shards."""
        return self.add(self.write(arrival))

    def add(self, runs: list[dict]) -> dict:
        held = self.manifest()
        return self.commit(held["version"], held["runs"] + runs) if runs else held

    def due(self, runs: list[dict]) -> list[dict]:
        """The runs of the lowest tier that has ``fan`` of them or more."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            tiers.setdefault(run["tier"], []).append(run)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), [])

    def compact(self) -> dict:
        """Merges until no tier has ``fan`` runs, committing after each merge."""
        held = self.manifest()
        while due := self.due(held["runs"]):
            n_bytes, n_rows = sum(r["bytes"] for r in due), sum(r["rows"] for r in due)
            files = max(1, round(n_bytes / self.target))
            merged = self.write(self.rows(due).coalesce(files), rows_a_file=-(-n_rows * 5 // (files * 4)))
            merged = [r | {"tier": max(r["tier"], due[0]["tier"] + 1)} for r in merged]
            held = self.commit(held["version"], [r for r in held["runs"] if r not in due] + merged)
        return held

    def _delete(self, runs: list[str]) -> None:
        fs, path = self._fs()
        for run in runs:
            fs.delete(path(f"{self.root}/{run}"), True)

    def _age(self, at) -> float:
        return time.time() - self._fs()[0].getFileStatus(at).getModificationTime() / 1000

    def vacuum(self, keep: int = 10, retain: float | None = None) -> list[int]:
        """Drops versions and the runs that only they list, and old folders of lost writers; the versions that are left. A
        version is kept if it is one of the newest ``keep`` or its successor is younger than ``retain`` seconds (the lease, if
        not given). Manifests go first, so no version is listed whose files may be gone."""
        fs, path = self._fs()
        at = lambda v: path(f"{self.root}/manifests/v{v:09d}.json")
        retain, versions = self.lease if retain is None else retain, self.versions()
        old = [v for v, after in zip(versions, versions[1:], strict=False) if v <= versions[-1] - max(1, keep) and self._age(at(after)) >= retain]
        listed = {v: {r["run"] for r in self.manifest(v)["runs"]} for v in versions}
        live = set().union(*(runs for v, runs in listed.items() if v not in old))
        for v in old:
            fs.delete(at(v), False)
        replaced = set().union(*(listed[v] for v in old)) - live
        self._delete(sorted(replaced))
        found = []
        for top in fs.listStatus(path(self.root)):
            name = top.getPath().getName()
            if name.startswith("run-") and name not in live and self._stale(top.getPath()):
                below = [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(top.getPath()) if s.isDirectory() and "=" in s.getPath().getName()]
                found += [b for b in below if b not in live] if any(b in live for b in below) else [name]
        self._delete(found)
        return [v for v in versions if v not in old]


def shard(docs: DataFrame, root: str, arrival: int = ARRIVAL, **options) -> Store:
    """A store of ``docs`` that came in arrivals of about ``arrival`` bytes of text, each committed and compacted in turn. All are
    written at once, each task's rows to one of them, so an arrival has a scan partition at least."""
    store = Store(docs.sparkSession, root, docs.schema, **options)
    n = max(1, -(-(docs.agg(F.sum(store._bytes())).first()[0] or 0) // arrival))
    name = fresh("arrival", docs)
    for run in store.write(docs.withColumn(name, F.pmod(F.spark_partition_id(), F.lit(n))), name):
        store.add([run])
        store.compact()
        store.vacuum(keep=2, retain=0)
    return store
