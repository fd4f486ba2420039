"""Tables as Parquet parts under one version pointer, merged on read: what a change writes follows the change's size.

A table is a list of parts. The first is its base; each later one holds the rows that a change set or removed (tombstones),
dealt into buckets by a hash of the table's key. Readers put the newest row of each key before older ones. `_versions/<n>.json`
names the parts of every table with their buckets and least and greatest key (observed by the job that writes them), so a lookup
of a few keys opens only files that may have them. A pointer is made last, and only if no other writer made one of that number.

A transaction reads one version of all tables and commits its changes of several tables as a whole. If another writer was
faster, it is put on top of the newer version, unless that changed a table which the transaction has read: then the commit
fails whole and transact() starts anew. So no writer loses another's changes. Parts never change, so readers of an older
version still see it until expire() removes it; compact() folds a table's parts into a new base. Batches carry an id; one
that was committed isn't applied again.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable
from typing import Any, TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mnemos.schemas import KEYS, TABLES, conform

BUCKETS, MOST_PARTS = 16, 24
#: Keys (of some tens of bytes) that a read may broadcast to leave older rows out; pointers tell how many there are.
BROADCAST_ROWS = 200_000
EXTRA = "_deleted boolean, _part string, _bucket int"
T = TypeVar("T")


class CommitConflict(RuntimeError):
    """Another writer's commit came first."""


class Transaction:
    """Reads of one version, and changes to be committed together."""

    def __init__(self, store: SnapshotStore, version: int | None = None):
        self.store = store
        self.version, self.tables = store.current() if version is None else (version, store.at(version))
        self.seen: set[str] = set()
        self.changes: dict[str, list[DataFrame]] = {}
        self.replaced: set[str] = set()

    def read(self, table: str, keys: Iterable[str] | None = None) -> DataFrame:
        self.seen.add(table)
        return self.store.rows(table, self.tables.get(table, []), keys)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Set rows by the table's key; of a key that comes several times one row is taken."""
        self.changes.setdefault(table, []).append(conform(rows, table).dropDuplicates([KEYS[table]]).withColumn("_deleted", F.lit(False)))

    def delete(self, table: str, keys: DataFrame) -> None:
        """Remove the rows whose keys are in the first column."""
        gone = keys.select(F.col(keys.columns[0]).alias(KEYS[table])).distinct()
        self.changes.setdefault(table, []).append(conform(gone, table).withColumn("_deleted", F.lit(True)))

    def replace(self, table: str, rows: DataFrame) -> None:
        """The whole table anew."""
        self.replaced.add(table)
        self.changes[table] = [conform(rows, table).withColumn("_deleted", F.lit(False))]

    def put(self, table: str, rows: DataFrame) -> None:
        """Make the table what `rows` is, by writing the difference only."""
        before, after = self.read(table), conform(rows, table)
        self.upsert(table, after.exceptAll(before))
        self.delete(table, before.select(KEYS[table]).join(after.select(KEYS[table]), KEYS[table], "left_anti"))

    def commit(self, batch: str | None = None) -> int:
        """The version that has the changes."""
        if batch is not None and self.store.applied(batch):
            return self.store.current()[0]
        parts = {name: [p for p in (self.store.write(name, df) for df in dfs) if p] for name, dfs in self.changes.items()}
        while True:
            now, tables = self.store.current()
            lost = {t for t in self.seen | self.replaced if tables.get(t, []) != self.tables.get(t, [])}
            if lost:
                raise CommitConflict(f"version {now} changed {', '.join(sorted(lost))} after {self.version}")
            if batch is not None and now != self.version and self.store.applied(batch):
                return now
            new = tables | {name: ([] if name in self.replaced else tables.get(name, [])) + own for name, own in parts.items()}
            try:
                return self.store.point(now, batch, new)
            except CommitConflict:
                continue  # look at what the other writer did


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- versions

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _versions(self) -> list[str]:
        system, path = self._fs(f"{self.root}/_versions")
        if not system.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in system.listStatus(path)) if n.endswith(".json"))

    def _pointer(self, name: str) -> dict[str, Any] | None:
        """A pointer's content; None if its writer left it unfinished."""
        system, path = self._fs(f"{self.root}/_versions/{name}")
        stream = system.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def current(self) -> tuple[int, dict[str, list[dict]]]:
        """The newest version and its tables' parts."""
        for name in reversed(self._versions()):
            found = self._pointer(name)
            if found is not None:
                return found["version"], found["tables"]
        return 0, {}

    def at(self, version: int) -> dict[str, list[dict]]:
        """The tables' parts in a version that hasn't expired."""
        name = f"{version:08d}.json"
        found = self._pointer(name) if name in self._versions() else None
        if found is None:
            raise KeyError(version)
        return found["tables"]

    def point(self, base: int, batch: str | None, tables: dict[str, list[dict]]) -> int:
        """Make the pointer that follows version `base`, unless another writer has made it; returns its version."""
        if any(int(n.split(".")[0]) > base and self._pointer(n) is not None for n in self._versions()):
            raise CommitConflict(f"there is a version after {base}")
        version = max([base, *(int(n.split(".")[0]) for n in self._versions())]) + 1
        system, path = self._fs(f"{self.root}/_versions/{version:08d}.json")
        try:
            out = system.create(path, False)
        except Py4JJavaError as error:
            if system.exists(path):
                raise CommitConflict(f"another writer made version {version}") from error
            raise
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "tables": tables}).encode()))
        out.close()
        return version

    def applied(self, batch: str) -> bool:
        """Whether a batch was committed: by a version that is kept, or by one that has expired."""
        names = self._versions()
        kept = self.spark.read.schema("batch string").json([f"{self.root}/_versions/{n}" for n in names]) if names else None
        if kept is not None and not kept.where(F.col("batch") == batch).isEmpty():
            return True
        system, path = self._fs(f"{self.root}/_applied")
        return bool(system.exists(path)) and not self.spark.read.schema("batch string").parquet(f"{self.root}/_applied").where(F.col("batch") == batch).isEmpty()

    # --- parts

    def _bucket(self, key: Column) -> Column:
        return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % self.buckets).cast("int")

    def write(self, table: str, rows: DataFrame) -> dict | None:
        """Write a part (rows with _deleted); returns what pointers say of it, None if it has no rows."""
        key, folder, seen = KEYS[table], f"{table}/_part={uuid.uuid4().hex}", Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        counted.withColumn("_bucket", self._bucket(F.col(key))).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        found = seen.get
        if not found["n"]:
            return None
        system, path = self._fs(f"{self.root}/{folder}")
        names = (s.getPath().getName() for s in system.listStatus(path))
        return {"path": folder, "rows": found["n"], "low": found["low"], "high": found["high"], "buckets": sorted(int(n.partition("=")[2]) for n in names if n.startswith("_bucket="))}

    def rows(self, table: str, parts: list[dict], keys: Iterable[str] | None = None) -> DataFrame:
        """A table's rows out of its parts, oldest first. keys: only rows of these few, out of files that may have them."""
        key, schema = KEYS[table], f"{TABLES[table]}, {EXTRA}"
        only = None
        if keys is not None:
            wanted = {k: zlib.crc32(k.encode()) % self.buckets for k in keys}
            parts = [p for p in parts if any(b in p["buckets"] and (p["low"] or "").encode() <= k.encode() <= (p["high"] or "").encode() for k, b in wanted.items())]
            only = F.col("_bucket").isin(list(set(wanted.values()))) & F.col(key).isin(list(wanted))
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])

        def scan(own: list[dict]) -> DataFrame:
            df = self.spark.read.option("basePath", f"{self.root}/{table}").schema(schema).parquet(*[f"{self.root}/{p['path']}" for p in own])
            return df if only is None else df.where(only)

        def newest(df: DataFrame) -> DataFrame:
            """The row of each key that was written last."""
            order = F.create_map(*[F.lit(x) for i, p in enumerate(parts) for x in (p["path"].partition("=")[2], i)])
            return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), order[F.col("_part")]).alias("row"))

        later = sum(p["rows"] for p in parts[1:])
        if later and parts[0]["rows"] <= 4 * later:
            base = newest(scan(parts)).select("row.*")
        elif later:
            base, last = scan(parts[:1]), newest(scan(parts[1:]))
            keys_ = last.select(F.col("_key").alias(key))
            base = base.join(F.broadcast(keys_) if later <= BROADCAST_ROWS else keys_, key, "left_anti").select(*base.columns).unionByName(last.select("row.*"))
        else:
            base = scan(parts)
        return conform(base.where("NOT _deleted"), table)

    # --- tables

    def read(self, table: str, version: int | None = None, keys: Iterable[str] | None = None) -> DataFrame:
        """The rows of a table, now or in an older version; rows of older schemas get defaults."""
        tables = self.current()[1] if version is None else self.at(version)
        return self.rows(table, tables.get(table, []), keys)

    def transact(self, work: Callable[[Transaction], T], batch: str | None = None, attempts: int = 8) -> T:
        """work(transaction) and its commit, anew from the newest version while other writers are faster; returns work's result."""
        for attempt in range(attempts):
            own = Transaction(self)
            out = work(own)
            try:
                if own.changes:
                    own.commit(batch)
                return out
            except CommitConflict:
                if attempt + 1 == attempts:
                    raise
        raise ValueError("attempts has to be 1 at least")

    def commit(self, changed: dict[str, DataFrame], batch: str | None = None, base: int | None = None) -> int:
        """Whole tables anew; CommitConflict if `base`, the version that they were made from, isn't the newest any more."""
        if batch is not None and self.applied(batch):
            return self.current()[0]
        own = Transaction(self)
        if base is not None and own.version != base:
            raise CommitConflict(f"version {own.version} came after {base}")
        own.seen |= set(own.tables) if base is not None else set()
        for name, df in changed.items():
            own.replace(name, df)
        return own.commit(batch)

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], batch: str | None = None, attempts: int = 8) -> int:
        """Change one table by a function of all its rows; only rows that differ are written."""
        self.transact(lambda own: own.put(table, change(own.read(table))), batch, attempts)
        return self.current()[0]

    def append(self, table: str, rows: DataFrame) -> int:
        return self.upsert(table, rows)

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Set rows by key. Nothing is read, so other writers don't matter."""
        self.transact(lambda own: own.upsert(table, rows))
        return self.current()[0]

    def delete(self, table: str, keys: DataFrame) -> int:
        """Remove rows by key (the first column); returns how many there were."""

        def work(own: Transaction) -> int:
            key = keys.columns[0]
            met = own.read(table).select(F.col(KEYS[table]).alias(key)).join(keys.select(key).distinct(), key, "left_semi")
            own.delete(table, met)
            return met.count()

        return self.transact(work)

    def truncate(self, table: str) -> int:
        """An empty table, as after a change of the vectors' size."""
        return self.commit({table: self.spark.createDataFrame([], TABLES[table])})

    # --- upkeep

    def compact(self, table: str) -> int:
        """Fold a table's parts into one; large buckets come as several files, small ones as one."""

        def work(own: Transaction) -> None:
            rows = own.read(table)
            own.replace(table, rows.withColumn("_b", self._bucket(F.col(KEYS[table]))).hint("rebalance", F.col("_b")).drop("_b"))

        self.transact(work)
        return self.current()[0]

    def maintain(self, most_parts: int = MOST_PARTS) -> list[str]:
        """Compact tables of many parts, or whose later parts have outgrown the base; returns their names."""
        due = [t for t, parts in self.current()[1].items() if len(parts) > most_parts or len(parts) > 1 and sum(p["rows"] for p in parts[1:]) > parts[0]["rows"]]
        for table in due:
            self.compact(table)
        return due

    def expire(self, keep: int = 10, grace_ms: int = 3_600_000) -> int:
        """Remove all but the newest `keep` versions and parts that no version names and that are older than grace_ms.

        Ids of their batches are kept. Returns how many versions went.
        """
        names = self._versions()
        old = names[: max(0, len(names) - keep)]
        pointers = {n: self._pointer(n) for n in names}
        batches = [(p["batch"],) for n in old if (p := pointers[n]) and p["batch"] is not None]
        if batches:
            self.spark.createDataFrame(batches, "batch string").coalesce(1).write.mode("append").parquet(f"{self.root}/_applied")
        for n in old:
            system, path = self._fs(f"{self.root}/_versions/{n}")
            system.delete(path, False)
        named = {part["path"] for n, p in pointers.items() if n not in old and p for parts in p["tables"].values() for part in parts}
        system, root = self._fs(self.root)
        now = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
        for table in TABLES:
            _, folder = self._fs(f"{self.root}/{table}")
            if system.exists(folder):
                for s in system.listStatus(folder):
                    if f"{table}/{s.getPath().getName()}" not in named and now - s.getModificationTime() > grace_ms:
                        system.delete(s.getPath(), True)
        return len(old)


def merge(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base whose key isn't among the changes, and the changes."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)
