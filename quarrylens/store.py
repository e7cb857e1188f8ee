"""Snapshots of the facts: rows in buckets of paths, and a pointer file that says which version holds each bucket.

An index run writes the buckets of the files that it replaces, and no others, as a new version.  The version is complete before the pointer
moves, so a reader sees the old facts or the new ones; the pointer moves only from the one that the writer began with, so no writer's
work is lost.  What no reader needs any more is removed.  Schemas are fixed and versioned; a store of a newer version is refused.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import schema
from quarrylens.extract.stage import ROW, TABLES, extracted, rows_of, table_of
from quarrylens.operators import delta
from quarrylens.sources.facts import Snapshot
from quarrylens.sources.tree import disk_files, read_aliases, read_texts

FACTS = tuple(TABLES)
RETRIES = 40
#: Files of a bucket when the number of buckets is chosen; it is chosen anew once four times as many would be.
BUCKET_FILES = 512
MOST_BUCKETS = 4096
#: Usage files that are merged, and merged ones that are merged once more.
LOOSE, MERGED = 64, 8
#: A version that no pointer ever named, as a lost writer leaves it, is removed after so many seconds.
GRACE_S = 24 * 3600


_COLUMNS = ", ".join(c.strip() for c in ROW.split(",")[1:])


def bucket_of(path: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def buckets_for(files: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-files // BUCKET_FILES)))


class NewerStore(RuntimeError):
    """The store was written by a newer version."""


class Store:
    """A store in a folder that all nodes share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._Path = self._jvm.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._Path(self.path).getFileSystem(self._conf)

    # pointers: numbered files, of which the greatest counts; the next number can be taken once
    def _pointers(self, name: str) -> list[str]:
        stem, _, kind = name.rpartition(".")
        found = self.fs.globStatus(self._Path(f"{self.path}/{stem}.*.{kind}"))
        return sorted(f.getPath().toString() for f in found) if found is not None else []

    def _head(self, name: str) -> tuple[dict | None, int]:
        """What the pointer says, and its number; none and 0 before the first."""
        for _ in range(RETRIES):
            known = self._pointers(name)
            if not known:
                return None, 0
            try:
                stream = self.fs.open(self._Path(known[-1]))
            except Py4JJavaError:  # a later pointer came and this one went
                continue
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return json.loads(text), int(known[-1].rsplit(".", 2)[1])
        raise RuntimeError(f"{name} moves faster than it can be read")

    def _read(self, name: str) -> dict | None:
        return self._head(name)[0]

    def _take(self, part, target) -> bool:
        """Give a complete file a name that nothing has yet; false if something has it."""
        uri = self.fs.getUri()
        if uri.getScheme() == "file":
            try:
                os.link(part.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "Options$Rename"), 1)
        options[0] = getattr(self._jvm, "Options$Rename").NONE
        try:
            self._jvm.FileContext.getFileContext(uri, self._conf).rename(part, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def _write(self, name: str, value: dict, after: int | None = None) -> bool:
        """Move the pointer; with ``after``, only if its number still is that one, else false."""
        self.fs.mkdirs(self._Path(self.path))
        part = self._Path(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        stem, _, kind = name.rpartition(".")
        try:
            for _ in range(RETRIES if after is None else 1):
                before = self._pointers(name)
                number = int(before[-1].rsplit(".", 2)[1]) if before else 0
                if after is not None and number != after:
                    return False
                if self._take(part, self._Path(f"{self.path}/{stem}.{number + 1:020}.{kind}")):
                    for old in before[:-1]:  # the last one stays for readers that have just listed it
                        self.fs.delete(self._Path(old), False)
                    return True
            return False
        finally:
            self.fs.delete(part, False)

    # versions: a folder of rows by fact and bucket; the pointer says which version holds each bucket
    def _checked(self) -> tuple[dict | None, int]:
        head, number = self._head("current.json")
        if head is not None and head["schema_version"] > schema.SCHEMA_VERSION:
            raise NewerStore(f"schema {head['schema_version']} is newer than {schema.SCHEMA_VERSION}")
        return head, number

    def current(self) -> dict | None:
        return self._checked()[0]

    def _rows(self, head: dict, fact: str, buckets: set[int] | None = None) -> DataFrame:
        at = {int(b): held for b, held in head["at"].items() if buckets is None or int(b) in buckets}
        paths = [f"{self.path}/{version}/fact={fact}/bucket={b}" for b, (version, facts) in sorted(at.items()) if fact in facts]
        return self.spark.read.schema(_COLUMNS).parquet(*paths) if paths else self.spark.createDataFrame([], _COLUMNS)

    def _tables(self, head: dict | None) -> dict[str, DataFrame]:
        if head is None or "at" not in head:
            return {n: self.spark.createDataFrame([], schema.TABLES[n]) for n in FACTS}
        made = {n: table_of(self._rows(head, TABLES[n][0]), n) for n in FACTS}
        return {n: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.TABLES[n].fields]) for n, df in made.items()}

    def tables(self) -> dict[str, DataFrame]:
        return self._tables(self.current())

    def _written(self, rows: DataFrame, buckets: int) -> tuple[str, dict[int, list[str]]]:
        """Write rows as a new version; its name, and the facts that each of its buckets holds."""
        version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        tasks = max(1, min(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))))
        placed = rows.withColumn("bucket", bucket_of(F.col("file_path"), buckets)).repartition(tasks, "bucket")
        placed.sortWithinPartitions("fact", "bucket", "file_path", "start_line").write.partitionBy("fact", "bucket").parquet(f"{self.path}/{version}")
        held: dict[int, list[str]] = {}
        for f in self.fs.globStatus(self._Path(f"{self.path}/{version}/fact=*/bucket=*")) or []:
            at = f.getPath()
            held.setdefault(int(at.getName().removeprefix("bucket=")), []).append(at.getParent().getName().removeprefix("fact="))
        return version, held

    def _publish(self, old: dict | None, number: int, rows: DataFrame, buckets: int, touched: set[int] | None, worth=None) -> bool | None:
        """Write the rows of the touched buckets (none: of all), then move the pointer; false if another writer did so first.

        worth(version): whether what was written changes anything; if not, it is dropped, and the answer is none.
        """
        version, held = self._written(rows, buckets)
        if worth is not None and not worth(version):
            self.fs.delete(self._Path(f"{self.path}/{version}"), True)
            return None
        before = (old or {}).get("at", {})
        at = {} if touched is None else {b: v for b, v in before.items() if int(b) not in touched}
        at |= {str(b): [version, sorted(facts)] for b, facts in held.items()}
        left = [[v[0], int(b)] for b, v in before.items() if at.get(b, [None])[0] != v[0]]
        head = {"version": version, "schema_version": schema.SCHEMA_VERSION, "buckets": buckets, "at": at, "retired": left}
        if not self._write("current.json", head, number):
            self.fs.delete(self._Path(f"{self.path}/{version}"), True)
            return False
        self._remove([tuple(r) for r in (old or {}).get("retired", [])], at)
        return True

    def _remove(self, places: list[tuple[str, int]], at: dict) -> None:
        """Delete what the pointer before the last one named and no later one does: readers of the last two find all they need."""
        live = {(v[0], int(b)) for b, v in at.items()}
        versions = {v for v, _ in live}
        for version in {v for v, _ in places} - versions:
            self.fs.delete(self._Path(f"{self.path}/{version}"), True)
        for version, bucket in places:
            if version in versions and (version, bucket) not in live:
                for f in self.fs.globStatus(self._Path(f"{self.path}/{version}/fact=*/bucket={bucket}")) or []:
                    self.fs.delete(f.getPath(), True)

    def vacuum(self, grace_s: float = GRACE_S) -> int:
        """Remove versions that no pointer names and that are older than the grace; how many."""
        head = self.current() or {}
        named = {v[0] for v in head.get("at", {}).values()} | {r[0] for r in head.get("retired", [])}
        old = [f.getPath() for f in self.fs.globStatus(self._Path(f"{self.path}/v-*")) or [] if f.getModificationTime() < (time.time() - grace_s) * 1000]
        gone = [at for at in old if at.getName() not in named]
        for at in gone:
            self.fs.delete(at, True)
        return len(gone)

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Whole tables as the new facts, whatever was there."""
        rows = rows_of(tables)
        for _ in range(RETRIES):
            head, number = self._checked()
            if self._publish(head, number, rows, buckets_for(tables["files"].count()), None):
                return self.current()["version"]
        raise RuntimeError("the store moves faster than it can be written")

    # maintenance
    def index(self, root: str, force: bool = False) -> dict:
        """Bring the facts up to the tree: only new and changed files are read, and only the buckets of replaced files written.

        A writer that another one overtakes begins again from the other's facts.
        """
        began = time.time()
        for _ in range(RETRIES):
            done = self._index_once(root, force)
            if done is not None:
                return done | {"duration_ms": int((time.time() - began) * 1000)}
        raise RuntimeError("the store moves faster than it can be written")

    def _index_once(self, root: str, force: bool) -> dict | None:
        head, number = self._checked()
        deep = self.settings().get("index.nested_keys", "false").lower() == "true"
        disk = disk_files(self.spark, root)
        if head is None or "at" not in head:
            files = disk.count()
            fresh = extracted(read_texts(self.spark, root, disk, ("mtime_ns", "size")), deep)
            return {"indexed": files, "unchanged": 0, "removed": 0} if self._publish(head, number, fresh, buckets_for(files), None) else None
        known = self._tables(head)["files"]
        state = delta.reconcile(disk, known)
        # one row a state and bucket
        counted = state.groupBy("state", bucket_of(F.col("path"), head["buckets"]).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
        n = {k: sum(r.n for r in counted if r.state == k) for k in ("new", "changed", "deleted", "unchanged")}
        indexed = n["new"] + n["changed"] + (n["unchanged"] if force else 0)
        done = {"indexed": indexed, "unchanged": n["unchanged"] if not force else 0, "removed": n["deleted"]}
        if not indexed and not n["deleted"]:
            return done
        touched = {r.bucket for r in counted if r.state != "unchanged" or force}
        buckets = head["buckets"]
        if buckets_for(sum(n.values()) - n["deleted"]) >= 4 * buckets:
            buckets, touched = buckets_for(sum(n.values()) - n["deleted"]), None
        replaced = state.filter(F.lit(force) | (F.col("state") != "unchanged")).select("path")
        fresh = extracted(read_texts(self.spark, root, disk.join(replaced, "path", "left_semi"), ("mtime_ns", "size")), deep)
        old = None
        for fact, _ in TABLES.values():
            rows = self._rows(head, fact, touched).withColumn("fact", F.lit(fact)).select(*fresh.columns)
            old = rows if old is None else old.unionByName(rows)
        rows = old.join(replaced.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*fresh.columns).unionByName(fresh)
        worth = None
        if not n["changed"] and not n["deleted"] and not force:
            # files that cannot be read stay new for ever; they need no new version
            def worth(version: str) -> bool:
                at = f"{self.path}/{version}/fact=file"
                if not self.fs.exists(self._Path(at)):
                    return False
                found = self.spark.read.schema("file_path string").parquet(at)
                return bool(found.join(replaced.withColumnRenamed("path", "file_path"), "file_path", "left_semi").limit(1).count())

        return done if self._publish(head, number, rows, buckets, touched, worth) is not False else None

    def facts(self, root: str | None = None) -> Snapshot:
        """The current facts, with the tree's texts and aliases where a root is given."""
        return Snapshot(self.tables() | {"usage": self.usage()}, read_aliases(root) if root is not None else [], root)

    def size(self) -> int:
        """Bytes of the store, old versions included."""
        at = self._Path(self.path)
        return int(self.fs.getContentSummary(at).getLength()) if self.fs.exists(at) else 0

    # usage: a small file a command, which are merged now and then; a pointer says what was merged and where it is
    def _loose(self, head: dict) -> list[str]:
        gone = set(head["gone"])
        found = [f.getPath() for f in self.fs.globStatus(self._Path(f"{self.path}/usage/*.parquet")) or []]
        return sorted(at.toString() for at in found if at.getName() not in gone)

    def usage(self) -> DataFrame:
        head = self._read("usage.json") or {"base": [], "gone": []}
        paths = self._loose(head) + [f"{self.path}/{b}" for b in head["base"]]
        return self.spark.read.schema(schema.USAGE).parquet(*paths) if paths else self.spark.createDataFrame([], schema.USAGE)

    def record(self, command: str, files: int, n_bytes: int, returned: int, fmt: str, query: str | None = None) -> None:
        row = (time.time_ns(), command, files, n_bytes, n_bytes // 4, returned, fmt, query)
        self.spark.createDataFrame([row], schema.USAGE).coalesce(1).write.mode("append").parquet(f"{self.path}/usage")
        self.compact_usage(LOOSE)

    def compact_usage(self, least: int = 1) -> bool:
        """Merge the small files if there are at least so many; whether it did.  Of two at once one does.

        Merged files stay until the next time, for readers that have just listed them.
        """
        head, number = self._head("usage.json")
        head = head or {"base": [], "gone": []}
        loose = self._loose(head)
        if len(loose) < least:
            return False
        merged = head["base"] if len(head["base"]) >= MERGED else []
        name = f"usage-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        rows = self.spark.read.schema(schema.USAGE).parquet(*loose, *[f"{self.path}/{b}" for b in merged])
        rows.coalesce(1).write.parquet(f"{self.path}/{name}")
        after = {"base": [b for b in head["base"] if b not in merged] + [name], "gone": [at.rsplit("/", 1)[1] for at in loose], "old": merged}
        if not self._write("usage.json", after, number):
            self.fs.delete(self._Path(f"{self.path}/{name}"), True)
            return False
        for at in [f"usage/{f}" for f in head["gone"]] + head.get("old", []):
            self.fs.delete(self._Path(f"{self.path}/{at}"), True)
        return True

    # settings
    def settings(self) -> dict[str, str]:
        return self._read("settings.json") or {}

    def set(self, key: str, value: str | None) -> None:
        """Set a setting, or remove it with None."""
        for _ in range(RETRIES):
            now, number = self._head("settings.json")
            now = {k: v for k, v in (now or {}).items() if k != key} | ({} if value is None else {key: value})
            if self._write("settings.json", now, number):
                return
        raise RuntimeError("the settings move faster than they can be written")
