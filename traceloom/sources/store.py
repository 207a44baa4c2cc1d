"""The record store: append-only Parquet tables of records, children, events and values under one root.

A publication writes its batches into a folder of their own. What is live is said by a manifest, a numbered file that
names the batches and their tables; the newest counts. A publication or a rewrite becomes visible by one new manifest, so
half of one is never read, and what dies before it leaves folders that nothing names. Publishers share the store and a
rewrite has it alone: each holder keeps a lease file on the same file system fresh for as long as it works.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom import schema
from traceloom.operators import lifecycle, lookup
from traceloom.shared import delete_path, materialise

TABLES = {
    "records": schema.RECORDS,
    "record_children": schema.CHILDREN,
    "record_events": schema.RECORD_EVENTS,
    "blobs": schema.BLOBS,
    "runs": schema.RUNS,
    "run_steps": schema.RUN_STEPS,
    "run_events": schema.RUN_EVENTS,
    "overlay_entries": schema.OVERLAYS,
}
BY_RUN = ("runs", "run_steps", "run_events", "overlay_entries")
STALE_SECONDS = 15 * 60


class Files:
    """A folder of small files on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def age(self, name: str) -> float:
        """Seconds since a file was last written or touched; a file that is gone is as old as can be."""
        try:
            return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000
        except Py4JJavaError:
            return float("inf")

    def touch(self, name: str) -> None:
        self.fs.setTimes(self.path(name), int(time.time() * 1000), -1)

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(text.encode())
        out.close()

    def read(self, name: str) -> str:
        source = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename_new(self, old: str, new: str) -> bool:
        """Whether `old` became `new`; not if there was one already."""
        if self.fs.exists(self.path(new)):
            return False
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(new).toUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(self.path(old)), self.fs.makeQualified(self.path(new)), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True


class RecordStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    # Reading.

    def _manifest(self) -> tuple[int, dict[str, list[str]]]:
        """(number of the newest manifest, tables of each live batch)."""
        names = [n for n in self.files.names("manifests") if n.endswith(".json") and n[0] != "."]
        if not names:
            return 0, {}
        return int(names[-1].removesuffix(".json")), json.loads(self.files.read(f"manifests/{names[-1]}"))

    def table(self, name: str) -> DataFrame:
        paths = [f"{self.root}/batches/{b}/{name}" for b, tables in sorted(self._manifest()[1].items()) if name in tables]
        rows = self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])
        return rows.dropDuplicates(["content_hash"]) if name == "blobs" else rows

    def view(self) -> None:
        """All tables as temporary views, for SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    def find(self, where: Column | None = None, overlay: DataFrame | None = None) -> DataFrame:
        """The record each computation's lookup gives, with origin."""
        records = self.table("records")
        found = lookup.find(records, self.table("record_children"), self.table("blobs"), where)
        return lookup.overlaid(found, self.spark.createDataFrame([], "comp_id string, donor_comp_id string, donor_record_id string") if overlay is None else overlay, records)

    def history(self, comp_id: str) -> DataFrame:
        """A computation's records, newest first, errors too."""
        return self.table("records").filter(F.col("comp_id") == comp_id).orderBy(F.desc("record_id"))

    def record(self, record_id: str) -> DataFrame:
        return lookup.with_payload(self.table("records").filter(F.col("record_id") == record_id), self.table("blobs"))

    def record_info(self, record_id: str) -> DataFrame:
        """A record without its payload, which is not read."""
        return lookup.record_info(self.table("records").filter(F.col("record_id") == record_id))

    def traces(self, record_id: str) -> DataFrame:
        """A record's trace events alone, in order."""
        return self.table("record_events").filter((F.col("record_id") == record_id) & (F.col("kind") == "trace")).orderBy("ord")

    def sections(self, name: str) -> DataFrame:
        """section, ord, text: all there is to show of a record, or of a value by its hash."""
        row = lambda section, ord_, text: [F.lit(section).alias("section"), ord_.cast("bigint").alias("ord"), text.alias("text")]
        one, zero = F.to_json(F.struct("*")), F.lit(0)
        record = self.table("records").filter(F.col("record_id") == name)
        mine = lambda t: self.table(t).filter(F.col("record_id") == name)
        blobs = self.table("blobs")
        held = blobs.join(record.select(F.col("result_hash").alias("content_hash")), "content_hash", "left_semi").union(blobs.filter(F.col("content_hash") == name)).dropDuplicates(["content_hash"])
        parts = [
            record.select(*row("record", zero, one)), mine("record_children").select(*row("child", F.col("child_index"), one)),
            mine("record_events").select(*row("event", F.col("ord"), one)), held.select(*row("value", zero, F.col("payload"))),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def runs(self) -> DataFrame:
        return lifecycle.runs_listed(self.table("runs"), self.table("run_steps"))

    def newest_run(self) -> str | None:
        return self.table("runs").agg(F.max_by("run_id", F.struct("started_at", "run_id"))).first()[0]

    def events(self, run_id: str) -> DataFrame:
        """The events of a run, as read_trace() gives them."""
        from traceloom.sources.traces import parsed_events

        return parsed_events(self.table("run_events").filter(F.col("run_id") == run_id))

    # Holding.

    @contextlib.contextmanager
    def _lease(self, mode: str, wait: float) -> Iterator[None]:
        """mode: shared, beside other shared ones, or exclusive, alone. Whoever holds it keeps its file fresh; a stale one is no holder."""
        own, end = f"{mode}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", time.monotonic() + wait
        self.files.write(f"leases/{own}", "")
        stop = threading.Event()

        def renew() -> None:
            while not stop.wait(STALE_SECONDS / 5):
                with contextlib.suppress(Py4JJavaError):
                    self.files.touch(f"leases/{own}")

        keeper = threading.Thread(target=renew, daemon=True)
        keeper.start()
        try:
            while self._in_the_way(own, mode):
                if time.monotonic() > end:
                    raise TimeoutError(f"{self.root} is held")
                time.sleep(0.02)
            yield
        finally:
            stop.set()
            self.files.delete(f"leases/{own}")

    def _in_the_way(self, own: str, mode: str) -> bool:
        """An exclusive lease waits for all that came before it, a shared one for exclusive ones alone."""
        place = own.split("-", 1)[1]
        for name in self.files.names("leases"):
            kind, _, at = name.partition("-")
            if name == own or at > place or mode == "shared" and kind == "shared":
                continue
            if self.files.age(f"leases/{name}") <= STALE_SECONDS:
                return True
            self.files.delete(f"leases/{name}")
        return False

    def shared(self, wait: float = 30.0) -> contextlib.AbstractContextManager[None]:
        return self._lease("shared", wait)

    def exclusive(self, wait: float = 30.0) -> contextlib.AbstractContextManager[None]:
        return self._lease("exclusive", wait)

    # Writing.

    def publish(self, **tables: DataFrame) -> str:
        """Appends rows to tables, all or nothing; the batch's name."""
        with self.shared():
            batch = self._write(tables)
            self._commit(lambda live: live | {batch: list(tables)})
            return batch

    def _write(self, tables: dict[str, DataFrame], whole: bool = False) -> str:
        """whole: the batch will replace all others, so values are written even where another batch has them."""
        batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for name, rows in tables.items():
            fields = self.spark.createDataFrame([], TABLES[name]).schema
            rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
            if name == "blobs":
                rows = rows.dropDuplicates(["content_hash"])
            if name == "blobs" and not whole:
                rows = rows.join(self.table("blobs").select("content_hash"), "content_hash", "left_anti").select(*[f.name for f in fields])
            rows.write.parquet(f"{self.root}/batches/{batch}/{name}")
        return batch

    def _commit(self, change) -> None:
        """Makes a new manifest of the newest one; if another came first, of that."""
        while True:
            number, live = self._manifest()
            draft = f"manifests/.{uuid.uuid4().hex}"
            self.files.write(draft, json.dumps(change(live), sort_keys=True))
            if self.files.rename_new(draft, f"manifests/{number + 1:020d}.json"):
                break
            self.files.delete(draft)
        for n in self.files.names("manifests"):
            if n.endswith(".json") and n[0] != "." and int(n.removesuffix(".json")) < number:
                self.files.delete(f"manifests/{n}")

    def put_rows(self, table: str, rows: list[tuple]) -> str:
        return self.publish(**{table: self.spark.createDataFrame(rows, TABLES[table])})

    # Garbage.

    def _without_runs(self, gone: DataFrame) -> None:
        self._rewrite({t: self.table(t).join(gone, "run_id", "left_anti") for t in BY_RUN})

    def remove_runs(self, before: str, keep_latest: bool = True) -> list[str]:
        """Names of the runs that went, for the caller to list; the removal itself is a join."""
        with self.exclusive():
            gone = materialise(lifecycle.expired(self.runs(), before, keep_latest).select("run_id"), "gone")
            if gone.isEmpty():
                return []
            self._without_runs(gone)
            return sorted(r["run_id"] for r in gone.toLocalIterator())

    def remove_run(self, run_id: str) -> bool:
        """Whether there was such a run, which is gone now."""
        return self._remove(F.col("run_id") == run_id)

    def remove_entry(self, entry: str) -> bool:
        """Removes all runs of an entry, for it to run afresh; whether there was one."""
        return self._remove(F.col("entry") == entry)

    def _remove(self, which: Column) -> bool:
        with self.exclusive():
            gone = materialise(self.table("runs").filter(which).select("run_id"), "gone")
            if gone.isEmpty():
                return False
            self._without_runs(gone)
            return True

    def collect(self) -> DataFrame:
        """Removes what no run reaches; content_hash of the values that went."""
        with self.exclusive():
            live = lifecycle.live_records(self.table("runs"), self.table("run_steps"), self.table("record_children"))
            parts = lifecycle.sweep(self.table("records"), self.table("blobs"), live)
            gone = materialise(parts["removed_blobs"].select("content_hash"), "gone")
            tables = {"records": parts["records"], "blobs": parts["blobs"]}
            for t in ("record_children", "record_events"):
                tables[t] = self.table(t).join(live, "record_id", "left_semi")
            self._rewrite(tables)
            return gone

    def _rewrite(self, changed: dict[str, DataFrame]) -> None:
        """All tables as one new batch in place of the old ones; where it dies between the manifest and the deletions, nothing names what is left."""
        old = self._manifest()[1]
        batch = self._write({t: self.table(t) for t in TABLES} | changed, whole=True)
        self._commit(lambda live: {batch: list(TABLES)})
        for b in old:
            delete_path(self.spark, f"{self.root}/batches/{b}")

    def abandon_stale(self) -> int:
        """Removes batches that no manifest names and that are older than STALE_SECONDS; how many."""
        live = self._manifest()[1]
        stale = [n for n in self.files.names("batches") if n not in live and time.time() - int(n.split("-")[0]) / 1e9 > STALE_SECONDS]
        for n in stale:
            self.files.delete(f"batches/{n}")
        return len(stale)
