"""Streaming scans over signature snapshots that are swapped between micro-batches."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scan
from ..operators.sigset import SignatureSet
from ..sources import container, objects


class Snapshots:
    """The current SignatureSet; a batch that holds an older one keeps it until it is done."""

    def __init__(self, first: SignatureSet):
        self._current, self._lock = first, threading.Lock()

    def current(self) -> SignatureSet:
        return self._current

    def swap(self, new: SignatureSet) -> SignatureSet:
        with self._lock:
            old, self._current = self._current, new
        return old


def scan_stream(stream: DataFrame, snapshots: Snapshots, sink: Callable[[DataFrame, int], None], checkpoint: str, max_bytes: int = objects.MAX_BYTES, **trigger) -> StreamingQuery:
    """Scans a stream of object_id and content; each micro-batch uses the snapshot it finds at its start.

    sink gets the verdicts and the batch number; it should write idempotently by that number."""

    def batch(rows: DataFrame, number: int) -> None:
        sigs = snapshots.current()
        sink(scan.verdict(objects.limited(rows, max_bytes), sigs).withColumn("signature_version", F.lit(sigs.version)), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def lookup_stream(lines: DataFrame, snapshots: Snapshots, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Looks up a stream of text lines (column value)."""

    def batch(rows: DataFrame, number: int) -> None:
        request = rows.select(*[c.alias(n) for n, c in objects.lookup_columns(F.col("value")).items()]).filter("line <> ''")
        sink(scan.digest_lookup(request, snapshots.current()), number)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass(frozen=True)
class Settings:
    db_dir: str = "signatures"
    update_seconds: int = 3600
    max_bytes: int = objects.MAX_BYTES
    unwanted: bool = False
    verify: bool = True
    databases: tuple[str, ...] = ("main", "daily")

    @classmethod
    def from_map(cls, given: dict[str, str]) -> Settings:
        """Settings from text options; unreadable numbers take the default, the interval is at least 30 s."""

        def number(key, default):
            text = given.get(key, "")
            return int(text) if text.isascii() and text.isdigit() else default

        yes = lambda key, default: given[key].lower() in ("1", "true") if key in given else default
        names = tuple(x.strip() for x in given.get("databases", "").split(",") if x.strip())
        return cls(given.get("db_dir", cls.db_dir), max(30, number("update_seconds", cls.update_seconds)), number("max_bytes", cls.max_bytes), yes("unwanted", False), not yes("skip_signature", False), names or cls.databases)


def stale(local: container.Header | None, remote: container.Header | None) -> bool:
    """Whether to fetch: not if the remote header can't be read, nor if the local one is as new and the same."""
    if remote is None:
        return False
    return local is None or not (local.version >= remote.version and local.md5 == remote.md5)


class Publisher:
    """Keeps a directory of containers up to date from `mirrors`, and swaps a new snapshot in if any changed.

    A mirror is a callable (name, header_only) -> bytes. The first that answers is used; a container
    is checked and written under a temporary name, then moved. What changed is loaded even if another
    database failed."""

    def __init__(self, spark: SparkSession, settings: Settings, mirrors: list[Callable[[str, bool], bytes]], load: Callable[[], SignatureSet], snapshots: Snapshots):
        self.spark, self.settings, self.mirrors, self.load, self.snapshots = spark, settings, mirrors, load, snapshots
        self.failures: dict[str, str] = {}
        self.retired: SignatureSet | None = None

    def _fetch(self, name: str, header_only: bool, use):
        for mirror in self.mirrors:
            try:
                return use(mirror(name, header_only))
            except (OSError, container.ContainerError) as e:
                self.failures[name] = str(e)
        return None

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.settings.db_dir)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def local_header(self, name: str) -> container.Header | None:
        fs, path = self._fs()
        at = path(f"{self.settings.db_dir}/{name}.cvd")
        if not fs.exists(at):
            return None
        data = self.spark.read.format("binaryFile").load(f"{self.settings.db_dir}/{name}.cvd").select(F.substring("content", 1, container.HEADER).alias("h")).first()
        try:
            return container.parse_header(bytes(data.h))
        except container.ContainerError:
            return None

    def update(self, name: str) -> bool:
        remote = self._fetch(name, True, container.parse_header)
        if not stale(self.local_header(name), remote):
            return False

        def check(data: bytes) -> bytes:
            container.verify(data, container.parse_header(data), "official" if self.settings.verify else "integrity")
            return data

        data = self._fetch(name, False, check)
        if data is None:
            return False
        fs, path = self._fs()
        to, part = path(f"{self.settings.db_dir}/{name}.cvd"), path(f"{self.settings.db_dir}/{name}.cvd.tmp")
        fs.mkdirs(to.getParent())
        out = fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self._replace(part, to)
        return True

    def _replace(self, part, to) -> None:
        """Moves a file over another in one step, so that there is a container at any time."""
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        how = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        conf = sc._jsc.hadoopConfiguration()
        hadoop.FileContext.getFileContext(part.getFileSystem(conf).getUri(), conf).rename(part, to, how)

    def tick(self) -> bool:
        """One pass; True if a new snapshot was swapped in. The snapshot before the last one is released."""
        self.failures.clear()
        if not any([self.update(name) for name in self.settings.databases]):
            return False
        old, self.retired = self.retired, self.snapshots.swap(self.load())
        if old is not None:
            old.release()
        return True

    def run(self, stop: threading.Event) -> None:
        while not stop.wait(self.settings.update_seconds):
            self.tick()
