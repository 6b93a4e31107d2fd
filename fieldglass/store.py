"""Shared-folder storage of the core: scratch tables, atomic JSON, verified files, pointers, task results, event lines.

Paths go through Hadoop's file systems, so any store that Spark knows works, and a rename is what commits a file.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import resource
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldglass.sinks import canonical_json, fingerprint

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; in local mode a folder of our own if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="fieldglass-core-"))
    return _OWN[0]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame written to the shared folder and read back: computed once, and there to read again when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(Files(spark).delete, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Files:
    """Whole small files of a store, by Hadoop path."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        store, p = self._at(path)
        return store.exists(p)

    def below(self, path: str) -> list[str]:
        """Names of all files below a folder, relative to it, in order."""
        store, p = self._at(path)
        top, found, every = store.makeQualified(p).toString().rstrip("/"), [], store.listFiles(p, True)
        while every.hasNext():
            found.append(every.next().getPath().toString()[len(top) + 1 :])
        return sorted(found)

    def delete(self, path: str) -> None:
        try:
            store, p = self._at(path)
            store.delete(p, True)
        except Exception:  # the session may be down at exit; the folder is the cluster's to clear then
            pass

    def read(self, path: str) -> bytes:
        store, p = self._at(path)
        with_ = store.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(with_))
        finally:
            with_.close()

    def write(self, path: str, data: bytes) -> None:
        """Written beside the target, which the new file then replaces in one rename: a reader, or a run after a crash, finds the
        old file or the new one, whole. If the rename fails the target is as it was and the new file is gone."""
        jvm = self.spark.sparkContext._jvm
        p = self._at(path)[1]
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        store, t = self._at(temp)
        out = store.create(t, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(option, 1)
        how[0] = option.OVERWRITE
        try:
            context.rename(store.makeQualified(t), store.makeQualified(p), how)
        except Exception as e:
            self.delete(temp)
            raise OSError(f"could not replace {path}") from e


def write_json(spark: SparkSession, path: str, value) -> str:
    """Canonical JSON (sorted keys, no NaN), committed by a rename; the SHA-256 of its bytes."""
    data = (canonical_json(value) + "\n").encode()
    Files(spark).write(path, data)
    return hashlib.sha256(data).hexdigest()


def write_verified(spark: SparkSession, path: str, data: bytes, sha256: str) -> bool:
    """Write bytes of a known digest; False if the file is there already with it, an error if other bytes are."""
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the bytes don't have the stated digest")
    files = Files(spark)
    if files.exists(path):
        if hashlib.sha256(files.read(path)).hexdigest() != sha256:
            raise ValueError(f"{path} holds other bytes")
        return False
    files.write(path, data)
    return True


def point_to(spark: SparkSession, folder: str, key: str) -> None:
    """``latest.json`` of a folder names one of its sub-folders, by a fingerprint."""
    write_json(spark, f"{folder}/latest.json", {"fingerprint": key})


def latest(spark: SparkSession, folder: str) -> str:
    """The sub-folder that ``latest.json`` names: 64 hex digits, and there to read."""
    key = json.loads(Files(spark).read(f"{folder}/latest.json"))["fingerprint"]
    if not (isinstance(key, str) and len(key) == 64 and set(key) <= set("0123456789abcdef")):
        raise ValueError("the pointer isn't a fingerprint")
    if not Files(spark).exists(f"{folder}/{key}"):
        raise FileNotFoundError(f"{folder}/{key}")
    return f"{folder}/{key}"


class EventLog:
    """Events as JSON lines, each committed as it happens: a file an event, named so that names sort by time; stores that can't
    append need nothing else, and a run that breaks off has left what happened before. Threads may share a log."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        self.began, self.lock, self.n, self.run = time.time(), threading.Lock(), 0, uuid.uuid4().hex[:8]

    def emit(self, event: str, **fields) -> dict:
        """Write an event with its time, the seconds since the log began and this process's peak memory in bytes."""
        with self.lock:
            now = time.time()
            memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
            row = {"event": event, "at": round(now, 6), "elapsed": round(now - self.began, 6), "peak_bytes": memory, **fields}
            self.files.write(f"{self.folder}/{int(self.began * 1000):014d}-{self.run}-{self.n:08d}.jsonl", (canonical_json(row) + "\n").encode())
            self.n += 1
            return row

    def table(self) -> DataFrame:
        """All events of the folder so far."""
        return self.spark.read.json(f"{self.folder}/*.jsonl")


class Tasks:
    """Results of named work over declared inputs: a task whose inputs' fingerprint has been committed is read, not run again.

    A result is a table, committed by its manifest, which is written last; a task that broke off has none and runs anew.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        self.log, self.events = EventLog(spark, f"{self.folder}/events"), []

    def run(self, name: str, inputs, work: Callable[[], DataFrame]) -> DataFrame:
        began, key = time.time(), fingerprint({"name": name, "inputs": inputs})
        at = f"{self.folder}/{name}/{key}"
        reused = self.files.exists(f"{at}/manifest.json")
        if not reused:
            df = work()
            df.write.mode("overwrite").parquet(f"{at}/rows")
            write_json(self.spark, f"{at}/manifest.json", {"name": name, "fingerprint": key, "columns": df.dtypes})
            point_to(self.spark, f"{self.folder}/{name}", key)
        self.events.append({"task": name, "fingerprint": key, "reused": reused, "seconds": round(time.time() - began, 3)})
        self.log.emit("task", **self.events[-1])
        return self.spark.read.parquet(f"{at}/rows")

    def write_events(self) -> None:
        """The events so far as JSON lines."""
        lines = "".join(canonical_json(e) + "\n" for e in self.events)
        self.files.write(f"{self.folder}/events.jsonl", lines.encode())
