"""Strict CSV members of ZIP archives as a Spark data source, read in executors.

Every member that a pattern matches is a partition; a task seeks to it in its archive and streams it, so no archive or member is
ever held whole, on the driver or elsewhere. Members may be gzipped. A header must have each name once and all required
ones; every row must have the header's width; rows, columns and characters are bounded. What breaks a bound fails the read.
"""

from __future__ import annotations

import csv
import fnmatch
import gzip
import io
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Bounds of a member, unless the options say otherwise.
ROWS, COLUMNS, CHARS = 150_000, 64, 64 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def archives(path: str) -> list[str]:
    """The archive, or the folder's archives, in order; paths of the store."""
    from pyarrow import fs

    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [root]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".zip"))


class Member(InputPartition):
    def __init__(self, archive: str, name: str):
        self.archive, self.name = archive, name


class MemberReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]):
        self.columns, self.path, self.match = columns, options["path"], options.get("members", "*.csv*")
        self.archives = options.get("archives", "").split()
        self.rows, self.width, self.chars = int(options.get("rows", ROWS)), int(options.get("columns_most", COLUMNS)), int(options.get("chars", CHARS))

    def partitions(self) -> list[Member]:
        store, found = _store(self.path)[0], []
        for a in self.archives or archives(self.path):
            with store.open_input_file(a) as f, zipfile.ZipFile(f) as z:
                found += [Member(a, n) for n in sorted(z.namelist()) if fnmatch.fnmatch(n, self.match)]
        if not found:
            raise FileNotFoundError(f"no member {self.match} in {self.path}")
        return found

    def read(self, partition: Member) -> Iterator:
        import pyarrow as pa

        where = f"{partition.archive}:{partition.name}"
        names = [*self.columns, "member", "row"]

        def batch(rows):
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], names)

        with _store(self.path)[0].open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as raw:
            binary = gzip.GzipFile(fileobj=raw) if partition.name.endswith(".gz") else raw
            reader = csv.reader(io.TextIOWrapper(binary, "utf-8", newline=""), strict=True)
            header = next(reader, None) or []
            if len(set(header)) != len(header) or not set(self.columns) <= set(header) or len(header) > self.width:
                raise ValueError(f"the header of {where} is not as required")
            place, rows, chars = [header.index(x) for x in self.columns], [], 0
            for n, r in enumerate(reader):
                chars += sum(map(len, r)) + len(r)
                if len(r) != len(header) or n >= self.rows or chars > self.chars:
                    raise ValueError(f"row {n + 1} of {where} is out of bounds")
                rows.append((*(r[i] for i in place), partition.name, str(n)))
                if len(rows) == 5000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)


class Members(DataSource):
    """Format ``members``; options: ``columns`` (a CSV line of the names wanted), ``archives`` (paths of the store, else all of the
    folder), ``members`` (pattern), ``rows``, ``columns_most``, ``chars``."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def _columns(self) -> list[str]:
        return next(csv.reader([self.options["columns"]]))

    def schema(self) -> StructType:
        return StructType([StructField(x, StringType()) for x in [*self._columns(), "member", "row"]])

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self._columns(), {**self.options})


def read_members(spark: SparkSession, path: str, columns: list[str], members: str = "*.csv*", rows: int = ROWS, chars: int = CHARS, only: list[str] | None = None) -> DataFrame:
    """The columns of all members as strings, with ``member`` and ``row`` (from 0, as text); ``only``: of these archives."""
    spark.dataSource.register(Members)
    line = io.StringIO()
    csv.writer(line).writerow(columns)
    return spark.read.format("members").option("columns", line.getvalue().strip("\r\n")).option("members", members).option("rows", rows).option("chars", chars).option("archives", " ".join(only or [])).load(path)


def write_members(df: DataFrame, folder: str, name: str, rows: int = ROWS, zipped: bool = False) -> DataFrame:
    """Write rows as strings into one archive a task, in members of so many rows each; the manifest (archive, rows), whose
    archives are the ones to read."""
    columns = df.columns

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        path, total, held = f"{root}/{name}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zip", 0, []
        with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

            def close(rows_):
                text = io.StringIO()
                csv.writer(text).writerows([columns, *rows_])
                data, at = text.getvalue().encode(), f"{name}-{total // rows:05d}.csv"
                z.writestr(at + (".gz" if zipped else ""), gzip.compress(data) if zipped else data)

            for b in batches:
                for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    held.append(r)
                    if len(held) == rows:
                        close(held)
                        total, held = total + rows, []
            close(held)
            total += len(held)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([total], pa.int64())], ["archive", "rows"])

    return df.select(*[df[x].cast("string").alias(x) for x in columns]).mapInArrow(run, "archive string, rows long")
