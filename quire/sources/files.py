"""Files as tables, both ways: archives read entry by entry, and rows written as files with a commit.

Both are data sources of Spark: it plans the parts, retries them, and calls commit or abort once. Paths may be plain or URIs of any file
system that Arrow opens; executors and driver must share them.
"""

from __future__ import annotations

import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)

from .archive import ENTRY, NO_ARCHIVE, NO_ENTRY

CURRENT = "_current"
FLUSH_BYTES = 2 << 20
#: what damaged archives raise; a failing read of the store is none of these and fails the task, so that Spark tries again
BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, pa.ArrowInvalid)
ENTRY_TYPE = pa.schema([("path", pa.string()), ("entry", pa.string()), ("entry_ord", pa.int32()), ("content", pa.binary()), ("error", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def current(store: fs.FileSystem, base: str) -> str | None:
    """The committed run below a folder, null before the first commit."""
    if store.get_file_info(f"{base}/{CURRENT}").type == fs.FileType.NotFound:
        return None
    with store.open_input_file(f"{base}/{CURRENT}") as f:
        return f.read().decode()


# --- rows to files ------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceArrowWriter):
    """Rows (path, content) as files of a run of their own. The run becomes the folder's content when all tasks are done, by one replaced
    file; until then, and after a failure, the files of the run before are what readers see. A task that runs again writes
    its files over. Runs that are no longer current are removed, stale files with them."""

    def __init__(self, path: str):
        self.path, self.run = path, f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = opened(self.path)
        n, made = 0, set()
        for batch in iterator:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = name.as_py()
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a path below the folder: {name!r}")
                target = f"{base}/{self.run}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(content.as_buffer() or b"")
                store.move(part, target)
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        store.create_dir(f"{base}/{self.run}", recursive=True)
        with store.open_output_stream(f"{base}/{CURRENT}-{self.run}") as f:
            f.write(self.run.encode())
        store.move(f"{base}/{CURRENT}-{self.run}", f"{base}/{CURRENT}")
        for info in store.get_file_info(fs.FileSelector(base)):
            if info.type == fs.FileType.Directory and info.base_name.startswith("run-") and info.base_name != self.run:
                store.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        if store.get_file_info(f"{base}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.run}")


# --- archives to entries ------------------------------------------------------------------------


@dataclass
class Part(InputPartition):
    """Entries first <= n < last of each archive; last None: to the end."""
    archives: list[tuple[str, str, int, int | None]]

    def __init__(self, archives):
        super().__init__(None)
        self.archives = archives


class ArchiveReader(DataSourceReader):
    """Small archives share a part up to `split` bytes and are opened in their task alone; an archive beyond that is cut by its directory into
    ranges of entries of about as many bytes. Conditions on entry names decide before anything is inflated."""

    def __init__(self, path: str, wanted: str | None, split: int):
        self.path, self.split = path, split
        self.wanted = re.compile(wanted) if wanted else None
        self.conditions: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        tests = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in tests and f.attribute == ("entry",):
                self.conditions.append((tests[type(f)], f.value))
            # entries without a name are Spark's to drop, so it tests every condition again
            yield f

    def keeps(self, entry: str) -> bool:
        test = {"is": lambda v: entry == v, "in": lambda v: entry in v, "starts": entry.startswith, "ends": entry.endswith}
        return (not self.wanted or bool(self.wanted.search(entry))) and all(test[kind](value) for kind, value in self.conditions)

    def partitions(self) -> list[Part]:
        store, base = opened(self.path)
        run = current(store, base)
        root = f"{base}/{run}" if run else base
        parts, held, size = [], [], 0
        infos = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in sorted((i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda i: i.path):
            name = info.path[len(root):].lstrip("/")
            if info.size > self.split:
                parts += [Part([(info.path, name, a, b)]) for a, b in self.ranges(store, info.path)]
                continue
            held.append((info.path, name, 0, None))
            size += info.size
            if size >= self.split:
                parts.append(Part(held))
                held, size = [], 0
        return [*parts, Part(held)] if held or not parts else parts

    def ranges(self, store: fs.FileSystem, path: str) -> list[tuple[int, int | None]]:
        try:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                sizes = [i.compress_size if self.keeps(i.filename) else 0 for i in z.infolist()]
        except BROKEN:
            return [(0, None)]
        out, first, size = [], 0, 0
        for n, s in enumerate(sizes):
            size += s
            if size >= self.split:
                out.append((first, n + 1))
                first, size = n + 1, 0
        return [*out, (first, len(sizes))] if first < len(sizes) else out or [(0, None)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY_TYPE, strict=True)], schema=ENTRY_TYPE)

        for path, name, first, last in part.archives:
            for row in self.entries(store, path, name, first, last):
                rows.append(row)
                held += len(row[3] or b"")
                if held >= FLUSH_BYTES or len(rows) >= 10_000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    def entries(self, store, path: str, name: str, first: int, last: int | None) -> Iterator[tuple]:
        try:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for n, info in list(enumerate(z.infolist()))[first:last]:
                    if not self.keeps(info.filename):
                        continue
                    try:
                        yield name, info.filename, n, z.read(info), None
                    except BROKEN:
                        yield name, info.filename, n, None, NO_ENTRY
        except BROKEN:
            yield name, None, None, None, NO_ARCHIVE


class Files(DataSource):
    """Format `quire_files`: write (path, content) as files, read archives as entries."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("wanted"), int(self.options.get("split", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if not overwrite:
            raise ValueError("a folder of files is replaced as a whole: use mode('overwrite')")
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """files(path, content) as the files below a folder, in place of those that were there. Null contents are empty files; of rows with one path
    one is written."""
    files.sparkSession.dataSource.register(Files)
    files.select("path", "content").write.format("quire_files").option("path", path.rstrip("/")).mode("overwrite").save()


def read_archive_files(spark: SparkSession, path: str, wanted: str | None = None, split: int = 64 << 20) -> DataFrame:
    """(path, entry, entry_ord, content, error): the entries of all archives below a folder, `path` from there on. Conditions on `entry`
    reach the reader. What is no archive and entries that cannot be read are rows with an error; an empty or missing folder has none."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Files)
    reader = spark.read.format("quire_files").option("path", path.rstrip("/")).option("split", str(split))
    return (reader.option("wanted", wanted) if wanted else reader).load()
