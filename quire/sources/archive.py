"""Archives as tables: one row per entry.

The only Python in the readers: listing and inflating entries is what no built-in does.
Each archive is read by the task that holds its row; the wanted entry names are an
argument, so unwanted entries are never inflated.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

ENTRY = "path string, entry string, entry_ord int, content binary, error string"
NO_ARCHIVE, NO_ENTRY = "not an archive", "unreadable entry"


def _reader(wanted: str | None, flush_bytes: int = 2 << 20):
    pattern = re.compile(wanted) if wanted else None

    def read(batches):
        import pyarrow as pa
        kinds = {"path": pa.string(), "entry": pa.string(), "entry_ord": pa.int32(), "content": pa.binary(), "error": pa.string()}
        made = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path = path.as_py()
                try:
                    z = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, NO_ARCHIVE))
                    continue
                with z:
                    for n, info in enumerate(z.infolist()):
                        if pattern and not pattern.search(info.filename):
                            continue
                        try:
                            data, error = z.read(info), None
                        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
                            data, error = None, NO_ENTRY
                        rows.append((path, info.filename, n, data, error))
                        held += len(data or b"")
                        # what is held is a few megabytes, never a whole archive
                        if held >= flush_bytes or len(rows) >= 10_000:
                            yield made(rows)
                            rows, held = [], 0
        if rows:
            yield made(rows)
    return read


def read_entries(archives: DataFrame, wanted: str | None = None) -> DataFrame:
    """(path, entry, entry_ord, content, error) of archives(path, content); `wanted` is a regular
    expression over entry names. A file that is no archive and an entry that cannot be read are
    rows with an error and without content."""
    return archives.select("path", "content").mapInArrow(_reader(wanted), ENTRY)


def entries(archives: DataFrame, wanted: str | None = None) -> DataFrame:
    """(path, entry, entry_ord, content): the readable entries alone; `failures` has the others."""
    return read_entries(archives, wanted).filter("error is null").drop("error")


def failures(archives: DataFrame, wanted: str | None = None) -> DataFrame:
    """(path, entry, error): what could not be read; entry is null where the whole file could not."""
    return read_entries(archives, wanted).filter("error is not null").select("path", "entry", "error")


def read_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def text_entries(archives: DataFrame, wanted: str) -> DataFrame:
    e = entries(archives, wanted)
    return e.select("path", "entry", F.decode("content", "UTF-8").alias("xml"))


def unwrap_root(files: DataFrame, key: str = "path", deep: bool = False) -> DataFrame:
    """Strip the top folder all files of an archive share; `deep` repeats it and drops
    folder entries. files(key, entry, …).

    The shared leading folders are one aggregate per archive: the longest common prefix of
    the smallest and the largest name is the common prefix of all of them.
    """
    f = files.filter(~F.col("entry").endswith("/")) if deep else files
    real = f.filter(~F.col("entry").endswith("/"))
    ends = real.groupBy(key).agg(F.min("entry").alias("_lo"), F.max("entry").alias("_hi"),
                                 F.min(F.size(F.split("entry", "/"))).alias("_parts"))
    n = F.size(F.split("_lo", "/"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (
        F.slice(F.split("_lo", "/"), F.lit(1), k) == F.slice(F.split("_hi", "/"), F.lit(1), k)) & (k < F.col("_parts")))
    depth = F.size(same)
    ends = ends.withColumn("_n", depth if deep else F.least(F.lit(1), depth))
    j = f.join(ends.select(key, "_n", "_lo"), key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    cut = F.array_join(F.slice(F.split("entry", "/"), F.col("_n") + 1, F.size(F.split("entry", "/"))), "/")
    root = F.concat(F.get(F.split("_lo", "/"), F.lit(0)), F.lit("/"))
    stays = (F.col("_n") == 0) | (F.col("entry").startswith(root) & (F.col("entry") != root))
    return j.filter(stays).withColumn("entry", cut).drop("_n", "_lo")


def user_files(files: DataFrame) -> DataFrame:
    """Root files an author put in, without the package's own ones."""
    own = F.col("entry").isin(fixed.INTERNAL_FILES) | F.col("entry").endswith(".xml") | F.col("entry").endswith(".xsd")
    return files.filter(~F.col("entry").contains("/") & ~own)


def without_system_files(files: DataFrame) -> DataFrame:
    e = F.col("entry")
    return files.filter(~((e == "__MACOSX") | e.startswith("__MACOSX/") | (e == ".DS_Store") | e.endswith("/.DS_Store")))


def package_status(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, error): why an archive is not a legacy package, null if it is one."""
    has = lambda n: F.max((F.col("entry") == n).cast("int")) == 1
    s = files.groupBy(key).agg(has("contentv3.xml").alias("ok"), has("content.xml").alias("modern"))
    return s.select(key, F.when(F.col("ok"), None).when(F.col("modern"), fixed.ERR_MODERN).otherwise(fixed.ERR_NO_CONTENT).alias("error"))
