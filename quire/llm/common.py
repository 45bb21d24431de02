"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = b" \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark)}/quire-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again: later jobs start there, whatever is lost."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's digits, modulo parts; a row without id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, limit: int) -> DataFrame:
    """The ids and texts of docs to fit on, with their 0/1 label as _label and a fixed order as _order: at most `limit` labelled ids outside
    the held-out fold, in the order of a hash. The ids are that bounded list, so the documents are not shuffled."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).select("*", F.xxhash64("doc_id").alias("_order"))
    return docs.select("doc_id", "text").join(F.broadcast(known.orderBy("_order", "doc_id").limit(limit)), "doc_id")


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """fn over the batches of a task, after which the worker gives back the memory it has freed: workers outlive their tasks, and idle
    ones would hold it beside the next stage's."""
    @wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def map_columns(df: DataFrame, made: list[tuple[str, str]], fn, keep: list[str] | None = None, need: list[str] | None = None) -> DataFrame:
    """Adds columns that `fn(batch) -> list of arrays` makes from each Arrow batch. An input column of the same name is replaced.
    keep: the input columns that stay (all); need: those that fn reads besides."""
    names = [n for n, _ in made]
    stay = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType(stay + [T.StructField(n, T._parse_datatype_string(t)) for n, t in made])
    kept = [f.name for f in stay]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in kept] + list(fn(b)), names=kept + names)

    read = list(dict.fromkeys([*kept, *(["text"] if need is None else need)]))
    return df.select(*[F.col(f"`{n}`") for n in read]).mapInArrow(run, schema)
