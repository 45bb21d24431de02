"""Queries that run as streams over the files of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import run_issues, run_memory, workspace
from . import corpus as C
from .issue_queries import FULL_SQL
from .registry import query, table
from .table_queries import MEM_SQL


def _stream(spark, sf, name):
    """The files of a table one by one, be it a single file or a folder of them. A pattern that
    only the table's name fits: a plain path would have to be a folder."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/{name}.parque[t]")


@query("stream_issues", C.with_sql(FULL_SQL) + "select doc_id, family, ord, kind, context from all_issues")
def stream_issues(spark, sf):
    docs = C.marked(_stream(spark, sf, "documents")).select("doc_id", "html")
    return run_issues(docs, workspace(spark, "issues")).select("doc_id", "family", "ord", "kind", "context")


@query("stream_structure_memory", MEM_SQL + """select owner, 's' || key as shape, 't' || key as titles, ts as "at" from memory""")
def stream_structure_memory(spark, sf):
    d = _stream(spark, sf, "documents")
    key = "doc_id * doc_id % 61"
    events = d.select("doc_id", F.col("lang").alias("owner"), F.expr(f"'s' || ({key})").alias("shape"), F.expr(f"'t' || ({key})").alias("titles"),
                      F.col("source").alias("tags"), F.array(F.lit(1)).alias("levels"), F.array().cast("array<string>").alias("options"),
                      F.col("doc_id").alias("at"), (F.col("doc_id") % 4 == 1).alias("is_default"))
    return run_memory(events, workspace(spark, "memory"), width=100).select("owner", "shape", "titles", "at")
