"""The theme catalogue file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.catalogue import parse_catalogue


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue rows of a JSON file; a missing or unreadable file has none."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException:
        texts = spark.createDataFrame([], "value string")
    return parse_catalogue(texts)
