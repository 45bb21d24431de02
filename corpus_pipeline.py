"""The corpus pipeline: quality, line dedup, near-dedup, decontamination and packing, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`, with n_chars
following the text. Between stages the rows are written as Parquet in the shared folder and read again.

Defined cases, for every stage: columns besides those of `documents` are ignored, whatever their names; an empty table gives an empty one;
rows that repeat, ids included, are judged each, but for `near` and `lines`, which go by id as said there; nulls and empty or very long
texts are said with the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, linededup, neardup, packing, rules
from quire.llm.common import learning_sample, stored
from quire.llm.queries import word_bpe
from quire.session import tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: the tail of the pipeline works on tokens and a fitted classifier: not expressible in SQL
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, fitted on the labelled ones outside the held-out fold (crc32 mod 3 = 1).
    A null text is judged as an empty one; whole texts count; without labels of both kinds the share of good ones decides for all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = rules.fit(learning_sample(docs, labels, "quality", 3, 1, rules.SAMPLE))
    return rules.score(docs, model).where(F.col("predicted") == 1).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay in one of them. A null text has no lines to lose and stays null with its n_chars; rows of one
    id are one document to the counts, and each loses the lines its id loses."""
    held = docs.select(*COLUMNS, F.col("text").isNull().alias("no_text"))
    kept = linededup.apply(held, linededup.build(docs))
    text, n_chars = F.when(~F.col("no_text"), F.col("text")), F.when(F.col("no_text"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return kept.withColumn("n_chars", n_chars).withColumn("text", text).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Documents without id stay, as do those without
    words; rows of one id are one document, kept or gone together."""
    gone = neardup.group(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(stored(gone, "near-duplicates"), "doc_id", "left_anti").select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows. Texts without words, null ones included,
    stay; without benchmark items all stay."""
    found = decontam.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences. A null or empty text is its end id alone; a very long one is cut into many pieces."""
    return packing.pack(docs, word_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
