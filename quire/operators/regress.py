"""Checksums of produced parts and their comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed

MISSING = "MISSING"
COMPARED = ["archive", "content.xml", "ode.xml"]


def extract(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """(fixture, part, sha256): the whole archive and every required part, `MISSING` if
    absent. archives(fixture, content), entries(fixture, part, content)."""
    need = archives.select("fixture", F.explode(F.array(*[F.lit(p) for p in fixed.CHECKSUM_PARTS])).alias("part"))
    have = entries.select("fixture", "part", F.sha2("content", 256).alias("sha256"))
    parts = need.join(have, ["fixture", "part"], "left").withColumn("sha256", F.coalesce("sha256", F.lit(MISSING)))
    return archives.select("fixture", F.lit("archive").alias("part"), F.sha2("content", 256).alias("sha256")).unionByName(parts)


def diff(generated: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fixture, part, expected, generated): the parts that differ."""
    j = generated.withColumnRenamed("sha256", "generated").join(
        baseline.withColumnRenamed("sha256", "expected"), ["fixture", "part"], "full_outer")
    return j.filter(F.col("part").isin(COMPARED) & ~F.col("generated").eqNullSafe(F.col("expected")))


def verdicts(generated: DataFrame, differences: DataFrame) -> DataFrame:
    """(fixture, passed, n_differences)."""
    n = differences.groupBy("fixture").agg(F.count("*").alias("n"))
    f = generated.select("fixture").distinct().join(n, "fixture", "full_outer")
    return f.select("fixture", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).alias("n_differences"))


def report(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
