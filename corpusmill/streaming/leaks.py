"""Leakage checks and rates on streams of texts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import leakage


def leaks(stream: DataFrame, hashes: DataFrame) -> DataFrame:
    """A stream's texts that are on a static list of kind and h; kind is exact, or norm where exact misses."""
    hashed = leakage.hashed(stream)
    exact = hashes.where("kind = 'exact'").select(F.col("h").alias("text_sha256"), F.lit(True).alias("_e"))
    loose = hashes.where("kind = 'norm'").select(F.col("h").alias("text_norm_sha256"), F.lit(True).alias("_n"))
    both = hashed.join(exact, "text_sha256", "left").join(loose, "text_norm_sha256", "left")
    return both.withColumn("kind", F.when(F.col("_e"), "exact").when(F.col("_n"), "norm")).where("kind is not null").drop("_e", "_n")


def first_seen(stream: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The first of texts of one normalised hash, remembered for as long as rows may be late."""
    return leakage.hashed(stream).withWatermark(time, late).dropDuplicatesWithinWatermark(["text_norm_sha256"])


def rates(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each key in each window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n_rows")).select(F.col("window.start").alias("start"), key, "n_rows")
