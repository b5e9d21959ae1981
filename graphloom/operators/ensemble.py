"""Two builds of one graph: how stable its paths are, and paths that both agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stability(paths_a: DataFrame, paths_b: DataFrame) -> DataFrame:
    """One row (shared, united, stability) of paths(query_id, labels): shared over united label sequences, summed over the queries; 1 without any."""
    a, b = (p.select("query_id", "labels").distinct() for p in (paths_a, paths_b))
    counts = a.withColumn("_a", F.lit(1)).unionByName(b.withColumn("_a", F.lit(2))).groupBy("query_id", "labels").agg(F.sum("_a").alias("in"))
    sums = counts.agg(F.count_if(F.col("in") == 3).alias("shared"), F.count(F.lit(1)).alias("united"))
    return sums.select("shared", "united", F.when(F.col("united") > 0, F.col("shared") / F.col("united")).otherwise(1.0).alias("stability"))


def agreed_paths(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Of each query the primary's paths whose labels the other build finds too; all of the primary's where it finds none of them."""
    both = primary.join(other.select("query_id", "labels").distinct(), ["query_id", "labels"], "left_semi").select(*primary.columns)
    alone = primary.join(both.select("query_id").distinct(), "query_id", "left_anti").select(*primary.columns)
    return both.unionByName(alone)
