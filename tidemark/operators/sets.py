"""Set operations and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import best_per_key


def latest_version(df: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """The row of the largest version (compared as text) of each key."""
    return best_per_key(df, keys, [F.desc(F.col(version).cast("string")), tie])


def keep_last(chunks: list[DataFrame], keys: list[str]) -> DataFrame:
    """The chunks together; of equal keys, the row of the last chunk."""
    df = chunks[0].withColumn("_src", F.lit(0))
    for i, x in enumerate(chunks[1:], 1):
        df = df.unionByName(x.withColumn("_src", F.lit(i)))
    return best_per_key(df, keys, [F.desc("_src")]).drop("_src")


def outside(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Points of a that are not in b."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def merged_draws(draws: list[DataFrame], key: str = "id", seed: str = "seed") -> DataFrame:
    """The draws together; mixed seeds or an id drawn twice raise when the result is used."""
    df = draws[0]
    for x in draws[1:]:
        df = df.unionByName(x)
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    seeds = df.agg(F.countDistinct(seed).alias("seeds"))
    check = bad.crossJoin(seeds).select((F.assert_true(F.col("most") <= 1, "an id was drawn twice").isNull() & F.assert_true(F.col("seeds") <= 1, "draws of several seeds").isNull()).alias("ok"))  # a row by a row
    return df.join(F.broadcast(check)).where("ok").drop("ok")


def split_claims(units: DataFrame, flag: str = "claims") -> tuple[DataFrame, DataFrame]:
    """Units that claim, and donors."""
    return units.where(F.coalesce(F.col(flag), F.lit(False))), units.where(~F.coalesce(F.col(flag), F.lit(False)))
