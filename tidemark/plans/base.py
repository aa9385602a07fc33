"""Relations that the catalogue's queries share, in both dialects: a panel of order values by nation, hours of users, pixel blocks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "1999-01-01"
WIDTH = 90
TREATED = 7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without that setting gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint: several consumers don't compute it again."""
    folder(df.sparkSession)
    return df.checkpoint()


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """unit (nation), d, v of orders."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("v"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("unit"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("unit", "d", "v")


def user_hours(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("ts"), F.col("value").alias("v"))


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    h = user_hours(spark, sf)
    return h.groupBy("unit", F.to_date("ts").alias("d")).agg(F.avg("v").alias("v"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """block, row, col, v: embeddings as blocks of 8 x 8."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("block"), "label", F.posexplode("embedding").alias("pos", "x"))
    return e.select("block", "label", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), F.col("x").cast("double").alias("v"))


def R(x: str, n: int = 6) -> str:
    return f"round(cast({x} AS DECIMAL(38,10)), {n})::DOUBLE"


OBS = "obs AS (SELECT c_nationkey AS unit, o_orderdate::DATE AS d, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey)"
BINS = f"""{OBS},
b0 AS (SELECT unit, floor(date_diff('day', DATE '{EVENT}', d) / {WIDTH}.0)::INT AS k, median(v) AS v, count(v) AS n FROM obs GROUP BY 1, 2),
ks AS (SELECT unnest(range((SELECT min(k) FROM b0)::BIGINT, (SELECT max(k) FROM b0)::BIGINT + 1))::INT AS k),
bins AS (SELECT u.unit, ks.k, b0.v, coalesce(b0.n, 0) AS n, DATE '{EVENT}' + (ks.k * {WIDTH} + {WIDTH // 2})::INT AS mid, (DATE '{EVENT}' + (ks.k * {WIDTH} + {WIDTH // 2})::INT) < DATE '{EVENT}' AS pre
         FROM (SELECT DISTINCT unit FROM b0) u CROSS JOIN ks LEFT JOIN b0 ON b0.unit = u.unit AND b0.k = ks.k)"""
MONTHS = f"""{OBS},
m0 AS (SELECT unit, date_trunc('month', d)::DATE AS month, median(v) AS v FROM obs GROUP BY 1, 2),
ax AS (SELECT unnest(generate_series((SELECT min(month) FROM m0), (SELECT max(month) FROM m0), INTERVAL 1 MONTH))::DATE AS month),
months AS (SELECT u.unit, ax.month, m0.v FROM (SELECT DISTINCT unit FROM m0) u CROSS JOIN ax LEFT JOIN m0 ON m0.unit = u.unit AND m0.month = ax.month)"""
HOURS = "hours AS (SELECT user_id AS unit, ts, value AS v FROM events)"
DAYS = f"{HOURS}, days AS (SELECT unit, ts::DATE AS d, avg(v) AS v FROM hours GROUP BY 1, 2)"
PIX = """px AS (SELECT vec_id AS block, label, ((i - 1) // 8)::INT AS "row", ((i - 1) % 8)::INT AS "col", embedding[i]::DOUBLE AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
