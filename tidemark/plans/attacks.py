"""Adversarial panels: what must not come out as REAL, and planted answers that must."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import planted as P
from .verdicts import land_verdicts


def red_team(spark: SparkSession, sf: str, seeds: int = 2, donors: int = 60, bins: int = 110, at: int = 75) -> DataFrame:
    """attack, REAL, NOT_REAL, CANT_TELL over panels dealt with several seeds."""
    made = [P.cases(P.land(spark, sf, donors, bins, seed=s), [(f"{a}:{s}", at, x) for a, x in P.land_attacks(at, bins).items()]) for s in range(seeds)]
    panel = made[0]
    for m in made[1:]:
        panel = panel.unionByName(m)
    d = land_verdicts(spark, panel, placebos=30, grid=21)
    return d.groupBy(F.split("verdict", ":")[0].alias("attack")).pivot("status", ["REAL", "NOT_REAL", "CANT_TELL"]).agg(F.count(F.lit(1))).na.fill(0)


def registry(spark: SparkSession, cases: list[tuple[str, str, str, int, str | None]]) -> tuple[DataFrame, DataFrame]:
    """Registered cases (case_id, event, change, months), and their answers apart, for joining last."""
    df = spark.createDataFrame(cases, "case_id string, event string, change string, months int, answer string")
    return df.drop("answer"), df.select("case_id", "answer")
