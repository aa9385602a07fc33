"""Sinks: tidy CSV, stages, result documents that are published once (commits), Markdown reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, fixed
from . import commits
from .commits import publish, published  # noqa: F401


def long_csv(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").option("header", True).csv(path)


def stage(df: DataFrame, folder: str, key: str) -> str:
    """Writes a stage below its key, replacing what is there as a whole: readers see the old or the new version."""
    commits.stage(df.sparkSession, f"{folder}/key={key}", uuid.uuid4().hex, lambda: df)
    return key


def documents(runs: DataFrame, key: str = "id") -> DataFrame:
    """key, document: each run as JSON, numbers that are none as null."""
    clean = [finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in runs.dtypes]
    return runs.select(F.col(key).alias("_id"), F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("document")).withColumnRenamed("_id", key)


def cell(x, kind: str = "text") -> Column:
    v = F.col(x) if isinstance(x, str) else x
    out = fixed(v, 3) if kind == "index" else fixed(v, 2) if kind == "db" else v.cast("string")
    return F.coalesce(out, F.lit("n/a"))


def report(runs: DataFrame, receipts: DataFrame, most: int = 100, key: str = "id") -> DataFrame:
    """key, markdown: a run's numbers and its receipts, the first `most` by day."""
    r = receipts.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("day", "reason", "detail"))), 1, most).alias("r"), F.count(F.lit(1)).alias("n"))
    df = runs.join(r, key, "left")
    kind = F.when(F.col("signal").isin("VV", "VH", "RATIO"), "dB").otherwise("")
    num = lambda c: F.when(F.col("signal").isin("VV", "VH", "RATIO"), cell(c, "db")).otherwise(cell(c, "index"))
    lines = F.concat_ws("\n", F.concat(F.lit("# Run "), F.col(key).cast("string")), F.lit(""), F.lit("| | |"), F.lit("|-|-|"),
        F.concat(F.lit("| Verdict | "), cell("status"), F.lit(" |")), F.concat(F.lit("| Effect "), kind, F.lit(" | "), num("point"), F.lit(" |")),
        F.concat(F.lit("| Interval | "), num("lo"), F.lit(" to "), num("hi"), F.lit(" |")), F.concat(F.lit("| Placebo p | "), cell("placebo_p", "db"), F.lit(" |")), F.lit(""), F.lit("## Dropped observations"),
        F.coalesce(F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["day"].cast("string"), F.lit(": "), x["reason"], F.lit(" ("), F.coalesce(x["detail"], F.lit("n/a")), F.lit(")"))), "\n"), F.lit("none")))
    return df.select(key, lines.alias("markdown"))


def summary_table(runs: DataFrame, batch: str = "batch", key: str = "id") -> DataFrame:
    """batch, markdown: a line a run, in order of id."""
    row = F.concat(F.lit("| "), F.col(key).cast("string"), F.lit(" | "), F.coalesce("status", F.lit("n/a")), F.lit(" |"))
    return runs.groupBy(batch).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("r")))), lambda x: x["r"]), "\n").alias("markdown"))


def picture_scenes(scenes: DataFrame, slots: int, start: str, end: str) -> DataFrame:
    """The clearest scene of each of equal slots of time (scene, d, clear)."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    slot = F.least(F.floor(F.datediff("d", a) * slots / F.datediff(b, a)), F.lit(slots - 1)).cast("int")
    return scenes.where(F.col("d").between(a, b)).withColumn("slot", slot).groupBy("slot").agg(F.max_by(F.struct("scene", "d", "clear"), F.struct("clear", F.col("scene"))).alias("x")).select("slot", "x.*")


def nearest_scene(scenes: DataFrame, day: str, after: bool, windows: tuple[int, ...] = (5, 30)) -> DataFrame:
    """The scene nearest to a day on one side of it, within the first window that has any."""
    dist = F.datediff("d", F.lit(day).cast("date")) * (1 if after else -1)
    df = scenes.withColumn("_g", dist).where((F.col("_g") >= 0) & (F.col("_g") <= max(windows)))
    tier = F.coalesce(*[F.when(F.col("_g") <= w, i) for i, w in enumerate(windows)])
    return df.agg(F.min_by(F.struct("scene", "d", "clear"), F.struct(tier, "_g", "scene")).alias("x")).where("x is not null").select("x.*")
