"""Joins of panels: by bin, by spine, by circular day of year, by grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import c, week_ending


def join_groups(treated_bins: DataFrame, donor_bins: DataFrame, min_cov: float = 0.70) -> DataFrame:
    """k, unit, v of the donors on the treated unit's observed bins (left equi-join by bin), for donors covered in min_cov of them."""
    keep = treated_bins.where(F.col("n") > 0).select("k")
    n = keep.agg(F.count(F.lit(1)).alias("_n"))
    got = donor_bins.join(F.broadcast(keep), "k").where("v is not null")  # a row a bin
    ok = got.groupBy("unit").agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(n)).where(F.col("_c") >= min_cov * F.col("_n")).select("unit")
    spine = ok.join(F.broadcast(keep))
    return spine.join(got.select("k", "unit", "v"), ["k", "unit"], "left")


def on_weeks(series: DataFrame, start: str | None = None, end: str | None = None, unit: str = "unit", week: str = "week", value: str = "v") -> DataFrame:
    """Every unit on every Sunday between two dates (those of the series if not given)."""
    span = series.agg(F.min(week).alias("_a"), F.max(week).alias("_b"))
    a = week_ending(F.lit(start).cast("date")) if start else F.col("_a")
    b = week_ending(F.lit(end).cast("date")) if end else F.col("_b")
    axis = series.select(unit).distinct().join(F.broadcast(span)).select(unit, F.explode(F.sequence(a, b, F.expr("interval 7 days"))).alias(week))  # one row
    return axis.join(series.select(unit, week, value), [unit, week], "left")


def align(treated: DataFrame, donors: DataFrame, week: str = "week", value: str = "v") -> DataFrame:
    """Donors' rows on the weeks that the treated cohort has, of donors that have them all."""
    axis = treated.where(F.col(value).isNotNull()).select(week)
    n = axis.agg(F.count(F.lit(1)).alias("_n"))
    df = donors.join(F.broadcast(axis), week).where(F.col(value).isNotNull())  # a row a week
    full = df.groupBy("unit").agg(F.count(F.lit(1)).alias("_c")).join(F.broadcast(n)).where("_c = _n").select("unit")
    return df.join(full, "unit", "left_semi")


def pool_pairs(panel: DataFrame, units: DataFrame, unit: str = "unit", k: str = "k", value: str = "v", pre: str = "pre") -> DataFrame:
    """unit, other, rmse: distances over the bins before the event of a bounded set of placebo units to all other units.

    An equi-join by bin with the placebo units' rows (at most 60 units by the bins), aggregated at once.
    """
    a = panel.where(pre).select(F.col(unit).alias("other"), k, F.col(value).alias("_d"))
    b = panel.where(pre).join(F.broadcast(units.select(unit)), unit).select(unit, k, F.col(value).alias("_y"))
    df = a.join(b, k).where(F.col("other") != F.col(unit))
    return df.groupBy(unit, "other").agg(F.sqrt(F.avg(F.pow(F.col("_d") - F.col("_y"), 2))).alias("rmse"))


def seasonal_reference(days: DataFrame, event: str, radius: int = 14, unit: str = "unit", day: str = "d", value: str = "v") -> DataFrame:
    """unit, d, reference: median of the days before the event within radius days of the year, over the year's end.

    A circular range join as an equi-join: each earlier day stands for the 2 radius + 1 days of the year around it.
    """
    df = days.withColumn("doy", F.dayofyear(day))
    pre = df.where((F.col(day) < F.lit(event).cast("date")) & F.col(value).isNotNull())
    around = pre.select(unit, value, F.explode(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda o: F.pmod(F.col("doy") - 1 + o, F.lit(366)) + 1)).alias("doy"))
    ref = around.groupBy(unit, "doy").agg(F.median(value).alias("_r"))
    rest = pre.groupBy(unit).agg(F.median(value).alias("_f"))
    return df.join(ref, [unit, "doy"], "left").join(rest, unit, "left").withColumn("reference", F.coalesce("_r", "_f", F.lit(0.0))).drop("_r", "_f", "doy")


def scored(cases: DataFrame, answers: DataFrame, calls: DataFrame, key: str = "case_id") -> DataFrame:
    """Answers with truth and the tool's call, where all three are."""
    return answers.join(cases.select(key, "truth"), key).join(calls.select(key, "call"), key)


def with_findings(results: DataFrame, findings: DataFrame, key: str = "stratum") -> DataFrame:
    """Results with published findings of the same horizon, and whether a finding lies in the interval: joined after all inference."""
    df = results.join(findings.select(key, F.col("months").alias("_m"), F.col("effect").alias("published"), "study"), key, "left")
    same = F.col("_m") == F.col("post_months")
    return df.withColumn("agreement", F.when(F.col("study").isNull(), "no finding").when(~same, "other horizon").when(F.col("published").between(F.col("lo"), F.col("hi")), "inside").otherwise("outside")).drop("_m")


def painted(pixels: DataFrame, zones: DataFrame, x: str = "x", y: str = "y", finest: float = 60.0, parts: int = 8) -> DataFrame:
    """pixels with zone: that of the largest number among the zones (zone, x0, y0, x1, y1) that hold the pixel's centre.

    Equal rectangles are one. Each has the level of a pyramid of grids by its size, whether it is a parcel or lies over
    everything, and cells of a `parts`-th of its level's width, so that it meets some (parts + 1) squared. What lies over
    a whole cell is one number there, the largest; of the rectangles with a border in the cell only those of larger
    numbers are left, and of those with the same part of the cell one: where zones lie over each other, pixels meet the few
    on top. Only in cells that no zone covers, at the rim, do they meet all that differ. Pixels look their cell up once for each level that zones have. A cell of very many pixels meets few zones,
    and its join is one whose large side Spark can split.
    """
    box = ["x0", "y0", "x1", "y1"]
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(finest))
    leveled = zones.where("x0 < x1 and y0 < y1").groupBy(*box).agg(F.max("zone").alias("zone")).withColumn("_level", F.ceil(F.log2(side / finest) - 1e-9).cast("int"))
    levels = sorted(r["_level"] for r in leveled.select("_level").distinct().collect())  # a number for each doubling of size
    cell = lambda v, level: F.floor(c(v) / (F.lit(finest / parts) * F.pow(F.lit(2.0), level)))
    across = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b)))
    key, ends = ["_level", "_tx", "_ty"], {f"_{v}": cell(v, F.col("_level")) for v in box}
    tiles = leveled.withColumns(ends).select("*", across("_x0", "_x1").alias("_tx")).select("*", across("_y0", "_y1").alias("_ty"))
    # A cell between those of a zone's ends lies within it, whatever the rounding of the division: cells are in the order of places.
    within = (F.col("_x0") < F.col("_tx")) & (F.col("_tx") < F.col("_x1")) & (F.col("_y0") < F.col("_ty")) & (F.col("_ty") < F.col("_y1"))
    # Where a zone's end lies in another cell, the pixels of this one can't tell where.
    part = [F.when(ends_in, F.col(v)).alias(f"_{v}") for v, ends_in in zip(box, [F.col("_x0") == F.col("_tx"), F.col("_y0") == F.col("_ty"), F.col("_x1") == F.col("_tx"), F.col("_y1") == F.col("_ty")], strict=True)]
    parted = tiles.select(*key, "zone", within.alias("_whole"), *part).groupBy(*key, "_whole", *[f"_{v}" for v in box]).agg(F.max("zone").alias("zone"))
    whole = parted.where("_whole").select(*key, F.col("zone").alias("_under"))
    borders = parted.where("not _whole").join(whole, key, "left").where("_under is null or zone > _under").drop("_under", "_whole")
    shown = borders.unionByName(whole.withColumnRenamed("_under", "zone"), allowMissingColumns=True)
    p = pixels.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels or [0]]))).withColumns({"_tx": cell(x, F.col("_level")), "_ty": cell(y, F.col("_level"))})
    free = lambda test, v: F.col(v).isNull() | test
    inside = free(c(x) >= F.col("_x0"), "_x0") & free(c(x) < F.col("_x1"), "_x1") & free(c(y) >= F.col("_y0"), "_y0") & free(c(y) < F.col("_y1"), "_y1")
    hit = p.join(shown, key, "left")
    return hit.groupBy(*pixels.columns).agg(F.coalesce(F.max(F.when(inside, F.col("zone"))), F.lit(0)).alias("zone"))


def on_grid(points: DataFrame, grid: DataFrame, x0: float, y0: float, res: float, value: str = "v") -> DataFrame:
    """grid (row, col, own value) with the nearest points' value where it has none (null or 0): an equi-join by rounded position."""
    p = points.select(F.round((F.col("y") - y0) / res).cast("int").alias("row"), F.round((F.col("x") - x0) / res).cast("int").alias("col"), F.col(value).alias("_v"))
    p = p.groupBy("row", "col").agg(F.max("_v").alias("_v"))
    return grid.join(p, ["row", "col"], "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit(0)), "_v")).drop("_v")


def two_channels(a: DataFrame, b: DataFrame, unit: str = "unit", day: str = "d", value: str = "v") -> DataFrame:
    return a.select(unit, day, F.col(value).alias("a")).join(b.select(unit, day, F.col(value).alias("b")), [unit, day])


def first_of(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a, and of b where a has none of the key."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"), allowMissingColumns=True)
