"""Binning, resampling and gap repair of long panels (unit, day, value). NaN must have become null before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bin_index, week_ending


def window_bounds(event, post_months: int, years: int = 3, today=None) -> tuple:
    """First and last day of an analysis."""
    e = F.lit(event).cast("date")
    return F.add_months(e, -12 * years), F.least(today if today is not None else F.current_date(), F.add_months(e, post_months))


def anchored_bins(obs: DataFrame, event: str, width: int, unit: str = "unit", day: str = "d", value: str = "v") -> DataFrame:
    """unit, k, value (median), n: event-anchored bins, empty ones of each unit's span included with null and 0."""
    e = F.lit(event).cast("date")
    got = obs.withColumn("k", bin_index(day, e, width)).groupBy(unit, "k").agg(F.median(value).alias(value), F.count(value).alias("n"))
    span = got.agg(F.min("k").alias("a"), F.max("k").alias("b"))
    spine = got.select(unit).distinct().join(F.broadcast(span)).select(unit, F.explode(F.sequence("a", "b")).alias("k"))
    out = spine.join(got, [unit, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("mid", F.date_add(e, F.col("k") * width + width // 2)).withColumn("pre", F.col("mid") < e)


def month_median(obs: DataFrame, unit: str = "unit", day: str = "d", value: str = "v") -> DataFrame:
    """unit, month, value, observed on the full month axis: months without a value are there, unobserved."""
    got = obs.groupBy(unit, F.trunc(day, "MM").alias("month")).agg(F.median(value).alias(value))
    span = got.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    axis = got.select(unit).distinct().join(F.broadcast(span)).select(unit, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return axis.join(got, [unit, "month"], "left").withColumn("observed", F.col(value).isNotNull())


def fill_linear(df: DataFrame, axis: str, unit: str = "unit", value: str = "v", out: str = "filled") -> DataFrame:
    """df with out: linear between known neighbours along axis (a number or date), edges held, 0 for a unit without any."""
    x = F.unix_date(axis) if dict(df.dtypes)[axis] == "date" else F.col(axis)
    known = F.when(F.col(value).isNotNull(), F.struct(x.alias("x"), F.col(value).alias("v")))
    w = Window.partitionBy(unit).orderBy(axis)
    df = df.withColumn("_a", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    inner = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (x - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    return df.withColumn(out, F.coalesce(F.col(value), inner, F.col("_a.v"), F.col("_b.v"), F.lit(0.0))).drop("_a", "_b")


def complete_panel(bins: DataFrame, treated: int, min_cov: float = 0.70, unit: str = "unit", value: str = "v") -> DataFrame:
    """Rows of the bins in which the treated unit was observed; donors covered in min_cov of them; gaps filled by position."""
    kept = bins.where((F.col(unit) == treated) & (F.col("n") > 0)).select("k", F.row_number().over(Window.orderBy("k")).alias("pos"))
    df = bins.join(F.broadcast(kept), "k")  # a row a bin
    cover = df.groupBy(unit).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))
    df = df.join(cover.where((F.col("coverage") >= min_cov) | (F.col(unit) == treated)), unit)
    return fill_linear(df, "pos", unit, value, out=value + "_full")


def daily_mean(hours: DataFrame, min_hours: int = 19, unit: str = "unit", ts: str = "ts", value: str = "v") -> DataFrame:
    """unit, d, value, n, covered: the day's mean, null below min_hours values."""
    got = hours.groupBy(unit, F.to_date(ts).alias("d")).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return got.select(unit, "d", F.when(F.col("n") >= min_hours, F.col("m")).alias(value), "n", (F.col("n") >= min_hours).alias("covered"))


def weekly_mean(days: DataFrame, min_days: int = 4, unit: str = "unit", day: str = "d", value: str = "v") -> DataFrame:
    """unit, week (its Sunday), value, n: the week's mean, null below min_days values."""
    got = days.groupBy(unit, week_ending(day).alias("week")).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return got.select(unit, "week", F.when(F.col("n") >= min_days, F.col("m")).alias(value), "n")


def drop_mixed_week(weeks: DataFrame, event: str, week: str = "week") -> DataFrame:
    """Without the week in which the event falls after its Monday."""
    e = F.lit(event).cast("date")
    return weeks.where(~((F.col(week) >= e) & (F.date_sub(week, 6) < e)))


def repair_single_gap(weeks: DataFrame, unit: str = "unit", week: str = "week", value: str = "v") -> DataFrame:
    """weeks with repaired: a unit's only missing week takes its neighbours' mean if they are 7 days away."""
    w = Window.partitionBy(unit).orderBy(week)
    holes = F.sum(F.col(value).isNull().cast("int")).over(Window.partitionBy(unit))
    before, after = F.lag(F.struct(F.col(week).alias("t"), F.col(value).alias("x"))).over(w), F.lead(F.struct(F.col(week).alias("t"), F.col(value).alias("x"))).over(w)
    near = (F.datediff(F.col(week), before["t"]) == 7) & (F.datediff(after["t"], F.col(week)) == 7)
    return weeks.withColumn("repaired", F.when(F.col(value).isNull() & (holes == 1) & near, (before["x"] + after["x"]) / 2).otherwise(F.col(value)))


def repair_short_runs(days: DataFrame, longest: int = 3, unit: str = "unit", day: str = "d", value: str = "v", side: str | None = None) -> DataFrame:
    """days with repaired: inner runs of up to `longest` missing rows are filled linearly, each side of the event by itself."""
    keys = [unit] + ([side] if side else [])
    w = Window.partitionBy(*keys).orderBy(day)
    pos = F.row_number().over(w)
    gap = F.col(value).isNull()
    df = days.withColumn("_pos", pos).withColumn("_run", F.sum(F.coalesce((gap != F.lag(gap).over(w)).cast("int"), F.lit(0))).over(w))
    df = df.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")))
    known = F.when(~gap, F.struct(F.col("_pos").alias("x"), F.col(value).alias("v")))
    a, b = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_a", a).withColumn("_b", b)
    inner = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_pos") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    return df.withColumn("repaired", F.when(gap & (F.col("_len") <= longest), inner).otherwise(F.col(value))).drop("_pos", "_run", "_len", "_a", "_b")
