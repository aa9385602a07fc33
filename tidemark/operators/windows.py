"""Ordered operators: onsets, reversals, steps, prefix sums, nearest in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import carbon


def first_sustained(years: DataFrame, threshold: float, up: bool = True, last_counts: bool = False, unit: str = "unit", year: str = "y", value: str = "e") -> DataFrame:
    """unit, onset: the first year beyond the threshold whose successor is too (last_counts: or that has none)."""
    hit = (F.col(value) >= threshold) if up else (F.col(value) <= threshold)
    nxt = F.lead(hit).over(Window.partitionBy(unit).orderBy(year))
    df = years.withColumn("_ok", hit & F.coalesce(nxt, F.lit(last_counts)))
    return df.groupBy(unit).agg(F.min(F.when(F.col("_ok"), F.col(year))).alias("onset"))


def reversal(years: DataFrame, area_ha, floor: float = 0.03, unit: str = "unit", year: str = "y", value: str = "e") -> DataFrame:
    """A row a unit: peak, its first year, mean of the last two years, detected, reversal year, yearly effects and running credit."""
    w = Window.partitionBy(unit).orderBy(year)
    df = years.withColumn("_c", carbon(value, area_ha, F.col(value) >= floor)["central"]).withColumn("_bank", F.sum("_c").over(w))
    df = df.withColumn("_back", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(year))))
    df = df.withColumn("_peak", F.max(value).over(Window.partitionBy(unit)))
    df = df.withColumn("_py", F.min(F.when(F.col(value) == F.col("_peak"), F.col(year))).over(Window.partitionBy(unit)))
    g = df.groupBy(unit).agg(
        F.max("_peak").alias("peak"), F.max("_py").alias("peak_year"), F.avg(F.when(F.col("_back") <= 2, F.col(value))).alias("recent"), F.max(year).alias("_last"),
        F.min(F.when((F.col(year) > F.col("_py")) & (F.col(value) < floor), F.col(year))).alias("_below"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).alias("e")))), lambda x: x["e"]).alias("yearly"), F.max("_bank").alias("credit"),
    )
    hit = (F.col("peak") >= floor) & (F.col("recent") < floor) & (F.col("recent") < 0.45 * F.col("peak"))
    return g.select(unit, "peak", "peak_year", "recent", hit.alias("detected"), F.when(hit, F.coalesce("_below", "_last")).alias("reversal_year"), "yearly", "credit")


def consecutive(weeks: DataFrame, threshold: float, after: int, unit: str = "unit", axis: str = "t", value: str = "e") -> DataFrame:
    """unit, onset: the first of two rows in a row at or below the threshold, from `after` on."""
    nxt = F.lead(value).over(Window.partitionBy(unit).orderBy(axis))
    hit = (F.col(axis) >= after) & (F.col(value) <= threshold) & (nxt <= threshold)
    return weeks.withColumn("_ok", hit).groupBy(unit).agg(F.min(F.when(F.col("_ok"), F.col(axis))).alias("onset"))


def prefix_sums(grid: DataFrame, block: str = "block", row: str = "row", col: str = "col", value: str = "v") -> DataFrame:
    """grid with area_sum: the sum of all cells above and to the left, the cell included."""
    df = grid.withColumn("_r", F.sum(value).over(Window.partitionBy(block, row).orderBy(col)))
    return df.withColumn("area_sum", F.sum("_r").over(Window.partitionBy(block, col).orderBy(row))).drop("_r")


def as_of(events: DataFrame, lookups: DataFrame, key: str = "key", ts: str = "ts", value: str = "x", within_s: int | None = None, slot_s: int = 7 * 86400) -> DataFrame:
    """events (id, key, ts) with at and the value of the last lookup (id, key, ts, value) at or before them.

    Both sides are sorted together by time within slots of a key, so that a key with a third of all rows is many tasks;
    no pairs are made. What a slot starts with is the last lookup of the key's earlier slots, a row a slot. Ties take the
    lookup of the largest id; without key or time nothing is found.
    """
    slot = F.floor(F.col(ts).cast("timestamp").cast("long") / slot_s).alias("_slot")
    known = lookups.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    side = known.select(F.col(key), F.col(ts), slot, F.lit(0).alias("_side"), F.lit(None).cast(dict(events.dtypes)["id"]).alias("id"), F.struct(F.col(ts).alias("at"), F.col("id").alias("lookup_id"), F.col(value).alias(value)).alias("_l"))
    mine = events.select(F.col(key), F.col(ts), slot, F.lit(1).alias("_side"), "id", F.lit(None).cast(side.schema["_l"].dataType).alias("_l"))
    both = side.unionByName(mine)
    last = F.max_by("_l", F.when(F.col("_l").isNotNull(), F.struct("_l.at", "_l.lookup_id")))
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(key, "_slot").agg(last.alias("_m")).select(key, "_slot", F.last("_m", True).over(earlier).alias("_c"))
    w = Window.partitionBy(key, "_slot").orderBy(ts, "_side", F.col("_l")["lookup_id"]).rowsBetween(Window.unboundedPreceding, 0)
    df = both.withColumn("_l", F.last("_l", True).over(w)).where("_side = 1").join(carried, [key, "_slot"], "left").withColumn("_l", F.coalesce("_l", "_c"))
    ok = F.lit(True) if within_s is None else F.col(ts).cast("timestamp").cast("long") - F.col("_l")["at"].cast("timestamp").cast("long") <= within_s
    return df.select("id", key, ts, *[F.when(ok, F.col("_l")[x]).alias(x) for x in ("at", "lookup_id", value)])
