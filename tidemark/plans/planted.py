"""Panels on the scatter of a given table, with planted changes as expressions: what must not come out as REAL, and what must.

Line items are dealt to the cells (unit, k) of a panel by supplier, part and ship date; the standardised mean of a cell's
prices is its scatter. A panel is a plain shape plus that scatter, so that it is made where the table is, by one
aggregation of it. Cases are (name, first bin after the event, change of the value); one explode makes all their panels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AIR
from .base import cut, table

DAY0, DAYS = "1992-01-01", 2526  # the first ship date and their span


def scatter(spark: SparkSession, sf: str, units: int, bins: int, seed: int = 0) -> DataFrame:
    """unit, k, e for each of units x bins: how far a cell's line items are from the mean, in standard errors; 0 without any."""
    x = table(spark, sf, "lineitem").select(F.pmod(F.xxhash64(F.lit(seed), "l_suppkey", "l_partkey"), F.lit(units)).alias("unit"), F.floor(F.pmod(F.datediff(F.col("l_shipdate").cast("date"), F.lit(DAY0).cast("date")), F.lit(DAYS)) * bins / DAYS).alias("k"), F.col("l_extendedprice").cast("double").alias("x"))
    all_ = x.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))  # one row
    cells = x.join(F.broadcast(all_)).groupBy("unit", "k").agg((F.sum((F.col("x") - F.col("m")) / F.col("s")) / F.sqrt(F.count(F.lit(1)))).alias("e"))
    spine = spark.range(units * bins).select(F.floor(F.col("id") / bins).alias("unit"), (F.col("id") % bins).alias("k"))
    return spine.join(cells, ["unit", "k"], "left").select("unit", "k", F.coalesce("e", F.lit(0.0)).alias("e"))


def tooth(k: Column | str, period: int) -> Column:
    """A season of straight sides, from 0.5 at its start to -0.5 in its middle."""
    return F.abs(F.col(k) % period - period / 2) / (period / 2) - 0.5


def spread(unit: str, by: int, of: int) -> Column:
    """0 to 1, by unit; the middle for unit 0."""
    return F.when(F.col(unit) == 0, 0.5).otherwise(F.col(unit) * by % of / of)


def land(spark: SparkSession, sf: str, donors: int = 60, bins: int = 110, noise: float = 0.02, seed: int = 0) -> DataFrame:
    """unit (0 treated), k, v: units of one season, each with its own level and swing."""
    v = 0.45 + 0.1 * spread("unit", 53, 97) + (0.14 + 0.08 * spread("unit", 37, 101)) * tooth("k", 24) + noise * F.col("e")
    return cut(scatter(spark, sf, donors + 1, bins, seed).select("unit", "k", v.alias("v")))


def cases(base: DataFrame, rows: list[tuple[str, int, Column]]) -> DataFrame:
    """base (unit, k, v ...) once for each case (verdict, first bin after, change), with verdict, pre, and v changed."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("verdict"), F.lit(at).alias("at"), change.cast("double").alias("by")) for n, at, change in rows]))
    df = base.withColumn("_c", each)
    return df.select(F.col("_c.verdict").alias("verdict"), *[c for c in base.columns if c != "v"], (F.col("v") + F.col("_c.by")).alias("v"), (F.col("k") < F.col("_c.at")).alias("pre"))


def after(at: int, size: float) -> Column:
    return F.when(F.col("k") >= at, size).otherwise(0.0)


def own(change: Column) -> Column:
    """The change of the treated unit alone."""
    return F.when(F.col("unit") == 0, change).otherwise(0.0)


def land_attacks(at: int, bins: int) -> dict[str, Column]:
    """Changes that aren't an effect of the event on the treated unit, and three that are or are none."""
    fall = -0.28
    ramp = F.greatest(F.col("k") - at // 2, F.lit(0)) / (bins - at // 2)
    wild = F.pmod(F.xxhash64(F.lit("wild"), "k"), F.lit(2001)) / 1000.0 - 1.0
    late = 0.25 * (tooth("k", 22) - tooth("k", 24))
    return {
        "common_shock": after(at, fall), "pre_trend": own(fall * ramp), "no_fit": own(0.5 * wild), "one_bin": own(F.when(F.col("k") == at, -0.4).otherwise(0.0)), "season_shift": F.when(F.col("k") >= at, late).otherwise(0.0),
        "untouched": F.lit(0.0), "step": own(after(at, fall)), "step_in_shock": own(after(at, fall)) + after(at, fall),
    }


# -- stations -------------------------------------------------------------------------------------


def stations(spark: SparkSession, sf: str, treated: int = 3, donors: int = 24, weeks: int = 170, noise: float = 0.8, seed: int = 1) -> DataFrame:
    """unit, treated, k, v: weekly levels of one season; the first `treated` units are treated."""
    v = 36 + 8 * spread("unit", 29, 31) + 9 * tooth("k", 52) + noise * F.col("e")
    return cut(scatter(spark, sf, treated + donors, weeks, seed).select("unit", (F.col("unit") < treated).alias("treated"), "k", v.alias("v")))


def air_attacks(at: int) -> dict[str, tuple[Column, set[str]]]:
    """Changes of stations, and what may come out of each; a local shock on the date of the event can't be told from it."""
    group = lambda x: F.when(F.col("treated"), x).otherwise(0.0)
    first = lambda x: F.when(F.col("unit") == 0, x).otherwise(0.0)
    gone = F.when((F.col("unit") == 0) & (F.col("k") >= at), F.lit(None).cast("double")).otherwise(0.0)
    sinking = -0.6 * F.greatest(F.col("k") - (at - AIR["lead_weeks"]), F.lit(0))
    unsure = {"NOT_REAL", "CANT_TELL"}
    return {"untouched": (F.lit(0.0), unsure), "fall": (group(after(at, -7.0)), {"REAL", "CANT_TELL"}), "silent": (gone, unsure), "lone": (first(after(at, -21.0)), {"CANT_TELL"}), "sinking": (group(sinking), {"CANT_TELL"}), "shared": (after(at, -7.0), unsure)}


# -- single series --------------------------------------------------------------------------------


def looks(spark: SparkSession, sf: str, units: int, days: int, noise: float = 0.03) -> DataFrame:
    """unit, t, d, e: scatter by day; the third of all days whose hash says so is cloudy and missing."""
    df = scatter(spark, sf, units, days, 3).withColumn("e", F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.col("e"))) * noise)
    return df.where(F.pmod(F.xxhash64("unit", "k"), F.lit(3)) > 0).select(F.col("unit").alias("series"), F.col("k").alias("t"), F.date_add(F.lit("2021-03-01").cast("date"), (F.col("k") * 4).cast("int")).alias("d"), "e")


def spike_losses(spark: SparkSession, sf: str, falls: tuple[float, ...] = (0.15, 0.25, 0.45), at: int = 60, first: int = 6) -> DataFrame:
    """fall, lost, series: how many of the `first` observations after a lasting fall the spike gate takes away, on average."""
    from ..operators import gates as G

    x = looks(spark, sf, 30, 120).withColumn("fall", F.explode(F.array(*[F.lit(f) for f in falls])))
    x = G.despike(x.select(F.concat_ws(":", "fall", "series").alias("unit"), "fall", "t", "d", (0.65 + F.col("e") - F.when(F.col("t") >= at, F.col("fall")).otherwise(0.0)).alias("v")))
    g = x.where(F.col("t") >= at).groupBy("fall", "unit").agg(F.slice(F.sort_array(F.collect_list(F.struct("t", "suspect"))), 1, first).alias("x"))
    return g.groupBy("fall").agg(F.avg(F.size(F.filter("x", lambda s: s["suspect"]))).alias("lost"), F.count(F.lit(1)).alias("series"))


def water_losses(spark: SparkSession, sf: str, spells: tuple[int, ...] = (3, 8, 25), at: int = 60) -> DataFrame:
    """spell (days of water, by fours), without_water, with_water: the share of wet observations that the spike gate takes away."""
    from ..operators import gates as G

    x = looks(spark, sf, 30, 120).withColumn("spell", F.explode(F.array(*[F.lit(s) for s in spells])))
    wet = (F.col("t") >= at) & (F.col("t") < at + F.col("spell"))
    x = x.select(F.concat_ws(":", "spell", "series").alias("unit"), "spell", "t", "d", wet.alias("wet"), (F.when(wet, -0.08).otherwise(0.62) + F.col("e")).alias("v"), (F.when(wet, 0.35).otherwise(-0.4) - F.col("e")).alias("w"))
    lost = G.despike(G.despike(x).withColumnRenamed("suspect", "blind"), water="w").where("wet")
    return lost.groupBy("spell").agg(F.avg(F.col("blind").cast("double")).alias("without_water"), F.avg(F.col("suspect").cast("double")).alias("with_water"))


# -- fields and canopies --------------------------------------------------------------------------


def share(*of) -> Column:
    """0 to 1, by a hash."""
    return F.pmod(F.xxhash64(*[F.lit(x) if isinstance(x, str) and x.startswith("#") else F.col(x) for x in of]), F.lit(1000)) / 1000.0


def roster(spark: SparkSession, sf: str, roles: list[str], first: str, step: int, bins: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """unit, t, d, doy, y, role, e - scatter and a hashed part of it, so that no two units are equal - and units (unit, role)."""
    role = F.element_at(F.array(*[F.lit(r) for r in roles]), (F.col("unit") + 1).cast("int"))
    e = F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.col("e"))) * 0.6 + 2.4 * (share("#noise", "unit", "k") - 0.5)
    x = scatter(spark, sf, len(roles), bins, seed).select("unit", F.col("k").alias("t"), F.date_add(F.lit(first).cast("date"), (F.col("k") * step).cast("int")).alias("d"), role.alias("role"), e.alias("e"))
    units = spark.range(len(roles)).select(F.col("id").alias("unit"), F.element_at(F.array(*[F.lit(r) for r in roles]), (F.col("id") + 1).cast("int")).alias("role"))
    return cut(x.withColumns({"doy": F.dayofyear("d").cast("double"), "y": F.year("d")})), units


def bell(at: float, width: float) -> Column:
    return F.exp(-((F.col("doy") - at) * (F.col("doy") - at)) / (2 * width * width))


def winter() -> Column:
    """How much a winter cover stands: 1 from the autumn on, falling through the spring."""
    return F.when(F.col("doy") >= 290, F.least(F.lit(1.0), (F.col("doy") - 270) / 40)).when(F.col("doy") <= 125, F.greatest(F.lit(0.4), 1 - F.col("doy") / 250)).otherwise(0.0)


def summer() -> Column:
    return 0.17 + 0.04 * share("#level", "unit") + (0.6 + 0.06 * share("#crop", "unit")) * bell(205, 45)


def unless(hidden: Column, v: Column) -> Column:
    return F.when(~hidden, v)


def crops(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Panel (unit, d, v) and units (unit, role, claims, year): claimants who do as they claim, less, nothing, or stop again, and others who claim nothing."""
    roles = ["adopter"] * 6 + ["over"] * 3 + ["weak"] * 2 + ["reverter"] * 2 + ["liar"] * 4 + ["control"] * 20
    x, units = roster(spark, sf, roles, "2019-01-01", 16, 160, 31)
    up = F.when(F.col("role").isin("adopter", "reverter"), 0.2).when(F.col("role") == "over", 0.07).when(F.col("role") == "weak", 0.02).otherwise(0.0)
    on = (F.col("y") >= 2021) & ((F.col("role") != "reverter") | (F.col("y") <= 2023))
    v = summer() + 0.03 * (share("#year", "y") - 0.5) + 0.022 * F.col("e") + F.when(on, up * winter()).otherwise(0.0)
    cloudy = share("#cloud", "unit", "t") < F.when(winter() > 0, 0.35).otherwise(0.15)
    claims = F.col("role") != "control"
    return x.select("unit", "d", unless(cloudy, v).alias("v")), units.select("unit", "role", claims.alias("claims"), F.when(claims, 2021).alias("year"))


def tilled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Panel (channel, unit, d, v) and units: fields with winter cover from 2021, in the optical channel, and without tillage from 2023, in the radar one, among fields without either."""
    x, units = roster(spark, sf, ["both"] * 4 + ["neither"] * 20, "2019-01-01", 16, 160, 32)
    both = F.col("role") == "both"
    green = unless(share("#cloud", "unit", "t") < 0.2, summer() + F.when(both & (F.col("y") >= 2021), 0.24 * winter()).otherwise(0.0) + 0.02 * F.col("e"))
    soil = F.when(both & (F.col("y") >= 2023), 0.09).otherwise(0.09 + 0.5 * (bell(105, 24) + bell(295, 24))) + 0.015 * F.col("e")
    rows = F.explode(F.array(F.struct(F.lit("optical").alias("channel"), green.alias("v")), F.struct(F.lit("radar").alias("channel"), soil.alias("v")))).alias("c")
    return x.select("unit", "d", rows).select("c.channel", "unit", "d", "c.v"), units


def infected(spark: SparkSession, sf: str, lag: int = 3) -> tuple[DataFrame, DataFrame]:
    """Panel (channel, unit, t, d, v) of weeks of one season and units: canopies of which some fail from a week on, red edge first, greenness `lag` weeks later."""
    x, units = roster(spark, sf, ["healthy"] * 20 + [f"week {w}" for w in (14, 16, 18, 20)], "2024-03-01", 7, 33, 33)
    from_ = F.regexp_extract("role", r"(\d+)", 1).try_cast("int")
    grown = F.least(F.lit(1.0), F.col("t") / 9) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (36 - F.col("t")) / 9.0))

    def canopy(top: float, bare: float, late: int) -> Column:
        lost = F.when(from_.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - from_ - late) / 6.0))).otherwise(0.0)
        return (0.14 + (top - 0.14) * grown) * (1 - lost) + bare * lost + 0.01 * F.col("e")

    seen = lambda name, v: F.struct(F.lit(name).alias("channel"), unless(share(f"#{name}", "unit", "t") < 0.1, v).alias("v"))
    rows = F.explode(F.array(seen("rededge", canopy(0.46, 0.15, 0)), seen("green", canopy(0.82, 0.33, lag)))).alias("c")
    return x.select("unit", "t", "d", rows).select("c.channel", "unit", "t", "d", "c.v"), units


def patchy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Panel (unit, d, green, texture) and units: even winter cover, patchy weeds, bare fields."""
    x, units = roster(spark, sf, ["cover"] * 4 + ["weeds"] * 4 + ["bare"] * 16, "2019-01-01", 16, 160, 34)
    by = lambda a, b, c: F.when(F.col("role") == "cover", a).when(F.col("role") == "weeds", b).otherwise(c)
    on = F.when(F.col("y") >= 2021, winter()).otherwise(0.0)
    cloudy = share("#cloud", "unit", "t") < 0.2
    return x.select("unit", "d", unless(cloudy, summer() + by(0.24, 0.20, 0.0) * on + 0.015 * F.col("e")).alias("green"), unless(cloudy, 0.03 + by(0.035, 0.14, 0.03) * on + 0.004 * F.col("e")).alias("texture")), units


def hours(spark: SparkSession, sf: str, fall: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Hours (unit, ts, v) of six stations from 2017 to 2019, driven by the temperature, and their weather by day; station 0 falls on 2019-04-10, station 5 lacks months.

    A day's weather is that of the line items: the scatter of its cell, and a season.
    """
    day = scatter(spark, sf, 1, 1095, 35).select(F.date_add(F.lit("2017-01-01").cast("date"), F.col("k").cast("int")).alias("d"), F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.col("e"))).alias("e"))
    warm = 19 - 16 * F.abs(F.pmod(F.dayofyear("d") + 10, F.lit(365)) - 182.5) / 182.5 + 2 * F.col("e")
    noise = lambda name: 2 * (share(name, "d") - 0.5)
    weather = cut(day.withColumns({"temperature_2m": warm, "precipitation": 5 + 5 * noise("#rain"), "wind_u": 2 * noise("#u"), "wind_v": 2 * noise("#v"), "boundary_layer_height": 500 + 50 * noise("#high")}).drop("e").select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("u")).select(F.col("u").cast("long").alias("unit"), "d", "temperature_2m", "precipitation", "wind_u", "wind_v", "boundary_layer_height"))
    h = weather.select("unit", "d", "temperature_2m", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h")).withColumn("ts", F.col("d").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("h")))
    v = 40 - F.col("temperature_2m") + 2 * (share("#hour", "unit", "ts") - 0.5) - F.when((F.col("unit") == 0) & (F.col("d") >= F.lit("2019-04-10").cast("date")), fall).otherwise(0.0)
    return h.where(~((F.col("unit") == 5) & F.month("d").isin(2, 6, 9))).select("unit", "ts", v.alias("v")), weather
