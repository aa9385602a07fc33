"""Aggregations: zones, cohorts, receipts, rates, phenology, portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hazard, or_zero, survival
from ..functions.stats import wilson


def zone_means(pixels: DataFrame, by: list[str], value: str = "v", clear: str = "clear") -> DataFrame:
    """by, mean over clear pixels (null if there is none), clear and all pixels, clear share; zone 0 is outside."""
    df = pixels.where(F.col("zone") != 0).groupBy(*by)
    return df.agg(F.avg(F.when(F.col(clear), F.col(value))).alias("mean"), F.count_if(clear).alias("n_clear"), F.count(F.lit(1)).alias("n_all"), F.avg(F.col(clear).cast("double")).alias("clear_share"))


def merge_same_minute(obs: DataFrame, value: str = "v", clear: str = "clear_share", key: str = "scene") -> tuple[DataFrame, DataFrame]:
    """One row of each minute and zone (mean value, best clearness), and receipts for the scenes that were not the best."""
    merged = obs.groupBy("minute", "zone").agg(F.avg(value).alias(value), F.max(clear).alias(clear))
    scene = obs.groupBy("minute", key).agg(F.max(clear).alias(clear))
    r = F.row_number().over(Window.partitionBy("minute").orderBy(F.desc(clear), key))
    return merged, scene.withColumn("_r", r).where("_r > 1").select("minute", key, F.lit("duplicate").alias("reason"))


def median_composite(pixels: DataFrame, value: str = "v") -> DataFrame:
    return pixels.groupBy("row", "col").agg(F.median(value).alias("median"), F.count(value).alias("n"))


def cohort_mean(weekly: DataFrame, event: str, cover: float = 0.80, share: float = 0.80, unit: str = "unit", week: str = "week", value: str = "v") -> DataFrame:
    """week, value, n: mean of a fixed cohort, each member at the cohort's level before the event.

    Members are covered on both sides of it; a week needs the given share of them. The axis is all weeks there are.
    """
    e = F.lit(event).cast("date")
    axis = weekly.select(week).distinct()
    sides = axis.agg(F.count_if(F.col(week) < e).alias("n_pre"), F.count_if(F.col(week) >= e).alias("n_post"))
    g = weekly.groupBy(unit).agg(F.count(F.when(F.col(week) < e, F.col(value))).alias("a"), F.count(F.when(F.col(week) >= e, F.col(value))).alias("b"), F.avg(F.when(F.col(week) < e, F.col(value))).alias("own"))
    fixed = g.join(F.broadcast(sides)).where((F.col("a") >= cover * F.col("n_pre")) & (F.col("b") >= cover * F.col("n_post")))
    level = fixed.agg(F.avg("own").alias("anchor"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * share)).alias("need"))
    df = weekly.join(fixed.select(unit, "own"), unit).groupBy(week).agg(F.avg(F.col(value) - F.col("own")).alias("m"), F.count(value).alias("n"))
    return df.join(F.broadcast(level)).select(week, F.when(F.col("n") >= F.col("need"), F.col("m") + F.col("anchor")).alias(value), "n")


def modal_orbit(obs: DataFrame, orbit: str = "orbit", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Observations of the most frequent orbit (the one seen first among equals), and receipts for the others."""
    best = obs.groupBy(orbit).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("t")).orderBy(F.desc("n"), "t", orbit).limit(1).select(F.col(orbit).alias("_o"))
    df = obs.join(F.broadcast(best))
    return df.where(F.col(orbit) == F.col("_o")).drop("_o"), df.where(~F.col(orbit).eqNullSafe(F.col("_o"))).drop("_o").withColumn("reason", F.lit("orbit"))


def call_rates(calls: DataFrame, truth: str = "truth", call: str = "call") -> DataFrame:
    """truth, outcome, k, n, rate, lo, hi: shares of the three calls among events and controls."""
    names = {"REAL": ("detection", "miss", "cant_tell"), "NOT_REAL": ("false_alarm", "correct", "cant_tell")}
    g = calls.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(call) == s).alias(s) for s in ("REAL", "NOT_REAL", "CANT_TELL")])
    rows = F.explode(F.array(*[F.struct(F.when(F.col(truth) == "REAL", names["REAL"][i]).otherwise(names["NOT_REAL"][i]).alias("outcome"), F.col(s).alias("k")) for i, s in enumerate(("REAL", "NOT_REAL", "CANT_TELL"))]))
    return g.select(truth, "n", rows.alias("x")).select(truth, "x.outcome", "x.k", "n", wilson("x.k", "n").alias("w")).select(truth, "outcome", "k", "n", "w.*")


def rates_by(df: DataFrame, keys: list[str], hit: str) -> DataFrame:
    """dimension, value, k, n, rate, lo, hi: one breakdown for each key, in one pass over the rows (grouping sets)."""
    df.createOrReplaceTempView("_rates_in")
    sets = ", ".join(f"({k})" for k in keys)
    name = "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys) + " END"
    g = df.sparkSession.sql(f"SELECT {name} AS dimension, coalesce({', '.join(f'cast({k} AS string)' for k in keys)}) AS value, count_if({hit}) AS k, count(*) AS n FROM _rates_in GROUP BY GROUPING SETS ({sets})")
    return g.select("dimension", "value", "k", "n", wilson("k", "n").alias("w")).select("dimension", "value", "k", "n", "w.*")


def compact_receipts(receipts: DataFrame, few: int = 3) -> DataFrame:
    """Receipts (reason, sensor, day, detail, scope): few of a kind stay as they are, many become one counted row; a station's own stay."""
    kind = Window.partitionBy("reason", "sensor")
    own = F.coalesce(F.col("scope") == "station", F.lit(False))
    df = receipts.withColumn("_n", F.count(F.lit(1)).over(kind.partitionBy("reason", "sensor", own)))
    stay = own | ((F.col("_n") <= few) & ~F.col("reason").isin("coverage", "invalid"))
    kept = df.where(stay).select("reason", "sensor", "day", "detail", F.lit(1).cast("long").alias("count"))
    many = df.where(~stay).groupBy("reason", "sensor").agg(F.min("day").alias("day"), F.count(F.lit(1)).alias("count"))
    return kept.unionByName(many.select("reason", "sensor", "day", F.concat(F.col("count").cast("string"), F.lit(" observations dropped")).alias("detail"), "count"))


def phenology(obs: DataFrame, share: float = 0.5, unit: str = "unit", day: str = "d", value: str = "v") -> DataFrame:
    """unit, y, sos, pos, eos, length, amplitude: days of year at which values pass a share of the year's amplitude."""
    df = obs.select(unit, F.year(day).alias("y"), F.dayofyear(day).alias("doy"), F.col(value).alias("x")).where("x is not null")
    r = df.groupBy(unit, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).where("n >= 4")
    df = df.join(r, [unit, "y"])
    up = F.col("x") >= F.col("lo") + share * (F.col("hi") - F.col("lo"))
    g = df.groupBy(unit, "y").agg(F.min(F.when(up, F.col("doy"))).alias("sos"), F.min(F.when(F.col("x") == F.col("hi"), F.col("doy"))).alias("pos"), F.max(F.when(up, F.col("doy"))).alias("eos"), (F.max("hi") - F.min("lo")).alias("amplitude"))
    return g.withColumn("length", F.col("eos") - F.col("sos"))


def portfolio(reports: DataFrame, price: float = 50.0, first_year: int = 2021) -> DataFrame:
    """One row of totals over reports (status, central, confidence, claimed_rate, area_ha, reversed, peak_credit, last_year)."""
    ok, rev = F.col("status").isin("VERIFIED", "PARTIAL"), F.coalesce("reversed", F.lit(False))
    z = lambda x: or_zero(x)
    s = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    g = reports.agg(
        F.count(F.lit(1)).alias("n_fields"), s(ok, z("central")).alias("verified"), s(ok & (z("confidence") >= 95), z("central")).alias("verified_at_95"),
        F.count_if(F.col("status") == "REJECTED").alias("fraud_fields"), s(F.col("status") == "REJECTED", z("claimed_rate") * z("area_ha")).alias("fraud_exposure"),
        F.count_if(rev).alias("reversals"), s(rev, z("peak_credit")).alias("at_risk"), F.count_if(ok | rev).alias("ever_verified"),
        F.greatest(F.lit(1.0), F.max("last_year") - first_year + 1).alias("years"),
    )
    rate = F.when(F.col("ever_verified") > 0, F.col("reversals") / F.col("ever_verified")).otherwise(0.0)
    return g.withColumn("fraud_value", F.col("fraud_exposure") * price).withColumn("reversal_rate", rate).withColumn("base_hazard", rate / F.col("years"))


def priced(reports: DataFrame, base: float, price: float = 50.0, horizon: int = 10) -> DataFrame:
    """reports with hazard, survival, loss probability and premium; nothing to insure without verified carbon."""
    on = F.col("status").isin("VERIFIED", "PARTIAL") & (F.col("central") > 0)
    df = reports.withColumn("hazard", hazard(F.lit(base), F.col("yearly"), F.col("reversed"))).withColumn("survival", survival(F.col("hazard"), F.col("reversed"), horizon))
    return df.withColumn("loss", 1 - F.element_at("survival", -1)).withColumn("premium", F.when(on, price * F.col("hazard") * F.col("central")).otherwise(0.0))


def calibration(rows: DataFrame) -> DataFrame:
    """One row over simulated intervals (lo, hi, truth, lam): coverage, half width, intervals without extent, penalties chosen."""
    lam = rows.groupBy("lam").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("lam").cast("string"), "n")))).alias("lambdas"))
    one = rows.agg(F.avg(F.col("truth").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"), F.median((F.col("hi") - F.col("lo")) / 2).alias("half_width"), F.count_if(F.col("lo") == F.col("hi")).alias("degenerate"))
    return one.crossJoin(lam)  # a row by a row


def tallies(sites: DataFrame) -> DataFrame:
    """Hits, misses, false alarms and abstentions over sites (expected, call)."""
    real, said = F.col("expected") == "REAL", F.col("call")
    return sites.agg(F.count_if(real & (said == "REAL")).alias("hit"), F.count_if(real & (said == "NOT_REAL")).alias("missed"), F.count_if(~real & (said == "REAL")).alias("false_alarm"), F.count_if(~real & (said == "NOT_REAL")).alias("correct"), F.count_if(said == "CANT_TELL").alias("cant_tell"))
