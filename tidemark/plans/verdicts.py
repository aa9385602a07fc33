"""Whole analyses: land verdicts, air verdicts, field audits, break searches, simulations. Results of kernels: no SQL says them."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AUDIT
from ..functions.scalar import off_season, settled
from ..functions.stats import step_up
from ..operators import decide as D
from ..operators import engine as E
from ..operators import joins as J
from ..operators import timebins as T
from ..operators import topk as K
from ..operators import windows as W
from . import planted as Pl
from .base import EVENT, TREATED, cut, folder, obs, table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def land_verdicts(spark: SparkSession, panels: DataFrame, signal: str = "NDVI", sign: int = -1, k: int = 80, placebos: int = 60, grid: int = 41, scale: float = 1.0) -> DataFrame:
    """panels (verdict, unit, k, v, pre), unit 0 treated -> decided results: tasks, kernel, ranks, rules."""
    fits = E.run(panels, k, 0.05 * scale, placebos, grid)
    r = E.results(fits, panels).withColumns({"signal": F.lit(signal), "expected_sign": F.lit(sign)})
    for c in ("point", "lo", "hi", "pre_rmse", "placebo_pre_rmse_median", "placebo_effect_median"):
        r = r.withColumn(c, F.col(c) / scale)
    return D.land(r)


SCALE, PLANTED = 1e6, -0.15


def nation_panels(spark: SparkSession, sf: str) -> DataFrame:
    """A panel for each nation as the treated one: it is unit 0, the others keep their numbers plus one.

    60-day bins of orders in units of SCALE, small gaps filled. Every third nation, when it is the treated one, falls by
    PLANTED after the invented event. Bins are computed once; a nation's copy of the panel is a join on the list of nations.
    """
    p = cut(T.complete_panel(T.anchored_bins(obs(spark, sf), EVENT, 60), TREATED).select("unit", F.col("k").cast("long").alias("k"), (F.col("v_full") / SCALE).alias("v"), "pre"))
    df = p.join(F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("t"))))  # the registry of nations: a panel for each
    own = F.col("unit") == F.col("t")
    v = F.col("v") + F.when(own & ~F.col("pre") & (F.col("t") % 3 == 0), PLANTED).otherwise(0.0)
    return df.select(F.concat(F.lit("nation-"), F.col("t").cast("string")).alias("verdict"), F.when(own, 0).otherwise(F.col("unit") + 1).cast("long").alias("unit"), "k", v.alias("v"), "pre")


@query
def land_verdict(spark, sf):
    """Nations as units, with an invented event and planted falls: bins, donors, fits, intervals, placebos in space and time, verdict."""
    d = land_verdicts(spark, nation_panels(spark, sf))
    return d.select("verdict", "status", *[settled(c, 4).alias(c) for c in ("point", "lo", "hi", "placebo_p", "pre_rmse")], "n_pre", "n_post", "n_donors")


@query
def ascm_effect_path(spark, sf):
    return E.placebo_band(E.run(nation_panels(spark, sf))).select("verdict", "bin", *[settled(c, 4).alias(c) for c in ("e", "lo", "hi")])


@query
def break_search(spark, sf):
    b = E.breaks(nation_panels(spark, sf))
    return b.select("verdict", "index", "first", "last", settled("stat", 4).alias("stat"), "p", "detected")


@query
def field_audit(spark, sf):
    """Planted fields: monthly composite, gap fill, convex twin, placebo ranks, five states, false-discovery control."""
    a = audit_claims(spark, *Pl.crops(spark, sf))
    return a.select("unit", "role", "status", settled("effect", 4).alias("effect"), settled("p", 4).alias("p"), "onset", "found")


def audit_claims(spark: SparkSession, panel_: DataFrame, units: DataFrame, year: int = 2021) -> DataFrame:
    """One audit for each claimant, the panel's months computed once."""
    m = T.fill_linear(T.month_median(panel_), "month").join(units.select("unit", "claims"), "unit")
    claim = units.where("claims").select(F.col("unit").alias("t"))
    own = m.join(claim, m.unit == claim.t).select(F.col("t").cast("string").alias("verdict"), F.lit(0).cast("long").alias("unit"), "month", "filled")
    pool = m.where(~F.col("claims")).select("unit", "month", "filled").join(F.broadcast(claim)).select(F.col("t").cast("string").alias("verdict"), (F.col("unit") + 1).alias("unit"), "month", "filled")  # donors are each claimant's pool
    long = own.unionByName(pool).select("verdict", "unit", F.unix_date("month").cast("long").alias("k"), F.col("filled").alias("v"), (F.year("month") < year).alias("pre"))
    r = E.audit(long).withColumnRenamed("effect", "path")
    axis = m.select("month").distinct().agg(F.sort_array(F.collect_list("month")).alias("axis"))
    path = r.join(F.broadcast(axis)).select("verdict", F.explode(F.arrays_zip("axis", "path")).alias("x")).select("verdict", F.col("x.axis").alias("month"), F.col("x.path").alias("e"))
    eff = path.where(off_season("month") & (F.year("month") >= year)).groupBy("verdict").agg(F.avg("e").alias("effect"))
    yearly = path.where(off_season("month") & (F.year("month") >= year)).groupBy("verdict", F.year("month").alias("y")).agg(F.avg("e").alias("e"))
    onset = W.first_sustained(yearly.withColumnRenamed("verdict", "unit"), AUDIT["effect"]).withColumnRenamed("unit", "verdict")
    cover = m.where((F.year("month") >= year) & off_season("month")).groupBy(F.col("unit").cast("string").alias("verdict")).agg((F.avg(F.col("observed").cast("double")) >= AUDIT["coverage"]).alias("covered"))
    df = r.join(eff, "verdict").join(cover, "verdict").join(onset, "verdict", "left").join(units.select(F.col("unit").cast("string").alias("verdict"), "unit", "role", "claims"), "verdict")
    df = D.field(df.withColumns({"rmse_max": F.greatest(F.lit(AUDIT["rmse"]), 1.6 * F.col("median_rmse")), "claimed_rate": F.lit(None).cast("double"), "est_rate": F.lit(None).cast("double")}))
    return step_up(df, alpha=0.10)


@query
def air_verdict(spark, sf):
    """Stations on the scatter of line items, a stratum with a planted fall and one without: cohort, donors, conformal interval, cohort placebos, jackknife, lead check, rules."""
    fall = F.when(F.col("treated"), Pl.after(156, -6.0)).otherwise(0.0)
    p = Pl.cases(Pl.stations(spark, sf, 3, 20), [("traffic", 156, fall), ("background", 156, F.lit(0.0))])
    r = D.air(E.air(p, grid=21, cohorts=20))
    return r.select("verdict", "status", *[settled(c, 3).alias(c) for c in ("point", "lo", "hi", "placebo_p")], F.size("reasons").alias("n_reasons"))


@query
def weather_ridge(spark, sf):
    """Daily values of nations as stations, with weather made from the calendar: adjusted series."""
    o = obs(spark, sf).groupBy(F.col("unit").alias("station"), "d").agg((F.avg("v") / 1000).alias("v"))
    doy = F.dayofyear("d")
    w = o.withColumns({"temperature_2m": 10 - 8 * F.cos(2 * 3.141592653589793 * doy / 365), "precipitation": F.pmod(F.xxhash64("d"), F.lit(10)).cast("double"), "wind_u": F.sin(doy / 9.0), "wind_v": F.cos(doy / 7.0), "boundary_layer_height": 500 + 50 * F.sin(doy / 20.0)})
    for c in ("temperature_2m", "precipitation", "wind_u", "wind_v", "boundary_layer_height"):
        ref = J.seasonal_reference(w.select("station", "d", F.col(c).alias("v")), EVENT, unit="station").select("station", "d", F.col("reference").alias(f"ref_{c}"))
        w = w.join(ref, ["station", "d"])
    a = E.weather_adjusted(w, EVENT)
    return a.groupBy("station").agg(F.count("adjusted").alias("n"), settled(F.avg("adjusted"), 3).alias("adjusted"), settled(F.avg("v"), 3).alias("raw"), F.max("alpha").alias("alpha"), F.max("problem").alias("problem"))


@query
def power_grid(spark, sf):
    """Planted steps in panels without any: calls by effect."""
    return power(spark, sf, [0.0, -0.05, -0.10, -0.20], seeds=6)


def power(spark: SparkSession, sf: str, effects: list[float], seeds: int, bins: int = 60, at: int = 44, donors: int = 24) -> DataFrame:
    panel = None
    for i in range(seeds):
        one = Pl.cases(Pl.land(spark, sf, donors, bins, seed=100 + i), [(f"{e}:{i}", at, Pl.own(Pl.after(at, e))) for e in effects])
        panel = one if panel is None else panel.unionByName(one)
    d = land_verdicts(spark, panel, k=20, placebos=20, grid=15)
    return d.groupBy(F.split("verdict", ":")[0].cast("double").alias("effect")).pivot("status", ["REAL", "NOT_REAL", "CANT_TELL"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def calibration_study(spark, sf):
    """Intervals of panels without an effect: how often they hold zero."""
    from ..operators.aggregates import calibration

    panel = None
    for i in range(8):
        one = Pl.cases(Pl.land(spark, sf, 20, 50, seed=200 + i), [(str(i), 36, F.lit(0.0))])
        panel = one if panel is None else panel.unionByName(one)
    fits = E.run(panel, 15, placebos=3, grid=21)
    return calibration(fits.where("kind = 'treated'").select("lo", "hi", F.lit(0.0).alias("truth"), "lam")).select("coverage", settled("half_width", 4).alias("half_width"), "degenerate")


@query
def cohort_groups(spark, sf):
    """Placebo cohorts of three nations for each region: exact-size groups of its own nations."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("of"))

    def each(batches):
        for b in batches:
            rows = [(r, i, [int(of[j]) for j in g]) for r, of in zip(b["n_regionkey"], b["of"], strict=True) for i, g in enumerate(K.exact_groups(len(of), 3, 40, f"region {r}"))]
            yield pd.DataFrame(rows, columns=["region", "i", "members"])

    return n.mapInPandas(each, "region long, i int, members array<long>")


def remaining(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What a resumed batch still has to run."""
    return todo.join(done.select(key), key, "left_anti")


def paired(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Two runs of the same items: confusion of their calls."""
    j = a.select(key, F.col("status").alias("a")).join(b.select(key, F.col("status").alias("b")), key)
    return j.groupBy("a").pivot("b", ["REAL", "NOT_REAL", "CANT_TELL"]).agg(F.count(F.lit(1))).na.fill(0)


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Quantiles of the absolute difference of two tables' values, and the share within 1e-4."""
    d = F.abs(F.col("_a") - F.col("_b"))
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return j.agg(F.percentile(d, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("q"), F.avg((d <= 1e-4).cast("double")).alias("same"), F.count(F.lit(1)).alias("n"))


@query
def red_team(spark, sf):
    """Adversarial panels against the verdict rules."""
    from .attacks import red_team as attack

    return attack(spark, sf, 2)


@query
def stream_tumbling(spark, sf):
    from ..streaming import events as S

    df = S.run_once(S.tumbling(S.events(spark, f"{sf}/event[s].parquet")), f"{folder(spark)}/stream_tumbling-{uuid.uuid4().hex[:12]}")
    return df.select(F.to_date("begin").alias("day"), "event_type", "n", settled("total", 4).alias("total"))


@query
def stream_dedup(spark, sf):
    from ..streaming import events as S

    df = S.run_once(S.first_by_minute(S.events(spark, f"{sf}/event[s].parquet")), f"{folder(spark)}/stream_dedup-{uuid.uuid4().hex[:12]}")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_sessions(spark, sf):
    from ..streaming import events as S

    return S.run_once(S.sessions(S.events(spark, f"{sf}/event[s].parquet")), f"{folder(spark)}/stream_sessions-{uuid.uuid4().hex[:12]}").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


# A session is closed once it ended before the watermark, a day behind the last event.
SQL["stream_sessions"] = """WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts FROM events), g AS (SELECT *, coalesce(ts > lag(ts) OVER o + INTERVAL 30 MINUTE, true)::INT AS new FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g), c AS (SELECT user_id, nth, count(*) AS n, max(ts) AS last FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM c WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM e) GROUP BY 1"""
SQL["stream_dedup"] = "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) AS m FROM events) GROUP BY 1"
SQL["stream_tumbling"] = "WITH d AS (SELECT ts::DATE AS day, event_type, count(*) AS n, round(cast(sum(value) AS DECIMAL(38,10)), 4)::DOUBLE AS total FROM events GROUP BY 1, 2) SELECT * FROM d WHERE day + 1 <= (SELECT max(ts)::TIMESTAMP - INTERVAL 1 DAY FROM events)"


@query
def source_rows(spark, sf):
    """Rows of every driver table."""
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = table(spark, sf, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


SQL["source_rows"] = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
