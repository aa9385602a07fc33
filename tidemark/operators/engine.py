"""The engine over many verdicts: a task table, one shuffle to the kernel, relational ranks on its results.

Panels are long: (verdict, unit, k, v, pre), unit 0 treated, complete bins only. A task (verdict, kind, j) is one fit;
each task gets its verdict's panel as two arrays, so that tasks of one verdict spread over all executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AIR
from . import kernel as K
from .topk import exact_groups


def matrices(panel: DataFrame) -> DataFrame:
    """verdict, units, pre, m: the panel of each verdict as arrays in order of unit and bin (bounded by its units and bins)."""
    rows = panel.groupBy("verdict", "unit").agg(F.sort_array(F.collect_list(F.struct("k", "v", "pre"))).alias("s"))
    return rows.groupBy("verdict").agg(F.sort_array(F.collect_list(F.struct("unit", F.transform("s", lambda x: x["v"]).alias("v"), F.transform("s", lambda x: x["pre"]).alias("p")))).alias("r")).select(
        "verdict", F.transform("r", lambda x: x["unit"]).alias("units"), F.col("r")[0]["p"].alias("pre"), F.transform("r", lambda x: x["v"]).alias("m"))


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([np.asarray(x, float) for x in row.m]), np.asarray(row.pre, bool), np.asarray(row.units)


FIT = "verdict string, kind string, j long, point double, ratio double, rmse double, lam double, lo double, hi double, p_zero double, boundary_hit boolean, n_donors long, flagged boolean, effect array<double>"


def _row(row, f: K.Fit, pre, n, ci: K.Interval | None = None, flagged: bool | None = None) -> tuple:
    point = float(f.effect[~pre].mean())
    return (row.verdict, row.kind, row.j, point, K.ratio(f.effect, pre), f.rmse, f.lam, ci.lo if ci else None, ci.hi if ci else None, ci.p_zero if ci else None, ci.boundary_hit if ci else None, n, flagged, f.effect.tolist())


def run_task(row, k: int, least: float, grid: int) -> tuple | None:
    """One task: 'treated' (fit and interval), 'space' (unit j in its place, donors chosen anew), 'time' (fake date j), 'plain' (convex only)."""
    m, pre, units = _arrays(row)
    y, pool = m[0], m[1:]
    if row.kind == "space":
        y, pool = pool[row.j], np.delete(pool, row.j, 0)
    if row.kind == "time":
        got = K.fake_dates(y, pool, pre, k, least=least, grid=grid)
        hit = [g for g in got if g["at"] == int(np.flatnonzero(pre)[int(pre.sum() * row.j / 4)])]
        return (row.verdict, row.kind, row.j, hit[0]["effect"], None, None, None, hit[0]["lo"], hit[0]["hi"], None, None, len(pool), hit[0]["flagged"], None) if hit else None
    d = pool[K.nearest(y, pool, pre, k)]
    if len(d) < 3:
        return None
    f = K.augmented(y, d, pre, 0.0 if row.kind == "plain" else None)
    ci = K.interval(y, d, pre, f.lam, float(f.effect[~pre].mean()), f.rmse, grid=grid) if row.kind == "treated" else None
    return _row(row, f, pre, len(d), ci)


CHUNK = 8  # tasks that share a copy of their verdict's arrays


def tasks(panel: DataFrame, placebos: int = 60, fake: int = 3) -> DataFrame:
    """verdict, part, todo (kind, j) with the verdict's arrays: evenly spaced placebo units, fake dates, the treated unit, in chunks."""
    m = matrices(panel)
    n = F.size("units") - 1
    even = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(placebos)) - 1), lambda i: F.when(n <= placebos, i).otherwise(F.bround(i * (n - 1) / (placebos - 1)).cast("int")))
    one = lambda kind: lambda j: F.struct(F.lit(kind).alias("kind"), j.cast("long").alias("j"))
    todo = F.concat(F.array(F.struct(F.lit("treated").alias("kind"), F.lit(0).cast("long").alias("j"))), F.transform(F.sequence(F.lit(1), F.lit(fake)), one("time")), F.transform(even, one("space")))
    m = m.withColumn("todo", todo).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("todo") - 1) / CHUNK).cast("int"))))
    return m.withColumn("todo", F.slice("todo", F.col("part") * CHUNK + 1, CHUNK))


def run(panel: DataFrame, k: int = 80, least: float = 0.05, placebos: int = 60, grid: int = 41) -> DataFrame:
    """A row (FIT) for each task."""
    n = max(1, int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def each(batches):
        for b in batches:
            got = [run_task(r._replace(kind=t["kind"], j=t["j"]), k, least, grid) for r in b.assign(kind="", j=0).itertuples(index=False) for t in r.todo]
            yield pd.DataFrame([r for r in got if r], columns=[x.split()[0] for x in FIT.split(", ")]).astype({"boundary_hit": object, "flagged": object})

    return tasks(panel, placebos).repartition(n, "verdict", "part").mapInPandas(each, FIT)


def _median(a) -> F.Column:
    s, n = F.sort_array(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def results(fits: DataFrame, panel: DataFrame) -> DataFrame:
    """A row a verdict: what the decision rules read, with ranks of the treated unit among its placebos. One aggregation, so that each task is fitted once."""
    of = lambda kind, *cols: F.when(F.col("kind") == kind, F.struct(*cols))
    own = of("treated", "point", "ratio", F.col("rmse").alias("pre_rmse"), "lam", "lo", "hi", "p_zero", "boundary_hit", "n_donors")
    r = fits.groupBy("verdict").agg(F.max(own).alias("t"), F.collect_list(of("space", "ratio", "point", "rmse")).alias("s"), F.sort_array(F.collect_list(of("time", "j", "flagged"))).alias("f")).where("t is not null")
    sign = F.when(F.col("t.point") < 0, -1.0).otherwise(1.0)
    share = lambda hit: (F.size(F.filter("s", hit)) + 1) / (F.size("s") + 1)
    r = r.select(
        "verdict", *[F.col(f"t.{c}").alias(c) for c in ("point", "pre_rmse", "lam", "lo", "hi", "p_zero", "boundary_hit", "n_donors")],
        share(lambda x: x["ratio"] >= F.col("t.ratio")).alias("placebo_p"), share(lambda x: sign * x["point"] >= sign * F.col("t.point")).alias("placebo_p_effect"), F.size("s").cast("long").alias("placebo_n"),
        _median(F.transform("s", lambda x: x["rmse"])).alias("placebo_pre_rmse_median"), _median(F.transform("s", lambda x: x["point"])).alias("placebo_effect_median"), F.transform("f", lambda x: x["flagged"]).alias("time_placebo_flags"),
    )
    n = panel.where("unit = 0").groupBy("verdict").agg(F.count_if("pre").alias("n_pre"), F.count_if(~F.col("pre")).alias("n_post"))
    return r.join(n, "verdict")


def placebo_band(fits: DataFrame) -> DataFrame:
    """verdict, bin, e (the treated unit's effect), lo, hi: 5 % and 95 % of the placebo units' paths."""
    e = fits.where("kind != 'time'").select("verdict", "kind", F.posexplode("effect").alias("bin", "e"))
    q = F.percentile(F.when(F.col("kind") == "space", F.col("e")), F.array(F.lit(0.05), F.lit(0.95)))
    return e.groupBy("verdict", "bin").agg(F.max(F.when(F.col("kind") == "treated", F.col("e"))).alias("e"), q.alias("q")).where("q is not null").select("verdict", "bin", "e", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def escalate(results_: DataFrame, least: float) -> DataFrame:
    """Verdicts whose controls moved with the area: they need controls from farther away."""
    return results_.where((F.abs("placebo_effect_median") >= least) & (F.signum("placebo_effect_median") == F.signum("point"))).select("verdict")


AIR_OUT = "verdict string, point double, lo double, hi double, p_zero double, boundary_hit boolean, accepted_empty boolean, pre_rmse double, lam double, n_pre long, n_post long, n_donors long, treated_n long, placebo_p double, placebo_p_effect double, placebo_n long, placebo_pre_rmse_median double, exact_cohort boolean, time_placebo_flags array<boolean>, lead_flagged boolean, jackknife_applicable boolean, jackknife_robust boolean, donor_applicable boolean, donor_robust boolean, cf_mean double"


def air_analysis(name: str, treated: np.ndarray, pool: np.ndarray, pre: np.ndarray, grid: int = 61, cohorts: int = 40) -> tuple:
    """All of one stratum: treated (n, T) aligned members, pool (m, T) donors observed throughout."""
    y = treated.mean(axis=0)
    own_fit = K.refit(y, pool, pre, K.AIR_GATE) if len(pool) else None
    n, m = len(treated), len(pool)
    if own_fit is None:
        return (name, None, None, None, None, None, None, None, None, int(pre.sum()), int((~pre).sum()), m, n, None, None, 0, 0.0, False, [], False, False, False, False, False, None)
    f, sel, point = own_fit.fit, own_fit.chosen, own_fit.effect
    ci = K.air_interval(y, pool[sel], pre, f.lam, point, f.rmse, grid)
    again = lambda y, pool: r.effect if (r := K.refit(y, pool, pre, K.AIR_GATE)) else float("nan")
    exact = m - n >= AIR["min_donors"]
    fits = []
    for g in exact_groups(m, n, cohorts, f"{name}:{m}") if exact else []:
        rest = np.delete(pool, g, 0)
        yy = pool[list(g)].mean(axis=0)
        if len(s := K.air_nearest(yy, rest, pre)) >= AIR["min_donors"]:
            fits.append(K.augmented(yy, rest[s], pre))
    own, sign = K.ratio(f.effect, pre), -1 if point < 0 else 1
    p = (sum(K.ratio(g.effect, pre) >= own for g in fits) + 1) / (len(fits) + 1) if fits else None
    pe = (sum(sign * g.effect[~pre].mean() >= sign * point for g in fits) + 1) / (len(fits) + 1) if fits else None
    jack = [again(np.delete(treated, i, 0).mean(axis=0), pool) for i in range(n)] if n >= 2 else []
    heavy = [int(sel[i]) for i in np.argsort(-f.weights, kind="stable")[:3] if f.weights[i] >= 0.05]
    drop = [again(y, np.delete(pool, i, 0)) for i in heavy if m - 1 >= AIR["min_donors"]]
    robust = lambda e, want: len(e) == want and bool(np.isfinite(e).all()) and K.holds(e, point)
    return (
        name, point, ci.lo, ci.hi, ci.p_zero, ci.boundary_hit, ci.empty, f.rmse, f.lam, int(pre.sum()), int((~pre).sum()), len(sel), n, p, pe, len(fits), float(np.median([g.rmse for g in fits])) if fits else f.rmse, exact,
        [bool(t["flagged"]) for t in K.air_fake_dates(y, pool, pre)], bool(K.lead_check(y, pool, pre)["flagged"]), n >= 2, robust(jack, n) if n >= 2 else False, bool(heavy), robust(drop, len(heavy)) if heavy else True, float(f.synthetic[~pre].mean()),
    )


def air(panel: DataFrame, grid: int = 61, cohorts: int = 40) -> DataFrame:
    """panel (verdict, unit, treated, k, v, pre) of whole weeks -> AIR_OUT, a task for each stratum."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.pivot_table(index=["treated", "unit"], columns="k", values="v", sort=True)
        pre = pdf.drop_duplicates("k").sort_values("k")["pre"].to_numpy(bool)
        t, d = (w.loc[x].to_numpy(float) if x in w.index.get_level_values(0) else np.zeros((0, len(pre))) for x in (True, False))
        return pd.DataFrame([air_analysis(pdf["verdict"].iloc[0], t, d, pre, grid, cohorts)], columns=[x.split()[0] for x in AIR_OUT.split(", ")])

    return panel.groupBy("verdict").applyInPandas(each, AIR_OUT)


def breaks(panel: DataFrame, most: int = 40, least: float = 0.05) -> DataFrame:
    """verdict, index, first, last, stat, p, point, detected: the break search of each verdict's panel."""
    schema = "verdict string, index long, first long, last long, stat double, p double, point double, detected boolean"

    def each(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                m, _, _ = _arrays(r)
                if len(m) < 3 or m.shape[1] < 24:  # nothing to search: too few donors, or bins before and after
                    rows.append({"verdict": r.verdict, "detected": False})
                    continue
                rows.append({"verdict": r.verdict, **K.break_search(m[0], m[1:], most, least)})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({x: "Int64" for x in ("index", "first", "last")})

    return matrices(panel).repartition("verdict").mapInPandas(each, schema)


def audit(panel: DataFrame) -> DataFrame:
    """verdict, p, confidence, pre_rmse, median_rmse, effect (array): convex fits only, every donor a placebo among the others."""
    schema = "verdict string, p double, confidence double, pre_rmse double, median_rmse double, effect array<double>"

    def each(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                m, pre, _ = _arrays(r)
                f = K.augmented(m[0], m[1:], pre, 0.0)
                fits = [K.augmented(m[j], np.delete(m[1:], j - 1, 0), pre, 0.0) for j in range(1, len(m))]
                p = (sum(K.ratio(g.effect, pre) >= K.ratio(f.effect, pre) for g in fits) + 1) / (len(fits) + 1)
                rows.append((r.verdict, p, 100 * (1 - p), f.rmse, float(np.median([g.rmse for g in fits])), f.effect.tolist()))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return matrices(panel).repartition("verdict").mapInPandas(each, schema)


def weather_adjusted(days: DataFrame, event: str, least: int = 180) -> DataFrame:
    """days (station, d, v, weather and ref_ columns) with adjusted, alpha, problem: one model a station."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in days.schema) + ", adjusted double, alpha double, problem string"

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d").reset_index(drop=True)
        d = pd.DatetimeIndex(pd.to_datetime(pdf["d"]))
        num = lambda x: pdf[x].to_numpy(float)
        y, alpha, why = K.remove_weather(num("v"), np.asarray(d < pd.Timestamp(event)), d.dayofyear.to_numpy(float), d.dayofweek.to_numpy(float), (d - d.min()).days.to_numpy(float), {k: num(k) for k in K.WEATHER}, {k: num(f"ref_{k}") for k in K.WEATHER}, least)
        return pdf.assign(adjusted=y, alpha=alpha, problem=why or None)

    return days.groupBy("station").applyInPandas(each, kind)
