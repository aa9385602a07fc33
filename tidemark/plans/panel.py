"""Queries on panels: bins, repairs, donors, counterfactuals and their ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import days_from, off_season, settled, week_ending
from ..functions.stats import cyclic_p, fit_ratio, step_up
from ..operators import aggregates as A
from ..operators import gates as G
from ..operators import joins as J
from ..operators import timebins as T
from ..operators import topk as K
from ..operators import windows as W
from .base import BINS, DAYS, EVENT, HOURS, MONTHS, OBS, TREATED, WIDTH, R, cut, obs, table, user_days, user_hours

QUERIES, SQL = {}, {}
PLACEBOS = 60  # placebo units of one analysis


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return T.anchored_bins(obs(spark, sf), EVENT, WIDTH)


@query(f"WITH {MONTHS} SELECT unit, month, {R('v')} AS v, v IS NOT NULL AS observed FROM months")
def panel_month_median(spark, sf):
    return T.month_median(obs(spark, sf)).withColumn("v", settled("v"))


@query(f"WITH {BINS} SELECT unit, k, {R('v')} AS v, n, mid, pre FROM bins")
def panel_anchor_bins(spark, sf):
    return bins(spark, sf).withColumn("v", settled("v"))


_FILL = "FROM (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {x} END IGNORE NULLS) OVER a AS ax, last_value(v IGNORE NULLS) OVER a AS av, first_value(CASE WHEN v IS NOT NULL THEN {x} END IGNORE NULLS) OVER b AS bx, first_value(v IGNORE NULLS) OVER b AS bv FROM {t} WINDOW a AS (PARTITION BY unit ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY unit ORDER BY {o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
_FILLED = "coalesce(v, av + (bv - av) * ({x} - ax) / nullif(bx - ax, 0), av, bv, 0)"


@query(f"WITH {MONTHS} SELECT unit, month, v IS NOT NULL AS observed, {R(_FILLED.format(x='epoch_days'), 4)} AS filled " + _FILL.format(x="epoch_days", t="(SELECT *, date_diff('day', DATE '1970-01-01', month) AS epoch_days FROM months)", o="month"))
def panel_gap_fill(spark, sf):
    df = T.fill_linear(T.month_median(obs(spark, sf)), "month")
    return df.select("unit", "month", "observed", settled("filled", 4).alias("filled"))


@query(f"""WITH {BINS}, kept AS (SELECT k, row_number() OVER (ORDER BY k) AS pos FROM bins WHERE unit = {TREATED} AND n > 0), j AS (SELECT b.unit, b.k, b.v, kept.pos FROM bins b JOIN kept USING (k)),
ok AS (SELECT unit FROM j GROUP BY unit HAVING avg((v IS NOT NULL)::INT) >= 0.70 OR unit = {TREATED}), p AS (SELECT j.* FROM j JOIN ok USING (unit))
SELECT unit, k, pos, {R(_FILLED.format(x='pos'), 4)} AS v_full """ + _FILL.format(x="pos", t="p", o="pos"))
def panel_position_fill(spark, sf):
    df = T.complete_panel(bins(spark, sf), TREATED)
    return df.select("unit", "k", F.col("pos").cast("long").alias("pos"), settled("v_full", 4).alias("v_full"))


@query(f"WITH {HOURS} SELECT unit, ts::DATE AS d, CASE WHEN count(v) >= 3 THEN {R('avg(v)')} END AS v, count(v) AS n, count(v) >= 3 AS covered FROM hours GROUP BY 1, 2")
def daily_coverage(spark, sf):
    return T.daily_mean(user_hours(spark, sf), 3).withColumn("v", settled("v"))


@query(f"WITH {DAYS} SELECT unit, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS week, CASE WHEN count(v) >= 4 THEN {R('avg(v)')} END AS v, count(v) AS n FROM days GROUP BY 1, 2")
def weekly_sunday_mean(spark, sf):
    return T.weekly_mean(user_days(spark, sf), 4).withColumn("v", settled("v"))


@query(f"""WITH {OBS}, days AS (SELECT unit, d, avg(v) AS v FROM obs GROUP BY 1, 2),
nb AS (SELECT a.unit, a.d, a.v, b.v AS x FROM days a LEFT JOIN days b ON b.unit = a.unit AND b.d <> a.d AND abs(date_diff('day', a.d, b.d)) <= 40),
m AS (SELECT unit, d, any_value(v) AS v, median(x) AS med, count(x) AS n FROM nb GROUP BY 1, 2),
s AS (SELECT nb.unit, nb.d, median(abs(nb.x - m.med)) AS mad FROM nb JOIN m USING (unit, d) GROUP BY 1, 2)
SELECT m.unit, m.d, {R('m.v')} AS v, coalesce(n >= 2 AND med - m.v > greatest(20000, 3 * 1.4826 * mad), false) AS suspect FROM m JOIN s USING (unit, d)""")
def despike_neighbours(spark, sf):
    days = obs(spark, sf).groupBy("unit", "d").agg(F.avg("v").alias("v"))
    return G.despike(days, drop=20000.0).select("unit", "d", settled("v").alias("v"), "suspect")


_WEEKS = f"""{OBS}, wk AS (SELECT unit, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS week, avg(v) AS v FROM obs GROUP BY 1, 2),
wax AS (SELECT unnest(generate_series((SELECT min(week) FROM wk), (SELECT max(week) FROM wk), INTERVAL 7 DAY))::DATE AS week),
weeks AS (SELECT u.unit, wax.week, wk.v FROM (SELECT DISTINCT unit FROM wk) u CROSS JOIN wax LEFT JOIN wk ON wk.unit = u.unit AND wk.week = wax.week)"""


def nation_weeks(spark, sf) -> DataFrame:
    w = obs(spark, sf).groupBy("unit", week_ending("d").alias("week")).agg(F.avg("v").alias("v"))
    return J.on_weeks(w)


@query(f"WITH {_WEEKS} SELECT unit, week, {R('v')} AS v FROM weeks")
def weeks_on_spine(spark, sf):
    return nation_weeks(spark, sf).withColumn("v", settled("v"))


@query(f"""WITH {_WEEKS}, x AS (SELECT *, sum((v IS NULL)::INT) OVER (PARTITION BY unit) AS holes, lag(week) OVER o AS wa, lag(v) OVER o AS va, lead(week) OVER o AS wb, lead(v) OVER o AS vb FROM weeks WINDOW o AS (PARTITION BY unit ORDER BY week))
SELECT unit, week, {R("CASE WHEN v IS NULL AND holes = 1 AND date_diff('day', wa, week) = 7 AND date_diff('day', week, wb) = 7 THEN (va + vb) / 2 ELSE v END")} AS repaired FROM x""")
def single_gap_repair(spark, sf):
    return T.repair_single_gap(nation_weeks(spark, sf)).select("unit", "week", settled("repaired").alias("repaired"))


@query(f"""WITH {_WEEKS}, x AS (SELECT *, week < DATE '{EVENT}' AS pre, row_number() OVER o AS pos FROM weeks WINDOW o AS (PARTITION BY unit, week < DATE '{EVENT}' ORDER BY week)),
g AS (SELECT *, pos - sum((v IS NULL)::INT) OVER (PARTITION BY unit, pre ORDER BY week) AS grp FROM x), r AS (SELECT *, count(*) OVER (PARTITION BY unit, pre, grp, v IS NULL) AS len,
 last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS ax, last_value(v IGNORE NULLS) OVER a AS av, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS bx, first_value(v IGNORE NULLS) OVER b AS bv FROM g
 WINDOW a AS (PARTITION BY unit, pre ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY unit, pre ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT unit, week, {R('CASE WHEN v IS NULL AND len <= 3 THEN av + (bv - av) * (pos - ax) / nullif(bx - ax, 0) ELSE v END + 0.00123', 2)} AS repaired FROM r""")
def run_gap_repair(spark, sf):
    df = nation_weeks(spark, sf).withColumn("pre", F.col("week") < F.lit(EVENT).cast("date"))
    return T.repair_short_runs(df, day="week", side="pre").select("unit", "week", settled(F.col("repaired") + 0.00123, 2).alias("repaired"))


_PANEL = f"""{BINS}, kept AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS x FROM bins WHERE unit = {TREATED} AND n > 0), full_ AS (SELECT unit FROM bins JOIN kept USING (k) GROUP BY unit HAVING count(v) = count(*)),
panel AS (SELECT b.unit, b.k, b.v, b.pre FROM bins b JOIN kept USING (k) JOIN full_ USING (unit))"""


def panel(spark, sf) -> DataFrame:
    """Units observed in all bins of the treated unit."""
    b = bins(spark, sf)
    keep = b.where((F.col("unit") == TREATED) & (F.col("n") > 0)).select("k")
    df = b.join(F.broadcast(keep), "k")  # a row a bin
    full = df.groupBy("unit").agg(F.count("v").alias("a"), F.count(F.lit(1)).alias("b")).where("a = b").select("unit")
    return df.join(full, "unit", "left_semi").select("unit", "k", "v", "pre")


_RMSE = f"""{_PANEL}, rm AS (SELECT p.unit, sqrt(avg(power(p.v - y.v, 2))) AS rmse FROM panel p JOIN panel y ON y.k = p.k AND y.unit = {TREATED} WHERE p.unit <> {TREATED} AND p.pre GROUP BY 1)"""


@query(f"WITH {_RMSE} SELECT unit, {R('rmse')} AS rmse, row_number() OVER (ORDER BY rmse, unit) AS rank FROM rm ORDER BY rmse, unit LIMIT 10")
def donor_topk_rmse(spark, sf):
    df = K.pick_donors(K.donor_rmse(panel(spark, sf), TREATED), k=10)
    return df.select("unit", settled("rmse").alias("rmse"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_PANEL}, pos AS (SELECT k, v AS y, (row_number() OVER (ORDER BY k) - 1)::DOUBLE AS x FROM panel WHERE unit = {TREATED} AND pre), g AS (
SELECT unit, sqrt(avg(power(v - y, 2))) + 0.2 * abs(avg(v) - avg(y)) + 0.15 * abs(regr_slope(v, x) - regr_slope(y, x)) * count(*) + 0.1 * abs(stddev_pop(v) - stddev_pop(y)) AS score FROM panel JOIN pos USING (k) WHERE unit <> {TREATED} GROUP BY unit)
SELECT unit, {R('score', 3)} AS score, row_number() OVER (ORDER BY score, unit) AS rank FROM g ORDER BY score, unit LIMIT 24""")
def donor_topk_score(spark, sf):
    return K.air_top(panel(spark, sf), TREATED).select("unit", settled("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_RMSE}, cov AS (SELECT c_nationkey AS unit, any_value(n_regionkey) AS lc, avg(c_acctbal) AS elevation FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
s AS (SELECT rm.unit, rmse, lc, elevation, lc = (SELECT lc FROM cov WHERE unit = {TREATED}) AS same, abs(elevation - (SELECT elevation FROM cov WHERE unit = {TREATED})) <= 300 AS near FROM rm JOIN cov USING (unit)),
c AS (SELECT count(*) FILTER (same) AS ns, count(*) FILTER (near) AS ne, count(*) FILTER (same AND near) AS nb FROM s)
SELECT unit, {R('rmse')} AS rmse, row_number() OVER (ORDER BY rmse, unit) AS rank FROM s, c WHERE (ns < 4 OR same) AND ((CASE WHEN ns >= 4 THEN nb ELSE ne END) < 4 OR near) ORDER BY rmse, unit LIMIT 10""")
def donor_relaxed(spark, sf):
    cov = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").alias("unit")).agg(F.first("n_regionkey").alias("lc"), F.avg("c_acctbal").alias("elevation"))
    own = cov.where(F.col("unit") == TREATED).select(F.col("lc").alias("own_lc"), F.col("elevation").alias("own_elevation"))
    df = K.donor_rmse(panel(spark, sf), TREATED).join(cov, "unit").join(F.broadcast(own))  # one row
    return K.pick_donors(df, F.col("own_lc"), F.col("own_elevation"), k=10, least=4, metres=300.0).select("unit", settled("rmse").alias("rmse"), F.col("rank").cast("long").alias("rank"))


_TWIN = f"""{_PANEL}, pr AS (SELECT a.unit AS u, b.unit AS o, sqrt(avg(power(a.v - b.v, 2))) AS rmse FROM panel a JOIN panel b ON a.k = b.k AND a.unit <> b.unit WHERE a.pre GROUP BY 1, 2),
dn AS (SELECT u, o FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY rmse, o) AS r FROM pr) WHERE r <= 10),
tw AS (SELECT d.u AS unit, p.k, avg(p.v) AS twin FROM dn d JOIN panel p ON p.unit = d.o GROUP BY 1, 2), ef AS (SELECT p.unit, p.k, p.v, t.twin, p.v - t.twin AS e, p.pre FROM panel p JOIN tw t USING (unit, k))"""


def effects(spark, sf, k: int = 10) -> DataFrame:
    """unit, k, v, twin, e, pre: the treated unit and at most PLACEBOS others, each against the mean of its own k nearest others, all chosen by the same rule."""
    p = cut(panel(spark, sf))
    units = p.select("unit").distinct()
    pairs = J.pool_pairs(p, units.where(F.col("unit") == TREATED).unionByName(K.hash_budget(units.where(F.col("unit") != TREATED), PLACEBOS, "placebos", key="unit")))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy("rmse", "other"))).where(F.col("r") <= k).select("unit", "other")
    twin = best.join(p.select(F.col("unit").alias("other"), "k", F.col("v").alias("x")), "other").groupBy("unit", "k").agg(F.avg("x").alias("twin"))
    return p.join(twin, ["unit", "k"]).withColumn("e", F.col("v") - F.col("twin"))


@query(f"WITH {_TWIN} SELECT unit, k, {R('v')} AS v, {R('twin', 4)} AS twin, {R('e', 4)} AS e, pre FROM ef")
def synthetic_equal_weight(spark, sf):
    return effects(spark, sf).select("unit", "k", settled("v").alias("v"), settled("twin", 4).alias("twin"), settled("e", 4).alias("e"), "pre")


_RANK = f"""{_TWIN}, rt AS (SELECT unit, sqrt(avg(CASE WHEN NOT pre THEN e * e END)) / (sqrt(avg(CASE WHEN pre THEN e * e END)) + 1e-9) AS ratio, avg(CASE WHEN NOT pre THEN e END) AS point FROM ef GROUP BY 1),
own AS (SELECT * FROM rt WHERE unit = {TREATED})"""


@query(f"""WITH {_RANK} SELECT any_value({R('own.ratio')}) AS ratio, any_value({R('own.point', 4)}) AS point, (count(*) FILTER (rt.ratio >= own.ratio) + 1) / (count(*) + 1.0)::DOUBLE AS p,
(count(*) FILTER (CASE WHEN own.point < 0 THEN -1 ELSE 1 END * rt.point >= CASE WHEN own.point < 0 THEN -1 ELSE 1 END * own.point) + 1) / (count(*) + 1.0)::DOUBLE AS p_effect, count(*) AS n FROM rt, own WHERE rt.unit <> {TREATED}""")
def placebo_rank_p(spark, sf):
    r = effects(spark, sf).groupBy("unit").agg(fit_ratio("e", "pre").alias("ratio"), F.avg(F.when(~F.col("pre"), F.col("e"))).alias("point"))
    own = r.where(F.col("unit") == TREATED).select(F.col("ratio").alias("r"), F.col("point").alias("pt"))
    sign = F.when(F.col("pt") < 0, -1).otherwise(1)
    g = r.where(F.col("unit") != TREATED).join(F.broadcast(own)).agg(  # one row
        settled(F.max("r")).alias("ratio"), settled(F.max("pt"), 4).alias("point"), ((F.count_if(F.col("ratio") >= F.col("r")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
        ((F.count_if(sign * F.col("point") >= sign * F.col("pt")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_effect"), F.count(F.lit(1)).alias("n"))
    return g


@query(f"""WITH {_TWIN}, ix AS (SELECT unit, e, pre, row_number() OVER (PARTITION BY unit ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY unit) AS t, count(*) FILTER (NOT pre) OVER (PARTITION BY unit) AS q FROM ef),
st AS (SELECT a.unit, a.i AS s, any_value(a.t) AS t, any_value(a.q) AS q, abs(sum(b.e)) / any_value(a.q) AS stat FROM ix a JOIN ix b ON a.unit = b.unit AND (b.i - a.i + a.t) % a.t < a.q GROUP BY 1, 2)
SELECT st.unit, avg((round(st.stat, 4) >= round(o.stat, 4))::INT)::DOUBLE AS p FROM st JOIN st o ON o.unit = st.unit AND o.s = o.t - o.q GROUP BY 1""")
def conformal_cyclic_p(spark, sf):
    s = effects(spark, sf).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("k", "e", "pre"))).alias("s"))
    s = s.select("unit", F.transform("s", lambda x: x["e"]).alias("u"), F.transform("s", lambda x: ~x["pre"]).alias("post"))
    return s.select("unit", cyclic_p("u", "post").cast("double").alias("p"))


_FAM = """fam AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 1000 + 1) / 4000.0::DOUBLE AS p FROM supplier)"""


@query(f"""WITH {_FAM}, r AS (SELECT id, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p)) - 1 AS r, count(*) OVER () AS n FROM fam), c AS (SELECT max(p) FILTER (p <= 0.1 * r / n) AS cut FROM r)
SELECT id, p, coalesce(p <= cut, false) AS found FROM fam, c""")
def fdr_step_up(spark, sf):
    fam = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 7919 % 1000 + 1).cast("double") / 4000).alias("p"))
    return step_up(fam, alpha=0.1)


@query(f"""WITH {_WEEKS}, f AS (SELECT unit, avg(v) FILTER (week < DATE '{EVENT}') AS own, count(v) FILTER (week < DATE '{EVENT}') AS a, count(v) FILTER (week >= DATE '{EVENT}') AS b FROM weeks GROUP BY 1),
sd AS (SELECT count(DISTINCT week) FILTER (week < DATE '{EVENT}') AS na, count(DISTINCT week) FILTER (week >= DATE '{EVENT}') AS nb FROM weeks), fx AS (SELECT unit, own FROM f, sd WHERE a >= 0.8 * na AND b >= 0.8 * nb),
lv AS (SELECT avg(own) AS anchor, greatest(1, ceil(count(*) * 0.8)) AS need FROM fx), g AS (SELECT week, avg(v - own) AS m, count(v) AS n FROM weeks JOIN fx USING (unit) GROUP BY 1)
SELECT week, CASE WHEN n >= need THEN {R('m + anchor', 4)} END AS v, n FROM g, lv""")
def cohort_aligned_mean(spark, sf):
    return A.cohort_mean(nation_weeks(spark, sf), EVENT).withColumn("v", settled("v", 4))


@query(f"""WITH {OBS}, days AS (SELECT unit, d, avg(v) AS v, dayofyear(d) AS doy FROM obs GROUP BY 1, 2), pre AS (SELECT * FROM days WHERE d < DATE '1996-07-01'), n AS (SELECT unit, unnest(range(1, 367)) AS doy FROM (SELECT DISTINCT unit FROM days)),
r AS (SELECT n.unit, n.doy, median(p.v) AS r FROM n JOIN pre p ON p.unit = n.unit AND least(abs(p.doy - n.doy), 366 - abs(p.doy - n.doy)) <= 14 GROUP BY 1, 2), fb AS (SELECT unit, median(v) AS f FROM pre GROUP BY 1)
SELECT days.unit, days.d, {R('days.v')} AS v, {R('coalesce(r.r, fb.f, 0)')} AS reference FROM days LEFT JOIN r USING (unit, doy) LEFT JOIN fb ON fb.unit = days.unit""")
def seasonal_reference(spark, sf):
    days = obs(spark, sf).groupBy("unit", "d").agg(F.avg("v").alias("v"))
    return J.seasonal_reference(days, "1996-07-01").select("unit", "d", settled("v").alias("v"), settled("reference").alias("reference"))


_YEARS = f"""{OBS}, y0 AS (SELECT unit, year(d) AS y, avg(v) AS m FROM obs WHERE month(d) IN (10, 11, 12, 3, 4) GROUP BY 1, 2), b AS (SELECT y, avg(m) AS all_m FROM y0 GROUP BY 1), ye AS (SELECT unit, y, round((m - all_m) / 100000, 6) AS e FROM y0 JOIN b USING (y))"""


def yearly(spark, sf) -> DataFrame:
    """unit, y, e: off-season level of a nation against all, a year."""
    y = obs(spark, sf).where(off_season("d")).groupBy("unit", F.year("d").alias("y")).agg(F.avg("v").alias("m"))
    base = y.groupBy("y").agg(F.avg("m").alias("all_m"))
    return y.join(F.broadcast(base), "y").select("unit", "y", F.round((F.col("m") - F.col("all_m")) / 100000, 6).alias("e"))  # a row a year


@query(f"WITH {_YEARS}, n AS (SELECT *, lead(e) OVER (PARTITION BY unit ORDER BY y) AS nx FROM ye) SELECT unit, min(y) FILTER (e >= 0.03 AND nx >= 0.03)::DOUBLE AS onset FROM n GROUP BY 1")
def onset_year(spark, sf):
    return W.first_sustained(yearly(spark, sf), 0.03).withColumn("onset", F.col("onset").cast("double"))


@query(f"WITH {_YEARS}, n AS (SELECT *, lead(e) OVER (PARTITION BY unit ORDER BY y) AS nx FROM ye) SELECT unit, min(y) FILTER (e <= -0.03 AND coalesce(nx <= -0.03, true))::DOUBLE AS onset FROM n GROUP BY 1")
def collapse_year(spark, sf):
    return W.first_sustained(yearly(spark, sf), -0.03, up=False, last_counts=True).withColumn("onset", F.col("onset").cast("double"))


@query(f"""WITH {_YEARS}, w AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY y DESC) AS back, max(e) OVER (PARTITION BY unit) AS peak FROM ye), p AS (SELECT *, min(CASE WHEN e = peak THEN y END) OVER (PARTITION BY unit) AS py FROM w),
g AS (SELECT unit, max(peak) AS peak, max(py) AS peak_year, avg(e) FILTER (back <= 2) AS recent, max(y) AS last, min(y) FILTER (y > py AND e < 0.03) AS below,
 sum(CASE WHEN e >= 0.03 THEN (0.2 + least(greatest(e / 0.2, 0), 1) * 0.8) * 10 ELSE 0 END) AS credit FROM p GROUP BY 1)
SELECT unit, peak, peak_year, {R('recent')} AS recent, peak >= 0.03 AND recent < 0.03 AND recent < 0.45 * peak AS detected, CASE WHEN peak >= 0.03 AND recent < 0.03 AND recent < 0.45 * peak THEN coalesce(below, last) END::DOUBLE AS reversal_year, {R('credit')} AS credit FROM g""")
def reversal_year(spark, sf):
    r = W.reversal(yearly(spark, sf), F.lit(10.0))
    return r.select("unit", "peak", F.col("peak_year").cast("long").alias("peak_year"), settled("recent").alias("recent"), "detected", F.col("reversal_year").cast("double").alias("reversal_year"), settled("credit").alias("credit"))


@query(f"""WITH {_TWIN}, s AS (SELECT unit, k, e / 100000 AS e FROM ef), n AS (SELECT *, lead(e) OVER (PARTITION BY unit ORDER BY k) AS nx FROM s) SELECT unit, min(k) FILTER (k >= 0 AND e <= -0.05 AND nx <= -0.05)::DOUBLE AS onset FROM n GROUP BY 1""")
def decline_onset(spark, sf):
    e = effects(spark, sf).select("unit", F.col("k").alias("t"), (F.col("e") / 100000).alias("e"))
    return W.consecutive(e, -0.05, 0).withColumn("onset", F.col("onset").cast("double"))


@query(f"""WITH {OBS}, m AS (SELECT unit, date_trunc('month', d)::DATE AS d, median(v) AS x FROM obs GROUP BY 1, 2), r AS (SELECT unit, year(d) AS y, min(x) AS lo, max(x) AS hi FROM m GROUP BY 1, 2 HAVING count(x) >= 4),
j AS (SELECT m.unit, r.y, dayofyear(d) AS doy, x, lo, hi FROM m JOIN r ON r.unit = m.unit AND r.y = year(m.d)), g AS (SELECT unit, y, min(doy) FILTER (x >= lo + 0.5 * (hi - lo)) AS sos, min(doy) FILTER (x = hi) AS pos, max(doy) FILTER (x >= lo + 0.5 * (hi - lo)) AS eos, max(hi) - min(lo) AS amplitude FROM j GROUP BY 1, 2)
SELECT unit, y, sos, pos, eos, {R('amplitude')} AS amplitude, eos - sos AS length FROM g""")
def phenology_year(spark, sf):
    m = obs(spark, sf).groupBy("unit", F.trunc("d", "MM").alias("d")).agg(F.median("v").alias("v"))
    p = A.phenology(m)
    return p.select("unit", *[F.col(c).cast("long").alias(c) for c in ("y", "sos", "pos", "eos", "length")], settled("amplitude").alias("amplitude"))


@query(f"""WITH {_PANEL}, av AS (SELECT k, avg(v) AS m FROM panel WHERE unit <> {TREATED} GROUP BY 1), e AS (SELECT p.unit, p.k, p.v - av.m AS e, row_number() OVER (PARTITION BY p.unit ORDER BY p.k) - 1 AS i, count(*) OVER (PARTITION BY p.unit) AS n FROM panel p JOIN av USING (k)),
t AS (SELECT a.unit, a.i AS t, sqrt(avg(CASE WHEN b.i >= a.i THEN b.e * b.e END)) / (sqrt(avg(CASE WHEN b.i < a.i THEN b.e * b.e END)) + 1e-9) AS s FROM e a JOIN e b ON a.unit = b.unit WHERE a.i >= greatest(floor(0.4 * a.n), 8) AND a.i < least(floor(0.85 * a.n), a.n - 2) GROUP BY 1, 2)
SELECT unit, arg_max(t, (s, -t)) AS index, {R('max(s)')} AS stat FROM t GROUP BY 1""")
def break_search_equal_weight(spark, sf):
    p = panel(spark, sf)
    mean = p.where(F.col("unit") != TREATED).groupBy("k").agg(F.avg("v").alias("m"))
    e = p.join(F.broadcast(mean), "k").withColumn("e2", F.pow(F.col("v") - F.col("m"), 2))  # a row a bin
    w = Window.partitionBy("unit").orderBy("k")
    e = e.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("unit")))
    before, all_ = F.sum("e2").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.sum("e2").over(Window.partitionBy("unit"))
    s = F.sqrt((F.col("all") - F.col("b")) / (F.col("n") - F.col("i"))) / (F.sqrt(F.col("b") / F.col("i")) + 1e-9)
    e = e.withColumn("b", before).withColumn("all", all_).where((F.col("i") >= F.greatest(F.floor(0.4 * F.col("n")), F.lit(8))) & (F.col("i") < F.least(F.floor(0.85 * F.col("n")), F.col("n") - 2))).withColumn("s", s)
    return e.groupBy("unit").agg(F.max_by("i", F.struct("s", -F.col("i"))).cast("long").alias("index"), settled(F.max("s")).alias("stat"))


@query(f"""WITH {BINS}, t AS (SELECT k FROM bins WHERE unit = {TREATED} AND n > 0), c AS (SELECT count(*) AS n FROM t), g AS (SELECT unit FROM bins JOIN t USING (k) WHERE unit <> {TREATED} AND v IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.7 * (SELECT n FROM c))
SELECT g.unit, t.k, {R('b.v')} AS v FROM g CROSS JOIN t LEFT JOIN bins b ON b.unit = g.unit AND b.k = t.k""")
def donor_groups_by_bin(spark, sf):
    b = bins(spark, sf)
    return J.join_groups(b.where(F.col("unit") == TREATED).select("k", "n"), b.where(F.col("unit") != TREATED).select("k", "unit", "v")).select("unit", "k", settled("v").alias("v"))


@query(f"WITH {OBS}, a AS (SELECT unit, d, avg(v) AS a FROM obs GROUP BY 1, 2), b AS (SELECT unit, d, max(v) AS b FROM obs GROUP BY 1, 2) SELECT unit, d, {R('a')} AS a, {R('b')} AS b FROM a JOIN b USING (unit, d)")
def two_channels(spark, sf):
    o = obs(spark, sf).groupBy("unit", "d")
    return J.two_channels(o.agg(F.avg("v").alias("v")), o.agg(F.max("v").alias("v"))).select("unit", "d", settled("a").alias("a"), settled("b").alias("b"))


@query(f"WITH {MONTHS} SELECT unit, avg((v IS NOT NULL)::INT)::DOUBLE AS coverage, avg((v IS NOT NULL)::INT) >= 0.98 AS covered FROM months GROUP BY 1")
def coverage_gate(spark, sf):
    return G.coverage_gate(T.month_median(obs(spark, sf)), "observed", 0.98)


@query(f"WITH {OBS} SELECT unit, count(*) AS n, min(date_diff('day', DATE '{EVENT}', d)) AS first, max(date_diff('day', DATE '{EVENT}', d)) AS last FROM obs GROUP BY 1")
def relative_days(spark, sf):
    r = days_from("d", F.lit(EVENT).cast("date")).cast("long")
    return obs(spark, sf).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min(r).alias("first"), F.max(r).alias("last"))
