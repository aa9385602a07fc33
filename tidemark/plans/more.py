"""Queries on sources, sinks, rasters, gates and streams that the other modules' queries don't reach, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import settled
from ..operators import decide as D
from ..operators import gates as G
from ..operators import grid as X
from ..operators import timebins as T
from ..sources import readers as Rd
from ..sources import sinks as Sk
from ..streaming import events as St
from . import verdicts as V
from .base import EVENT, MONTHS, OBS, PIX, R, folder, obs, pixels, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    return f"{folder(spark)}/tidemark-{uuid.uuid4().hex[:12]}"


# -- rasters --------------------------------------------------------------------------------------


@query(f'WITH {PIX} SELECT block, count(*) AS n, {R("sum(v)", 5)} AS total FROM px WHERE "row" BETWEEN 2 AND 5 AND "col" BETWEEN 1 AND 3 GROUP BY 1')
def raster_window(spark, sf):
    return X.window(pixels(spark, sf), 2, 5, 1, 3).groupBy("block").agg(F.count(F.lit(1)).alias("n"), settled(F.sum("v"), 5).alias("total"))


@query(f'WITH {PIX} SELECT block, "row", 4 * {R("sum(v)", 5)} AS fine, {R("sum(v)", 5)} AS coarse FROM px GROUP BY 1, 2')
def raster_resample(spark, sf):
    """Pixels doubled in both directions, and every second of those again."""
    fine = X.upsample(pixels(spark, sf), 2)
    a = fine.groupBy("block", F.floor(F.col("row") / 2).cast("int").alias("row")).agg((4 * settled(F.sum("v") / 4, 5)).alias("fine"))
    b = X.decimate(fine, 2).groupBy("block", "row").agg(settled(F.sum("v"), 5).alias("coarse"))
    return a.join(b, ["block", "row"])


_CUBE = f'{PIX}, cube AS (SELECT label AS t, "row", "col", v FROM px)'


def cube(spark, sf) -> DataFrame:
    return pixels(spark, sf).select(F.col("label").alias("t"), "row", "col", "v")


@query(f"""WITH {_CUBE}, g AS (SELECT "row" // 4 AS pr, "col" // 4 AS pc, t, avg(v) AS v FROM cube GROUP BY 1, 2, 3),
ok AS (SELECT pr, pc FROM g GROUP BY 1, 2 HAVING count(v) >= greatest(4, (SELECT count(DISTINCT t) FROM cube) // 4))
SELECT pr || ':' || pc AS parcel, t, {R('v')} AS v FROM g JOIN ok USING (pr, pc)""")
def parcel_means(spark, sf):
    return X.parcels(cube(spark, sf), 4).select("parcel", "t", settled("v").alias("v"))


_IDS = "ids AS (SELECT s_suppkey AS id, s_acctbal AS a, s_nationkey AS n FROM supplier)"


def ids(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("a"), F.col("s_nationkey").alias("n"))


@query(f"WITH {_IDS}, q AS (SELECT id, (floor((least(greatest(a / 100 - 40, -50.0), 15.0) + 50) * 1000 + 0.5) + 1)::INT AS code FROM ids) SELECT id, code, {R('power(10.0, ((code - 1) / 1000.0 - 50) / 10)', 6)} AS power FROM q")
def decibel_codes(spark, sf):
    code = S.encode_decibel(F.col("a") / 100 - 40)
    df = ids(spark, sf).withColumn("code", code)
    return df.select("id", "code", settled(S.decode_decibel(F.floor(F.col("code") / 256), F.col("code") % 256)).alias("power"))


@query(f"""WITH {_IDS}, z AS (SELECT n, id * 37.0 % 5000 AS x0, id * 91.0 % 7000 AS y0, id * 37.0 % 5000 + n * 11 AS x1, id * 91.0 % 7000 + n * 13 AS y1 FROM ids)
SELECT (floor(min(x0) / 60) * 60)::BIGINT AS x0, (floor(min(y0) / 60) * 60)::BIGINT AS y0, (ceil(max(x1) / 60) * 60)::BIGINT AS x1, (ceil(max(y1) / 60) * 60)::BIGINT AS y1 FROM z""")
def snapped_grid(spark, sf):
    z = ids(spark, sf).select((F.col("id") * 37.0 % 5000).alias("x0"), (F.col("id") * 91.0 % 7000).alias("y0"), "n")
    return X.snapped(z.withColumns({"x1": F.col("x0") + F.col("n") * 11, "y1": F.col("y0") + F.col("n") * 13}))


@query(f"WITH {_IDS} SELECT id, CASE WHEN id * 30.0 / 40 * (n * 211 + 50) / 40 <= 9000 THEN 40 WHEN id * 30.0 / 60 * (n * 211 + 50) / 60 <= 9000 THEN 60 WHEN id * 30.0 / 80 * (n * 211 + 50) / 80 <= 9000 THEN 80 END AS res FROM ids")
def read_resolutions(spark, sf):
    """The finest resolution at which each window is small enough."""
    return ids(spark, sf).select("id", X.resolution_of(F.col("id") * 30.0, F.col("n") * 211 + 50, 9000).alias("res"))


@query(f"""WITH {_CUBE} SELECT ("row" // 4) || ':' || ("col" // 4) AS parcel, t, {R('stddev_pop(v)')} AS v FROM cube GROUP BY 1, 2""")
def texture_panel(spark, sf):
    return X.signal_panel(cube(spark, sf), "texture_std", 4).select("parcel", "t", settled("v").alias("v"))


# -- files ----------------------------------------------------------------------------------------


@query(f"""WITH {OBS}, m AS (SELECT unit, date_trunc('month', d)::DATE AS d, round(max(v), 2) AS v FROM obs GROUP BY 1, 2)
SELECT unit::VARCHAR AS unit, count(*) AS n, {R('sum(v)', 2)} AS total, min(d) AS first_day FROM m GROUP BY 1""")
def long_csv_panel(spark, sf):
    """The largest value of each month, written as tidy CSV and read again."""
    at = scratch(spark)
    m = obs(spark, sf).groupBy(F.col("unit").alias("field_id"), F.trunc("d", "MM").alias("date")).agg(F.round(F.max("v"), 2).alias("ndvi"))
    Sk.long_csv(m, at)
    panel, _ = Rd.long_csv(spark, at)
    return panel.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), settled(F.sum("v"), 2).alias("total"), F.min("d").alias("first_day"))


@query(f"""WITH {OBS}, m AS (SELECT unit, date_trunc('year', d)::DATE AS d, round(max(v), 2) AS v FROM obs GROUP BY 1, 2)
SELECT unit::VARCHAR AS unit, d, v FROM m""")
def wide_csv_panel(spark, sf):
    """The largest value of each year, a column a year, written as CSV and read again; empty cells are no observations."""
    at = scratch(spark)
    o = obs(spark, sf).select(F.col("unit").alias("field_id"), F.date_format(F.trunc("d", "YEAR"), "yyyy-MM-dd").alias("year"), "v")
    m = o.groupBy("field_id").pivot("year").agg(F.round(F.max("v"), 2))
    Sk.long_csv(m, at)
    return Rd.wide_csv(spark, at).where("v is not null").select("unit", "d", "v")


@query(f"WITH {_IDS} SELECT n, count(*) AS sites, {R('sum(a)', 2)} AS total FROM ids GROUP BY 1")
def staged_rows(spark, sf):
    """A stage written below its key and read by it."""
    at = scratch(spark)
    return Rd.stage(spark, at, Sk.stage(ids(spark, sf), at, "rows")).groupBy("n").agg(F.count(F.lit(1)).alias("sites"), settled(F.sum("a"), 2).alias("total"))


@query(f"""WITH {_IDS} SELECT n AS batch, string_agg('| ' || id || ' | ' || CASE WHEN id % 3 = 0 THEN 'REAL' WHEN id % 3 = 1 THEN 'NOT_REAL' ELSE 'n/a' END || ' |', chr(10) ORDER BY id) AS markdown FROM ids GROUP BY 1""")
def summary_markdown(spark, sf):
    status = F.when(F.col("id") % 3 == 0, "REAL").when(F.col("id") % 3 == 1, "NOT_REAL")
    return Sk.summary_table(ids(spark, sf).select("id", F.col("n").alias("batch"), status.alias("status")))


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n FROM supplier)
SELECT 'S' || id AS station, n % 2 = 0 AS traffic, DATE '2000-01-01' + n::INT AS opened FROM s""")
def monitor_site_documents(spark, sf):
    """A document of one site for each supplier, as object or as list; the instrument's start is later than the site's."""
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("n").cast("int")), "yyyy-MM-dd 00:00:00")
    kind = F.when(F.col("n") % 2 == 0, "Roadside").otherwise("Urban Background")
    site = F.format_string('{"@SiteCode":"S%d","@SiteName":"x","@SiteType":"%s","@Latitude":"51","@Longitude":"0","@DateOpened":"1999-01-01 00:00:00","@DateClosed":"","Species":{"@SpeciesCode":"NO2","@DateMeasurementStarted":"%s","@DateMeasurementFinished":""}}', "id", kind, day)
    doc = F.concat(F.lit('{"Sites":{"Site":'), F.when(F.col("id") % 2 == 0, site).otherwise(F.concat(F.lit("["), site, F.lit("]"))), F.lit("}}"))
    return Rd.monitor_sites(ids(spark, sf).select(doc.alias("json"))).select("station", (F.col("stratum") == "traffic").alias("traffic"), "opened")


# -- gates and rules ------------------------------------------------------------------------------

_SITES = "sites AS (SELECT s_suppkey AS station, (s_suppkey * 37 % 1790) / 10.0::DOUBLE - 89 AS lat, (s_suppkey * 101 % 3590) / 10.0::DOUBLE - 179 AS lon, ['traffic', 'background', 'unknown'][1 + s_suppkey % 3] AS stratum, DATE '1990-01-01' + (s_suppkey * 7 % 4000)::INT AS opened, CASE WHEN s_suppkey % 5 = 0 THEN DATE '1998-01-01' + (s_suppkey % 700)::INT END AS closed FROM supplier)"


def sites(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    day = lambda d, n: F.date_add(F.lit(d).cast("date"), n.cast("int"))
    return table(spark, sf, "supplier").select(k.alias("station"), (k * 37 % 1790 / 10.0 - 89).alias("lat"), (k * 101 % 3590 / 10.0 - 179).alias("lon"),
        F.element_at(F.array(F.lit("traffic"), F.lit("background"), F.lit("unknown")), (k % 3 + 1).cast("int")).alias("stratum"), day("1990-01-01", k * 7 % 4000).alias("opened"), F.when(k % 5 == 0, day("1998-01-01", k % 700)).alias("closed"))


@query(f"""WITH {_SITES} SELECT station, stratum, row_number() OVER (PARTITION BY stratum ORDER BY opened, station) AS rank FROM sites
WHERE stratum <> 'unknown' AND opened <= DATE '{EVENT}' AND coalesce(closed, DATE '{EVENT}') >= DATE '{EVENT}' AND lat >= -40 AND lat < 40 AND lon >= -120 AND lon < 120 QUALIFY rank <= 30""")
def treated_stations(spark, sf):
    ring = [(-120.0, -40.0), (120.0, -40.0), (120.0, 40.0), (-120.0, 40.0)]
    return G.pick_treated(sites(spark, sf), EVENT, ring).select("station", "stratum", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SITES} SELECT station, opened <= DATE '{EVENT}' AND coalesce(closed, DATE '{EVENT}') >= DATE '{EVENT}' AS active FROM sites")
def active_stations(spark, sf):
    return sites(spark, sf).select("station", S.active_on("opened", "closed", F.lit(EVENT).cast("date")).alias("active"))


@query(f"""WITH {MONTHS}, a AS (SELECT count(DISTINCT month) AS days, avg((v IS NULL)::INT) AS gaps, count(*) FILTER (v / 1e5 < -1 OR v / 1e5 > 1) AS odd FROM months), u AS (SELECT count(*) AS donors FROM nation WHERE n_nationkey % 5 > 0)
SELECT 'few-dates' AS issue, days::VARCHAR AS detail FROM a WHERE days < 24 UNION ALL SELECT 'no-donors', donors::VARCHAR FROM u WHERE donors = 0 UNION ALL SELECT 'gaps', gaps::VARCHAR FROM a WHERE gaps > 0.6 UNION ALL SELECT 'range', odd::VARCHAR FROM a WHERE odd > 0""")
def dataset_checks(spark, sf):
    """Monthly medians in units of 100,000 against the bounds of an index: values beyond 1 are told."""
    m = T.month_median(obs(spark, sf)).select("unit", F.col("month").alias("d"), (F.col("v") / 1e5).alias("v"))
    units = table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit"), (F.col("n_nationkey") % 5 == 0).alias("claims"))
    return G.dataset_problems(m, units)


@query(f"WITH {_IDS} SELECT id FROM ids WHERE id % 3 <> 0")
def listed_rows(spark, sf):
    """Rows whose flag is set or missing."""
    return G.listed(ids(spark, sf).withColumn("listed", F.when(F.col("id") % 3 == 0, False).when(F.col("id") % 3 == 1, True))).select("id")


@query(f"""WITH {_IDS}, p AS (SELECT id, a / 10000 - 0.4 AS point, (id % 7) / 20.0::DOUBLE AS half, (id % 11) / 50.0::DOUBLE AS p FROM ids)
SELECT id, point + half < 0 AND abs(point) >= 0.05 AND p <= 0.10 AS real FROM p""")
def real_by_rule(spark, sf):
    df = ids(spark, sf).select("id", (F.col("a") / 10000 - 0.4).alias("point"), (F.col("id") % 7 / 20.0).alias("half"), (F.col("id") % 11 / 50.0).alias("p"))
    return df.select("id", D.real_rule("point", F.col("point") - F.col("half"), F.col("point") + F.col("half"), "p", 0.05).alias("real"))


@query(f"WITH {OBS} SELECT unit, count(*) AS n FROM obs WHERE d BETWEEN DATE '{EVENT}' - INTERVAL 36 MONTH AND least(DATE '2000-03-01', (DATE '{EVENT}' + INTERVAL 18 MONTH)::DATE) GROUP BY 1")
def observed_in_window(spark, sf):
    a, b = T.window_bounds(EVENT, 18, 3, F.lit("2000-03-01").cast("date"))
    return obs(spark, sf).where(F.col("d").between(a, b)).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBS}, w AS (SELECT unit, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS week, avg(v) AS v FROM obs GROUP BY 1, 2)
SELECT unit, week, {R('v')} AS v FROM w WHERE NOT (week >= DATE '1998-12-30' AND week - 6 < DATE '1998-12-30')""")
def weeks_unmixed(spark, sf):
    """Weekly means without the week in which an event falls after its Monday."""
    w = obs(spark, sf).groupBy("unit", S.week_ending("d").alias("week")).agg(F.avg("v").alias("v"))
    return T.drop_mixed_week(w, "1998-12-30").withColumn("v", settled("v"))


_BANDS = "b AS (SELECT p_partkey AS id, (p_partkey * 7 % 97) / 100.0::DOUBLE AS b02, (p_partkey * 11 % 89) / 100.0::DOUBLE AS b03, (p_partkey * 13 % 83) / 100.0::DOUBLE AS b04, (p_partkey * 17 % 79) / 100.0::DOUBLE AS b05, (p_partkey * 19 % 73) / 100.0::DOUBLE AS b08, (p_partkey * 23 % 71) / 100.0::DOUBLE AS b11, (p_partkey * 29 % 67) / 100.0::DOUBLE AS b12 FROM part)"
_ND = lambda a, b: R(f"({a} - {b}) / nullif({a} + {b}, 0)", 5)


@query(f"""WITH {_BANDS} SELECT id, {_ND('b08', 'b04')} AS ndvi, {R('2.5 * (b08 - b04) / nullif(round(b08 + 6 * b04 - 7.5 * b02 + 1, 9), 0)', 3)} AS evi, {_ND('b08', 'b05')} AS ndre, {_ND('b03', 'b08')} AS ndwi, {_ND('b08', 'b11')} AS ndmi,
{_ND('b11', 'b12')} AS ndti, {R('(b11 + b04 - b08 - b02) / nullif(b11 + b04 + b08 + b02, 0)', 5)} AS bsi FROM b WHERE abs(b08 + 6 * b04 - 7.5 * b02 + 1) > 1e-6""")
def seven_indices(spark, sf):
    k = F.col("p_partkey")
    bands = {"B02": (7, 97), "B03": (11, 89), "B04": (13, 83), "B05": (17, 79), "B08": (19, 73), "B11": (23, 71), "B12": (29, 67)}
    df = table(spark, sf, "part").select(k.alias("id"), *[(k * m % q / 100.0).alias(b) for b, (m, q) in bands.items()])
    df = df.where(F.abs(F.col("B08") + 6 * F.col("B04") - 7.5 * F.col("B02") + 1) > 1e-6)  # a denominator of 0 up to rounding has no value in either dialect
    return df.select("id", *[settled(c, 3 if n == "EVI" else 5).alias(n.lower()) for n, c in S.spectral_indices(list(bands)).items()])


# -- batches --------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def still_to_run(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return V.remaining(o.select("id"), o.where("s = 'F'"))


_CALL = lambda x: f"CASE {x} % 3 WHEN 0 THEN 'REAL' WHEN 1 THEN 'NOT_REAL' ELSE 'CANT_TELL' END"


@query(f"""WITH {_IDS}, c AS (SELECT {_CALL('id')} AS a, {_CALL('(id + (id % 4 = 0)::INT)')} AS b FROM ids)
SELECT a, count(*) FILTER (b = 'REAL') AS "REAL", count(*) FILTER (b = 'NOT_REAL') AS "NOT_REAL", count(*) FILTER (b = 'CANT_TELL') AS "CANT_TELL" FROM c GROUP BY 1""")
def paired_calls(spark, sf):
    call = lambda x: F.element_at(F.array(F.lit("REAL"), F.lit("NOT_REAL"), F.lit("CANT_TELL")), (x % 3 + 1).cast("int"))
    i = ids(spark, sf).select("id")
    return V.paired(i.withColumn("status", call(F.col("id"))), i.withColumn("status", call(F.col("id") + (F.col("id") % 4 == 0).cast("int"))))


@query(f"""WITH {_IDS}, d AS (SELECT CASE WHEN id % 3 = 0 THEN abs(a - round(a, 0)) ELSE 0.0 END AS x FROM ids)
SELECT {R('quantile_cont(x, 0.5)', 4)} AS q50, {R('quantile_cont(x, 0.9)', 4)} AS q90, {R('quantile_cont(x, 0.99)', 4)} AS q99, {R('avg((x <= 1e-4)::INT)', 6)} AS same, count(*) AS n FROM d""")
def agreement_quantiles(spark, sf):
    i = ids(spark, sf).select("id", F.col("a").alias("v"))
    r = V.agreement(i, i.withColumn("v", F.when(F.col("id") % 3 == 0, F.round("v", 0)).otherwise(F.col("v"))), ["id"])
    return r.select(*[settled(F.col("q")[j], 4).alias(n) for j, n in enumerate(("q50", "q90", "q99"))], settled("same").alias("same"), "n")


# -- streams --------------------------------------------------------------------------------------


@query(f"WITH d AS (SELECT date_trunc('week', ts)::DATE AS begin, event_type, count(*) AS n, {R('sum(value)', 3)} AS total FROM events GROUP BY 1, 2) SELECT * FROM d WHERE begin + 7 <= (SELECT max(ts)::TIMESTAMP - INTERVAL 1 DAY FROM events)")
def stream_weeks(spark, sf):
    """Closed weeks from Monday to Sunday of a stream."""
    df = St.run_once(St.weeks_to_sunday(St.events(spark, f"{sf}/event[s].parquet")), scratch(spark))
    return df.select(F.to_date("begin").alias("begin"), "event_type", "n", settled("total", 3).alias("total"))


@query(f"SELECT user_id, count(*) AS n, {R('sum(value)', 3)} AS total, {R('max(value)', 6)} AS peak, sum(value) / count(*) < 50 AS below FROM events GROUP BY 1")
def stream_account(spark, sf):
    """The last account of each user that a stateful stream keeps."""
    df = St.run_once(St.forward_monitor(St.events(spark, f"{sf}/event[s].parquet"), 50.0), scratch(spark), "update")
    last = df.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "peak", "below"), "n").alias("x")).select("user_id", "x.*")
    return last.select("user_id", "n", settled("total", 3).alias("total"), settled("peak").alias("peak"), "below")
