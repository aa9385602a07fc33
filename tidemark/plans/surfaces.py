"""Queries by SQL functions, table functions, state with timers and tiles with halos, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import sql as Sq
from ..functions.scalar import settled
from ..operators import grid as X
from ..streaming import events as St
from .base import EVENT, PIX, R, table
from .more import scratch

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# -- SQL functions ----------------------------------------------------------------------------------

_PLACES = "pl AS (SELECT c_custkey AS id, (c_custkey * 37 % 1790) / 10.0::DOUBLE - 89 AS lat, (c_custkey * 101 % 3590) / 10.0::DOUBLE - 179 AS lon, c_acctbal::DOUBLE AS a, c_nationkey AS n, DATE '1999-01-01' + (c_custkey % 900)::INT - 400 AS day FROM customer)"


def places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1790 / 10.0 - 89).alias("lat"), (k * 101 % 3590 / 10.0 - 179).alias("lon"), F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").alias("n"), F.date_add(F.lit("1999-01-01").cast("date"), (k % 900 - 400).cast("int")).alias("day"))


def places_by_columns(df: DataFrame) -> DataFrame:
    """The same as sql_functions, written with columns."""
    nd = S.norm_diff(F.col("a") + 2000, F.col("n") * 100.0)
    return df.select(
        "id", settled(nd).alias("nd"), S.encode_index(nd).alias("code"), settled(S.decibel("a"), 5).alias("db"), settled(S.reflectance(F.col("a"), F.when(F.col("n") % 2 == 0, "04.00").otherwise("N0213"))).alias("refl"),
        settled(S.great_circle_m("lat", "lon", F.lit(51.5), F.lit(-0.1)), 2).alias("metres"), S.utm_epsg("lon", "lat").alias("epsg"), F.floor(F.datediff("day", F.lit(EVENT).cast("date")) / 60).cast("int").alias("k"), S.off_season("day", F.col("lat")).alias("off"),
    )


@query(f"""WITH {_PLACES}, v AS (SELECT *, CASE WHEN a + 2000 + n * 100.0::DOUBLE > 0 THEN (a + 2000 - n * 100.0::DOUBLE) / (a + 2000 + n * 100.0::DOUBLE) END AS nd FROM pl)
SELECT id, {R('nd')} AS nd, coalesce((floor((nd + 1) * 32000.0::DOUBLE + 0.5) + 1)::INT, 65535) AS code, CASE WHEN a > 0 THEN {R('10 * log10(CASE WHEN a > 0 THEN a END)', 5)} END AS db, {R("CASE WHEN n % 2 = 0 THEN greatest(a - 1000, 0) ELSE a END / 10000")} AS refl,
{R("2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(51.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * power(sin(radians(-0.1 - lon) / 2), 2))))", 2)} AS metres,
(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(floor((lon + 180) / 6) + 1, 1), 60))::INT AS epsg, floor(date_diff('day', DATE '{EVENT}', day) / 60.0)::INT AS k,
CASE WHEN lat < 0 THEN (month(day) + 5) % 12 + 1 ELSE month(day) END IN (10, 11, 12, 3, 4) AS off FROM v""")
def sql_functions(spark, sf):
    """The scalar library called from SQL: its functions are inlined, so that the plan is the one that columns give."""
    Sq.register(spark)
    places(spark, sf).createOrReplaceTempView("tm_places")
    return spark.sql(f"""
        SELECT id, round(CAST(nd AS DECIMAL(38, 10)), 6)::DOUBLE AS nd, tm_index_code(nd) AS code, round(CAST(tm_decibel(a) AS DECIMAL(38, 10)), 5)::DOUBLE AS db,
               round(CAST(tm_reflectance(a, if(n % 2 = 0, '04.00', 'N0213')) AS DECIMAL(38, 10)), 6)::DOUBLE AS refl,
               round(CAST(tm_great_circle_m(lat, lon, 51.5D, -0.1D) AS DECIMAL(38, 10)), 2)::DOUBLE AS metres, tm_utm_epsg(lon, lat) AS epsg, tm_bin(day, DATE '{EVENT}', 60) AS k, tm_off_season(day, lat) AS off
        FROM (SELECT *, tm_norm_diff(a + 2000, n * 100D) AS nd FROM tm_places)""")


@query("""WITH z AS (SELECT s_suppkey AS id, s_suppkey * 37 % 500 AS x0, s_suppkey * 91 % 700 AS y0, s_suppkey * 37 % 500 + s_nationkey * 11 AS x1, s_suppkey * 91 % 700 + s_nationkey * 7 AS y1 FROM supplier)
SELECT tx, ty, count(*) AS zones FROM (SELECT tx, unnest(range(y0 // 60, y1 // 60 + 1)) AS ty FROM (SELECT *, unnest(range(x0 // 60, x1 // 60 + 1)) AS tx FROM z)) GROUP BY 1, 2""")
def sql_tiles(spark, sf):
    """Zones by the tiles that they touch, through a table function joined laterally."""
    Sq.register(spark)
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    table(spark, sf, "supplier").select((k * 37 % 500).cast("double").alias("x0"), (k * 91 % 700).cast("double").alias("y0"), (k * 37 % 500 + n * 11).cast("double").alias("x1"), (k * 91 % 700 + n * 7).cast("double").alias("y1")).createOrReplaceTempView("tm_zones")
    return spark.sql("SELECT tx, ty, count(*) AS zones FROM tm_zones, LATERAL tm_tiles(x0, y0, x1, y1, 60D) GROUP BY tx, ty")


@query("""WITH u AS (SELECT c_nationkey AS verdict, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1)
SELECT verdict, 'treated' AS kind, 0::BIGINT AS j, NULL::DOUBLE AS theta FROM u UNION ALL SELECT verdict, 'time', unnest(range(1, 4)), NULL FROM u
UNION ALL SELECT verdict, 'space', CASE WHEN n <= 40 THEN i ELSE round_even(i * (n - 1) / 39.0::DOUBLE, 0)::BIGINT END, NULL FROM (SELECT *, unnest(range(0, least(n, 40))) AS i FROM u)
UNION ALL SELECT verdict, 'theta', i, -0.5::DOUBLE + 2 * 0.5::DOUBLE * i / 10.0::DOUBLE FROM (SELECT *, unnest(range(0, 11)) AS i FROM u)""")
def expanded_tasks(spark, sf):
    """The fits of a verdict for each nation, whose customers are the units, from a table function over the table partitioned by verdict."""
    Sq.register(spark)
    table(spark, sf, "customer").select(F.col("c_nationkey").alias("verdict"), (F.col("c_custkey") + 1).alias("unit")).createOrReplaceTempView("tm_panel")
    return spark.sql("SELECT * FROM tm_tasks(TABLE(tm_panel) PARTITION BY (verdict), 40, 3, 11, 0.5D)")


# -- state with timers --------------------------------------------------------------------------------

_WIDTH_S, _FLOOR = 2 * 86_400, 30.0


@query(f"""WITH p AS (SELECT user_id, epoch_ms(ts)::BIGINT // {_WIDTH_S * 1000} AS period, cast(avg(value) AS DECIMAL(38, 10))::DOUBLE AS e FROM events GROUP BY 1, 2),
c AS (SELECT * FROM p WHERE (period + 1) * {_WIDTH_S * 1000} <= (SELECT epoch_ms(max(ts)) - 86400000 FROM events)),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS back, max(e) OVER (PARTITION BY user_id) AS peak FROM c),
q AS (SELECT *, min(CASE WHEN e = peak THEN period END) OVER (PARTITION BY user_id) AS peak_period FROM w),
g AS (SELECT user_id, count(*) AS periods, max(peak) AS peak, max(peak_period) AS peak_period, avg(e) FILTER (back <= 2) AS recent, max(period) AS last, min(period) FILTER (period > peak_period AND e < {_FLOOR}) AS below FROM q GROUP BY 1)
SELECT user_id, periods, {R('peak')} AS peak, peak_period, {R('recent')} AS recent, peak >= {_FLOOR} AND recent < {_FLOOR} AND recent < 0.45 * peak AS detected,
CASE WHEN peak >= {_FLOOR} AND recent < {_FLOOR} AND recent < 0.45 * peak THEN coalesce(below, last) END::DOUBLE AS reversal_period FROM g""")
def stream_reversals(spark, sf):
    """Forward monitoring: periods of users close by timers in state, and each closing says whether the user has fallen from its peak.

    The table's files are one batch, as its SQL has one watermark for all of them.
    """
    St.with_rocksdb(spark)
    s = St.reversals(St.events(spark, f"{sf}/event[s].parquet", None), _WIDTH_S * 1000, _FLOOR)
    return last_closings(St.run_once(s, scratch(spark)))


def last_closings(rows: DataFrame) -> DataFrame:
    one = F.max_by(F.struct("peak", "peak_period", "recent", "detected", "reversal_period"), "period").alias("x")
    df = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("periods"), one).select("user_id", "periods", "x.*")
    return df.select("user_id", "periods", settled("peak").alias("peak"), "peak_period", settled("recent").alias("recent"), "detected", F.col("reversal_period").cast("double").alias("reversal_period"))


# -- tiles with halos ---------------------------------------------------------------------------------

_DEM = f'{PIX}, dem AS (SELECT (block // 40) * 8 + "row" AS r, (block % 40) * 8 + "col" AS c, v * 100 AS elev, ((block * 7 + "col") % 5)::INT AS cover FROM px)'
_SLOPES = f"""{_DEM}, s AS (SELECT d.*, degrees(atan(sqrt(power((e.elev - w.elev) / 60.0, 2) + power((t.elev - u.elev) / 60.0, 2)))) AS slope FROM dem d
LEFT JOIN dem w ON w.r = d.r AND w.c = d.c - 1 LEFT JOIN dem e ON e.r = d.r AND e.c = d.c + 1 LEFT JOIN dem u ON u.c = d.c AND u.r = d.r - 1 LEFT JOIN dem t ON t.c = d.c AND t.r = d.r + 1)"""


def terrain(spark: SparkSession, sf: str) -> DataFrame:
    """One surface of all blocks side by side."""
    from .base import pixels

    b = F.col("block")
    return pixels(spark, sf).select(F.lit(0).alias("raster"), (F.floor(b / 40) * 8 + F.col("row")).cast("long").alias("row"), (b % 40 * 8 + F.col("col")).cast("long").alias("col"), (F.col("v") * 100).alias("elev"), ((b * 7 + F.col("col")) % 5).cast("int").alias("cover"))


@query(f"""WITH {_SLOPES} SELECT r AS "row", c AS "col", {R('slope', 4)} AS slope FROM s""")
def tile_slopes(spark, sf):
    """Slopes over tiles of 12 pixels with their neighbours' edges are those of the whole surface."""
    return X.tiled_slopes(terrain(spark, sf), 30.0, ["raster"], 12).select("row", "col", settled("slope", 4).alias("slope"))


@query(f"""WITH {_SLOPES}, z AS (SELECT *, (r // 50) * 100 + c // 70 AS zone FROM s), n AS (SELECT zone, cover, count(*) AS n FROM z GROUP BY 1, 2)
SELECT zone, {R('avg(slope)', 3)} AS slope, (SELECT cover FROM n WHERE n.zone = z.zone ORDER BY n DESC, cover LIMIT 1) AS cover FROM z GROUP BY zone""")
def tile_covariates(spark, sf):
    """Mean slope and commonest cover of zones that span tiles."""
    t = terrain(spark, sf)
    zones = t.select("raster", "row", "col", (F.floor(F.col("row") / 50) * 100 + F.floor(F.col("col") / 70)).alias("zone"))
    return X.tiled_covariates(t, zones, 30.0, ["raster"], 16).select("zone", settled("slope", 3).alias("slope"), "cover")
