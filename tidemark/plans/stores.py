"""Queries on the raster source, polygon overlays, published documents, stages and the fetch cache, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import settled
from ..operators import isolate as I
from ..operators import polygons as P
from ..sources import commits as C
from ..sources import raster as Ra
from .base import PIX, R, cut, pixels, table
from .more import scratch

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# -- rasters: blocks of 8 x 8 pixels side by side, a raster for each label -------------------------

_RASTER = f'{PIX}, rast AS (SELECT label::INT AS raster, ((block // 40) * 8 + "row")::INT AS "row", ((block % 40) * 8 + "col")::INT AS "col", v + 3 AS nir, 2 - v * 0.5::DOUBLE AS red FROM px)'


def mosaic(spark: SparkSession, sf: str) -> str:
    """The pixels of all blocks, written as tiles of two bands."""
    at = scratch(spark)
    px = pixels(spark, sf).select(F.col("label").cast("int").alias("raster"), (F.floor(F.col("block") / 40) * 8 + F.col("row")).cast("int").alias("row"), ((F.col("block") % 40) * 8 + F.col("col")).cast("int").alias("col"), (F.col("v") + 3).alias("nir"), (2 - F.col("v") * 0.5).alias("red"))
    Ra.write(px, at, ["nir", "red"], 16)
    return at


@query(f"""WITH {_RASTER} SELECT raster, "row", "col", (floor(((nir - red) / (nir + red) + 1) * 32000.0 + 0.5) + 1)::INT AS code FROM rast
WHERE raster IN (1, 3, 4) AND "row" BETWEEN 3 AND 60 AND "col" >= 10 AND "col" < 200""")
def raster_index_window(spark, sf):
    """16-bit index codes of a window: window and rasters go down to the tiles, the expression to where they are decoded."""
    df = Ra.read(spark, mosaic(spark, sf), expression="norm_diff(nir, red)", codes="index")
    return df.where("raster in (1, 3, 4) and row >= 3 and row <= 60 and col >= 10 and col < 200").select("raster", "row", "col", "code")


@query(f"""WITH {_RASTER} SELECT raster, "row", sum((floor((least(greatest(10 * log10(nir), -50.0), 15.0) + 50) * 1000 + 0.5) + 1)::INT)::BIGINT AS codes, count(*) AS n FROM rast WHERE "col" = 17 GROUP BY 1, 2""")
def raster_decibel_column(spark, sf):
    df = Ra.read(spark, mosaic(spark, sf), expression="decibel(nir)", codes="decibel").where("col = 17")
    return df.groupBy("raster", "row").agg(F.sum("code").cast("long").alias("codes"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RASTER} SELECT raster AS t, ("row" // 24) || ':' || ("col" // 24) AS parcel, {R("avg((nir - red) / (nir + red))", 5)} AS v, count(*) AS n FROM rast WHERE "row" < 96 GROUP BY 1, 2""")
def raster_stack_means(spark, sf):
    """Mean index of each polygon and date of a stack, whose bands are parameters."""
    df = Ra.read(spark, mosaic(spark, sf), expression="norm_diff(nir,red)").where("row < 96")
    parcel = F.concat_ws(":", F.floor(F.col("row") / 24), F.floor(F.col("col") / 24))
    return df.groupBy(F.col("raster").alias("t"), parcel.alias("parcel")).agg(settled(F.avg("value"), 5).alias("v"), F.count(F.lit(1)).alias("n"))


# -- polygons: frames and squares on the unit grid, a zone for each nation --------------------------

_RECTS = "rects AS (SELECT s_suppkey AS id, s_nationkey AS zone, s_suppkey * 37 % 50 AS x0, s_suppkey * 91 % 40 AS y0, 3 + s_suppkey % 5 AS w, 3 + s_suppkey % 4 AS h FROM supplier)"
_CELLS = """cells AS (SELECT DISTINCT zone, id % 4 = 0 AS off, x, y FROM (SELECT *, unnest(range(y0, y0 + h)) AS y FROM (SELECT *, unnest(range(x0, x0 + w)) AS x FROM rects))
  WHERE NOT (w >= 5 AND h >= 5 AND x > x0 AND x < x0 + w - 1 AND y > y0 AND y < y0 + h - 1))"""
_MEASURES = """SELECT c.zone AS zone, count(*)::DOUBLE AS area, sum((l.x IS NULL)::INT + (r.x IS NULL)::INT + (u.x IS NULL)::INT + (d.x IS NULL)::INT)::DOUBLE AS perimeter FROM one c
  LEFT JOIN one l ON l.zone = c.zone AND l.x = c.x - 1 AND l.y = c.y LEFT JOIN one r ON r.zone = c.zone AND r.x = c.x + 1 AND r.y = c.y
  LEFT JOIN one u ON u.zone = c.zone AND u.x = c.x AND u.y = c.y + 1 LEFT JOIN one d ON d.zone = c.zone AND d.x = c.x AND d.y = c.y - 1 GROUP BY 1"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Features: a rectangle for each supplier, with a hole if it is large; every fourth is taken off."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.alias("feature"), F.col("s_nationkey").alias("zone"), F.when(k % 4 == 0, "b").otherwise("a").alias("side"), (k * 37 % 50).alias("x0"), (k * 91 % 40).alias("y0"), (3 + k % 5).alias("w"), (3 + k % 4).alias("h"))
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = lambda d: F.array(at(F.col("x0") + d, F.col("y0") + d), at(F.col("x0") + F.col("w") - d, F.col("y0") + d), at(F.col("x0") + F.col("w") - d, F.col("y0") + F.col("h") - d), at(F.col("x0") + d, F.col("y0") + F.col("h") - d))
    hole = (F.col("w") >= 5) & (F.col("h") >= 5)
    return s.select("zone", "side", "feature", F.posexplode(F.when(hole, F.array(ring(0), ring(1))).otherwise(F.array(ring(0)))).alias("ring", "points"))


def measured(rings: DataFrame) -> DataFrame:
    """zone, area, perimeter of rings."""
    p, n = F.col("points"), F.size("points")
    nxt = lambda i: p[F.pmod(i + 1, n)]
    at = F.sequence(F.lit(0), n - 1)
    doubled = F.aggregate(at, F.lit(0.0), lambda a, i: a + p[i]["x"] * nxt(i)["y"] - nxt(i)["x"] * p[i]["y"])
    around = F.aggregate(at, F.lit(0.0), lambda a, i: a + F.hypot(nxt(i)["x"] - p[i]["x"], nxt(i)["y"] - p[i]["y"]))
    return rings.groupBy("zone").agg(settled(F.sum(doubled / 2)).alias("area"), settled(F.sum(around)).alias("perimeter"))


@query(f"WITH {_RECTS}, {_CELLS}, one AS (SELECT DISTINCT zone, x, y FROM cells) {_MEASURES}")
def zone_union(spark, sf):
    """All features of a zone as one boundary, measured by its rings."""
    return measured(P.union(frames(spark, sf)))


@query(f"WITH {_RECTS}, {_CELLS}, one AS (SELECT zone, x, y FROM cells WHERE NOT off EXCEPT SELECT zone, x, y FROM cells WHERE off) {_MEASURES}")
def zone_taken_off(spark, sf):
    """What a zone includes less what is taken off it, for the zones of which something is left."""
    f = frames(spark, sf)
    left = P.area(P.trapezoids(f)).where("area > 0").select("zone")
    return measured(P.difference(f.join(left, "zone", "left_semi")))


@query(f"""WITH {_RECTS}, {_CELLS}, one AS (SELECT DISTINCT zone, x, y FROM cells), box AS (SELECT zone, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM one GROUP BY 1),
lat AS (SELECT zone, i, unnest(range(floor((y0 - 12) / 4.0)::BIGINT, floor((y1 + 12) / 4.0)::BIGINT + 1)) AS j FROM (SELECT *, unnest(range(floor((x0 - 12) / 4.0)::BIGINT, floor((x1 + 12) / 4.0)::BIGINT + 1)) AS i FROM box)),
d AS (SELECT lat.zone, i, j, min(sqrt(power(greatest(x - i * 4 - 4, i * 4 - x - 1, 0), 2) + power(greatest(y - j * 4 - 4, j * 4 - y - 1, 0), 2))) AS gap,
  min(sqrt(power(greatest(x - i * 4 - 2, i * 4 + 2 - x - 1, 0), 2) + power(greatest(y - j * 4 - 2, j * 4 + 2 - y - 1, 0), 2))) AS distance FROM lat JOIN one ON one.zone = lat.zone GROUP BY ALL)
SELECT zone, i || ':' || j AS cell, {R('gap')} AS gap, {R('distance')} AS distance FROM d WHERE gap >= 3 AND distance <= 12""")
def polygon_controls(spark, sf):
    """Control cells around zones of frames and squares: at least 3 off, edge to edge, centres within 12."""
    c = P.control_cells(frames(spark, sf), 4.0, 3.0, 12.0)
    return c.select("zone", "cell", settled("gap").alias("gap"), settled("distance").alias("distance"))


# -- published documents, stages, fetched bodies ----------------------------------------------------


@query("""WITH a AS (SELECT o_custkey AS id, max(o_totalprice)::DOUBLE AS v, 'first' AS writer FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
b AS (SELECT o_custkey AS id, min(o_totalprice)::DOUBLE AS v, 'second' AS writer FROM orders GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)""")
def published_once(spark, sf):
    """Two batches of documents under overlapping ids: what is published stays as it is."""
    at, o = scratch(spark), table(spark, sf, "orders")
    C.publish(o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").cast("double").alias("v"), F.lit("first").alias("writer")), at)
    C.publish(o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_totalprice").cast("double").alias("v"), F.lit("second").alias("writer")), at)
    return C.published(spark, at)


@query("SELECT s_nationkey AS n, count(*) AS sites, sum(s_suppkey)::BIGINT AS keys FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def stage_replaced(spark, sf):
    """A stage made, found again, and replaced as a whole when its content is another one."""
    at, s = scratch(spark), table(spark, sf, "supplier")
    C.stage(spark, at, "all suppliers", lambda: s.select("s_suppkey", "s_nationkey"))
    kept = C.stage(spark, at, "all suppliers", lambda: s.where("s_suppkey < 0").select("s_suppkey", "s_nationkey"))  # isn't made: it is there
    C.stage(spark, at, "with money", lambda: kept.join(s.where("s_acctbal > 0").select("s_suppkey"), "s_suppkey", "left_semi"))
    return C.staged(spark, at).groupBy(F.col("s_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("sites"), F.sum("s_suppkey").alias("keys"))


@query("SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n_bytes FROM pages")
def fetched_pages(spark, sf):
    """Half of the pages are fetched, then all are asked for: only the other half is fetched then."""
    at, pages = scratch(spark), table(spark, sf, "pages")
    asked = pages.select("page_id", "url", F.create_map(F.lit("page"), F.col("page_id").cast("string")).alias("params"))
    web = pages.select(F.col("page_id").cast("string").alias("page"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    fetch = lambda missing: missing.withColumn("page", F.col("params")["page"]).join(web, "page").select("request", "body")
    C.fetched(asked.where("page_id % 2 = 0"), at, fetch).count()
    return C.fetched(asked, at, fetch).select("page_id", "digest", F.octet_length("body").cast("long").alias("n_bytes"))


# -- scenes of which some fail -----------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id AS scene, embedding AS v, vec_id % 7 = 3 AS torn, vec_id % 11 = 5 AS negative FROM embeddings)
SELECT scene, CASE WHEN NOT torn AND NOT negative THEN round(cast(list_sum([x::DOUBLE for x in v]) / len(v) AS DECIMAL(38,10)), 5)::DOUBLE END AS mean, CASE WHEN torn OR negative THEN 'failed' END AS reason, CASE WHEN torn THEN 'JSONDecodeError' WHEN negative THEN 'ValueError' END AS error FROM e""")
def isolated_scenes(spark, sf):
    """Scenes as text, of which some are torn and some refused: each is a result or a receipt."""
    e = table(spark, sf, "embeddings")
    k, text = F.col("vec_id"), F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    scenes = e.select(k.alias("scene"), F.when(k % 7 == 3, F.substring(text, 1, 20)).otherwise(text).alias("payload"), (k % 11 == 5).alias("negative"))

    def work(scene: dict):
        import json

        v = json.loads(scene["payload"])
        if scene["negative"]:
            raise ValueError("the scene has a negative area")
        yield (float(sum(v) / len(v)),)

    done = cut(I.isolated(scenes, "scene", work, "mean double", tries=2, budget=5))
    failed = I.receipts(done).select("scene", F.lit(None).cast("double").alias("mean"), F.lit("failed").alias("reason"), F.regexp_extract("detail", r"^(\w+)", 1).alias("error"))
    return I.results(done).select(F.col("_scene").alias("scene"), settled("mean", 5).alias("mean"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error")).unionByName(failed)
