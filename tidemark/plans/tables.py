"""Queries on single operators: scalar functions, gates, top-k, sets, joins, grids, decisions, portfolio, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import settled
from ..operators import aggregates as A
from ..operators import decide as D
from ..operators import gates as G
from ..operators import grid as X
from ..operators import joins as J
from ..operators import sets as U
from ..operators import topk as K
from ..operators import windows as W
from ..sources import readers as Rd
from ..sources import sinks as Sk
from .base import PIX, R, obs, pixels, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- scalar functions -----------------------------------------------------------------------------

_LL = "ll AS (SELECT s_suppkey AS id, s_nationkey, (s_suppkey * 37 % 1790) / 10.0::DOUBLE - 89 AS lat, (s_suppkey * 101 % 3590) / 10.0::DOUBLE - 179 AS lon, s_acctbal FROM supplier)"


def places(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), "s_nationkey", ((k * 37 % 1790).cast("double") / 10 - 89).alias("lat"), ((k * 101 % 3590).cast("double") / 10 - 179).alias("lon"), "s_acctbal")


@query(f"""WITH {_LL} SELECT id, {R('2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(51.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * power(sin(radians(-0.1 - lon) / 2), 2))))', 2)} AS metres,
((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(greatest(floor((lon + 180) / 6) + 1, 1), 60))::INT AS epsg FROM ll""")
def great_circle_utm(spark, sf):
    return places(spark, sf).select("id", settled(S.great_circle_m("lat", "lon", F.lit(51.5), F.lit(-0.1)), 2).alias("metres"), S.utm_epsg("lon", "lat").alias("epsg"))


@query(f"""WITH p AS (SELECT p_partkey AS id, p_size * 400 AS b8, floor(p_retailprice)::INT AS b4, p_size % 7 AS bl, p_retailprice FROM part), r AS (SELECT id, CASE WHEN bl >= 4 THEN greatest(b8 - 1000, 0) ELSE b8 END / 10000.0::DOUBLE AS r8, CASE WHEN bl >= 4 THEN greatest(b4 - 1000, 0) ELSE b4 END / 10000.0::DOUBLE AS r4 FROM p)
SELECT id, {R('r8')} AS r8, {R('CASE WHEN r8 + r4 > 0 THEN (r8 - r4) / (r8 + r4) END')} AS ndvi, {R('CASE WHEN r4 > 0 THEN 10 * log10(r4) END')} AS db FROM r""")
def reflectance_indices(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 400).alias("b8"), F.floor("p_retailprice").cast("int").alias("b4"), F.format_string("%02d.00", F.col("p_size") % 7).alias("bl"))
    r = p.select("id", S.reflectance("b8", "bl").alias("r8"), S.reflectance("b4", "bl").alias("r4"))
    return r.select("id", settled("r8").alias("r8"), settled(S.norm_diff("r8", "r4")).alias("ndvi"), settled(S.decibel("r4")).alias("db"))


@query(f"""WITH {PIX}, v AS (SELECT block, "row", "col", greatest(least(v, 1), -1) AS v FROM px), e AS (SELECT *, (floor((v + 1) * 32000 + 0.5) + 1)::INT AS code FROM v)
SELECT block, "row", "col", code, {R('(code - 1) / 32000.0 - 1')} AS back FROM e""")
def index_codes(spark, sf):
    p = pixels(spark, sf).withColumn("v", F.greatest(F.least("v", F.lit(1.0)), F.lit(-1.0))).withColumn("code", S.encode_index("v"))
    back = S.decode_index(F.floor(F.col("code") / 256), F.col("code") % 256)["value"]
    return p.select("block", "row", "col", "code", settled(back).alias("back"))


@query("SELECT c_custkey AS id, substr(sha256(concat_ws('|', c_custkey::VARCHAR, c_mktsegment, c_nationkey::VARCHAR)), 1, 16) AS content FROM customer")
def content_ids(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), S.content_id("c_custkey", "c_mktsegment", "c_nationkey").alias("content"))


@query(f"""WITH {_LL} SELECT id, {R('111320.0 * 0.00025 * cos(radians(lat))')} AS width, CASE WHEN s_acctbal < 5 THEN 'small' WHEN s_acctbal < 25 THEN 'medium' ELSE 'large' END AS size,
lpad(abs(ceil(lat / 10) * 10)::INT::VARCHAR, 2, '0') || CASE WHEN ceil(lat / 10) >= 0 THEN 'N' ELSE 'S' END || '_' || lpad(abs(floor(lon / 10) * 10)::INT::VARCHAR, 3, '0') || CASE WHEN floor(lon / 10) >= 0 THEN 'E' ELSE 'W' END AS tile FROM ll""")
def tiles_and_sizes(spark, sf):
    return places(spark, sf).select("id", settled(S.pixel_m("lat")["width"]).alias("width"), S.size_bucket("s_acctbal").alias("size"), S.tile_name("lat", "lon").alias("tile"))


@query("SELECT p_partkey AS id, CASE WHEN lower(p_type) ~ 'traffic|roadside|kerb' THEN 'traffic' WHEN lower(p_type) ~ 'background|suburban' THEN 'background' ELSE 'unknown' END AS stratum, least(abs(p_size * 7 - 200), 366 - abs(p_size * 7 - 200)) AS gap, round(0.5 * (CASE WHEN p_size * 7 >= 288 OR p_size * 7 <= 120 THEN 1 ELSE 0 END + least(greatest(cos((p_size * 7 - 30) / 90.0), 0), 1)), 6)::DOUBLE AS weight FROM part")
def calendar_weights(spark, sf):
    doy = F.col("p_size") * 7
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.site_stratum("p_type").alias("stratum"), S.doy_distance(doy, F.lit(200)).alias("gap"), F.round(S.off_season_weight(doy), 6).alias("weight"))


@query(f"""WITH {_LL}, e AS (SELECT id, s_acctbal / 40000 AS e FROM ll) SELECT id, {R("CASE WHEN e > 0 THEN (0.2 + least(greatest(e / 0.2, 0), 1) * 0.8) * 12 ELSE 0 END")} AS central, {R("CASE WHEN e > 0 THEN 24 ELSE 0 END")} AS high FROM e""")
def carbon_band(spark, sf):
    c = S.carbon(F.col("s_acctbal") / 40000, F.lit(12.0), F.lit(True))
    return places(spark, sf).select("id", settled(c["central"]).alias("central"), settled(c["high"]).alias("high"))


# -- gates, top-k, sets ---------------------------------------------------------------------------


@query("SELECT user_id AS id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def tile_per_minute(spark, sf):
    e = table(spark, sf, "events").withColumn("m", F.date_trunc("minute", "ts"))
    return K.best_per_key(e, ["user_id", "m"], [F.desc("value"), "event_id"]).select(F.col("user_id").alias("id"), "event_id", "ts")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber::VARCHAR DESC, l_partkey) AS r FROM lineitem) WHERE r = 1")
def latest_version(spark, sf):
    return U.latest_version(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT k, o_orderkey AS scene, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_totalprice, o_orderkey) AS rank FROM (SELECT *, floor(date_diff('day', DATE '1999-01-01', o_orderdate::DATE) / 10.0)::INT AS k FROM orders)) WHERE rank <= 2")
def top_per_bin(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("cloud"))
    return K.top_per_bin(o, "1999-01-01", 10, 2).select("k", "scene", F.col("rank").cast("long").alias("rank"))


@query("SELECT id, stratum FROM (SELECT c_custkey AS id, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('1999-01-01:' || c_mktsegment || ':' || c_custkey::VARCHAR), c_custkey) AS r FROM customer) WHERE r <= 30")
def hash_budget_sample(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"))
    return K.hash_budget(c, 30, "1999-01-01", by=["stratum"])


@query("WITH r AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer) SELECT id, pos FROM r WHERE pos IN (SELECT round_even(i * (n - 1) / 39.0, 0)::BIGINT FROM (SELECT unnest(range(0, 40)) AS i), (SELECT count(*) AS n FROM customer))")
def even_thinning(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return K.thin_evenly(c, ["c_acctbal", "id"], 40).select("id", "pos")


@query("SELECT c_custkey AS id, sha256('session:5:' || c_custkey::VARCHAR) AS order_key FROM customer")
def session_order(spark, sf):
    return K.hash_order(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "session", 5)


@query("SELECT user_id AS unit, event_type AS orbit, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS t FROM events GROUP BY 1, 2)) WHERE r = 1")
def modal_type_by_user(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("unit"), F.col("event_type").alias("orbit")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t"))
    return K.best_per_key(g, ["unit"], [F.desc("n"), "t", "orbit"]).select("unit", "orbit", "n")


@query("WITH b AS (SELECT event_type AS o FROM events GROUP BY 1 ORDER BY count(*) DESC, min(ts), event_type LIMIT 1) SELECT event_id, event_type FROM events, b WHERE event_type = o")
def orbit_mode_keep(spark, sf):
    keep, _ = A.modal_orbit(table(spark, sf, "events"), "event_type", "ts")
    return keep.select("event_id", "event_type")


_POL = "pol AS (SELECT * FROM (VALUES ('a', 10.0, 20.0, 3000.0), ('b', -40.0, 100.0, 2500.0), ('c', 50.0, -60.0, 2000.0)) t(name, plat, plon, km))"


@query(f"""WITH {_LL}, {_POL}, h AS (SELECT id, min(name) AS policy FROM ll, pol WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2)))) <= km * 1000 GROUP BY 1)
SELECT ll.id AS station, policy FROM ll LEFT JOIN h USING (id)""")
def policy_screen(spark, sf):
    p = spark.createDataFrame([("a", "1999-01-01", 10.0, 20.0, 3000.0), ("b", "1999-01-01", -40.0, 100.0, 2500.0), ("c", "1999-01-01", 50.0, -60.0, 2000.0)], "name string, launched string, lat double, lon double, radius_km double")
    return G.contaminated(places(spark, sf).withColumnRenamed("id", "station"), p, "1998-01-01", "2000-01-01").select("station", F.col("policy.name").alias("policy"))


@query(f"""WITH {_LL} SELECT id, lat BETWEEN -20 AND 60 AND lon BETWEEN -90 AND 110 AS meets, NOT (lat > 85 OR lat < -85) AS fine FROM ll""")
def footprint_gate(spark, sf):
    p = places(spark, sf)
    boxes = p.select("id", "lat", F.struct(F.col("lon").alias("west"), F.col("lat").alias("south"), F.col("lon").alias("east"), F.col("lat").alias("north")).alias("bbox"))
    hit = G.covering(boxes, (-90.0, -20.0, 110.0, 60.0)).select("id", F.lit(True).alias("m"))
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (300, 0), (300, 300), (0, 300))])
    return boxes.join(hit, "id", "left").select("id", F.coalesce("m", F.lit(False)).alias("meets"), G.polygon_problem(ring, F.col("lat")).isNull().alias("fine"))


@query(f"""WITH {_LL}, edge AS (SELECT * FROM (VALUES (60.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 60.0::DOUBLE), (0, 60, -60, 0), (-60, 0, 0, -60), (0, -60, 60, 0)) t(x1, y1, x2, y2))
SELECT id FROM ll WHERE (SELECT count(*) FROM edge WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1""")
def inside_polygon(spark, sf):
    """Edges on the polygon's left count as inside, those on its right don't."""
    return places(spark, sf).where(G.in_polygon("lon", "lat", [(60.0, 0.0), (0.0, 60.0), (-60.0, 0.0), (0.0, -60.0)])).select("id")


@query("WITH a AS (SELECT o_custkey AS key, o_orderkey AS id, o_orderdate AS ts FROM orders), l AS (SELECT c.o_custkey AS key, c.o_orderkey AS id, c.o_orderdate AS ts, c.o_totalprice AS x FROM orders c WHERE o_orderpriority = '1-URGENT'), j AS (SELECT a.id, a.key, a.ts, l.ts AS at, l.id AS lookup_id, l.x, row_number() OVER (PARTITION BY a.id ORDER BY l.ts DESC, l.id DESC) AS r FROM a LEFT JOIN l ON l.key = a.key AND l.ts <= a.ts) SELECT id, key, lookup_id::DOUBLE AS lookup_id, x FROM j WHERE r = 1")
def nearest_event_asof(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("x"), "o_orderpriority")
    return W.as_of(o.select("id", "key", "ts"), o.where("o_orderpriority = '1-URGENT'").select("id", "key", "ts", "x")).select("id", "key", F.col("lookup_id").cast("double").alias("lookup_id"), "x")


@query("SELECT id, src FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC) AS r FROM (SELECT c_custkey AS id, 'a' AS src FROM customer UNION ALL SELECT o_custkey, 'b' FROM (SELECT DISTINCT o_custkey FROM orders))) WHERE r = 1")
def chunks_keep_last(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("a").alias("src"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("b").alias("src")).distinct()
    return U.keep_last([a, b], ["id"])


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def zone_difference(spark, sf):
    return U.outside(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT s_suppkey AS id, 7 AS seed FROM supplier")
def merged_draws(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(7).alias("seed"))
    return U.merged_draws([s.where("id % 2 = 0"), s.where("id % 2 = 1")])


@query("SELECT id, doc_id IS NOT NULL AS labelled, coalesce(quality, -1) AS quality FROM (SELECT d.doc_id AS id, l.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
def sidecar_lookup(spark, sf):
    a = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("labelled"), "quality")
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(False).alias("labelled"), F.lit(-1).alias("quality"))
    return J.first_of(a, b)


# -- grids ----------------------------------------------------------------------------------------


@query(f"""WITH {PIX}, g AS (SELECT block, count(v) AS n, stddev_pop(v) AS texture_std, avg(v) AS albedo, avg(power(v - m, 3)) AS m3, avg(power(v - m, 2)) AS m2, avg(power(v - m, 4)) AS m4 FROM (SELECT *, avg(v) OVER (PARTITION BY block) AS m FROM px) GROUP BY 1)
SELECT block, {R('texture_std')} AS texture_std, {R('albedo')} AS albedo, {R('m3 / power(m2, 1.5)')} AS skew, {R('(power(m3 / power(m2, 1.5), 2) + 1) / (m4 / (m2 * m2))')} AS bimodality FROM g""")
def block_textures(spark, sf):
    g = X.textures(pixels(spark, sf), ["block"])
    return g.select("block", *[settled(n).alias(n) for n in ("texture_std", "albedo", "skew", "bimodality")])


@query(f"""WITH {PIX}, d AS (SELECT block, power(v - lag(v) OVER (PARTITION BY block, "row" ORDER BY "col"), 2) AS h, power(v - lag(v) OVER (PARTITION BY block, "col" ORDER BY "row"), 2) AS w FROM px)
SELECT block, {R('(sum(h) + sum(w)) / (count(h) + count(w))')} AS contrast FROM d GROUP BY 1""")
def block_contrast(spark, sf):
    return X.contrast(pixels(spark, sf), ["block"]).withColumn("contrast", settled("contrast"))


@query(f"""WITH {PIX} SELECT block, {R('avg(v) FILTER (NOT ("row" BETWEEN 2 AND 5 AND "col" BETWEEN 2 AND 5)) / nullif(avg(v) FILTER ("row" BETWEEN 2 AND 5 AND "col" BETWEEN 2 AND 5), 0)', 3)} AS perimeter_ratio FROM px GROUP BY 1""")
def block_perimeter(spark, sf):
    return X.perimeters(pixels(spark, sf), ["block"]).withColumn("perimeter_ratio", settled("perimeter_ratio", 3))


@query(f"""WITH {PIX} SELECT label AS zone, {R('avg(v) FILTER (v > -0.1)')} AS mean, count(*) FILTER (v > -0.1) AS n_clear, count(*) AS n_all FROM px WHERE label <> 0 GROUP BY 1""")
def zonal_mean(spark, sf):
    p = pixels(spark, sf).select(F.col("label").alias("zone"), "v", (F.col("v") > -0.1).alias("clear"))
    return A.zone_means(p, ["zone"]).select("zone", settled("mean").alias("mean"), "n_clear", "n_all")


@query(f"""WITH {PIX} SELECT "row", "col", {R('median(v)')} AS median, count(v) AS n FROM px GROUP BY 1, 2""")
def median_composite(spark, sf):
    return A.median_composite(pixels(spark, sf)).withColumn("median", settled("median"))


@query(f"""WITH {PIX}, t AS (SELECT quantile_cont(v, 0.05) AS t FROM px WHERE label % 2 = 1), c AS (SELECT block, count(*) AS n, count(*) FILTER (label % 2 = 1) AS nc, count(*) FILTER (label % 2 = 1 AND v < t) AS ch FROM px, t GROUP BY 1),
f AS (SELECT ch / nc::DOUBLE AS f FROM c WHERE nc > 0 AND nc >= 0.8 * (SELECT max(n) FROM c)), a AS (SELECT avg((v < t)::INT)::DOUBLE AS a FROM px, t WHERE label % 2 = 0)
SELECT any_value({R('t')}) AS threshold, any_value({R('a')}) AS fraction, (count(*) FILTER (f >= a) + 1) / (count(*) + 1)::DOUBLE AS p, count(*) AS n_cells FROM f, a, t""")
def area_change_p(spark, sf):
    p = pixels(spark, sf).withColumn("delta", F.col("v")).withColumn("control", F.col("label") % 2 == 1).withColumn("cell", F.col("block"))
    t = X.tail_threshold(p.where("control"), -1)
    df = p.join(F.broadcast(t))  # one row
    area = df.where(~F.col("control")).agg(F.avg(G.changed("delta", "threshold", -1).cast("double")).alias("a"), F.max("threshold").alias("t"))
    c = X.cell_fractions(df, "threshold", -1).join(F.broadcast(area))
    return c.agg(settled(F.max("t")).alias("threshold"), settled(F.max("a")).alias("fraction"), ((F.count_if(F.col("fraction") >= F.col("a")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.count(F.lit(1)).alias("n_cells"))


@query(f"""WITH {PIX}, s AS (SELECT block, "row", "col", sum(v) OVER (PARTITION BY block, "row" ORDER BY "col") AS r FROM px) SELECT block, "row", "col", {R('sum(r) OVER (PARTITION BY block, "col" ORDER BY "row")')} AS area_sum FROM s""")
def prefix_sums(spark, sf):
    return W.prefix_sums(pixels(spark, sf)).select("block", "row", "col", settled("area_sum").alias("area_sum"))


@query(f"""WITH {PIX}, p AS (SELECT block, greatest(0, v + 0.2) AS vv, greatest(0, v + 0.1) AS vh FROM px), g AS (SELECT block AS scene, avg(vv) FILTER (vv > 0 AND vh > 0) AS a, avg(vh) FILTER (vv > 0 AND vh > 0) AS b, avg((vv > 0 AND vh > 0)::INT)::DOUBLE AS s FROM p GROUP BY 1)
SELECT scene, {R('CASE WHEN s >= 0.8 THEN 10 * log10(a) END', 4)} AS vv, {R('CASE WHEN s >= 0.8 THEN 10 * log10(b) - 10 * log10(a) END', 4)} AS ratio, {R('s')} AS valid_share FROM g""")
def radar_zones(spark, sf):
    p = pixels(spark, sf).select(F.col("block").alias("scene"), F.lit(0).alias("zone"), F.greatest(F.lit(0.0), F.col("v") + 0.2).alias("vv"), F.greatest(F.lit(0.0), F.col("v") + 0.1).alias("vh"))
    return X.radar_zones(p).select("scene", settled("vv", 4).alias("vv"), settled("ratio", 4).alias("ratio"), settled("valid_share").alias("valid_share"))


def _scene_pixels(spark, sf) -> DataFrame:
    dn = lambda o: (F.floor((F.col("v") + o) * 4000) + 1500).cast("int")
    return pixels(spark, sf).select(F.col("block").alias("scene"), (F.col("row") % 2).alias("zone"), F.when(F.col("v") > -0.12, 4).otherwise(9).alias("cls"), F.lit("04.00").alias("baseline"), dn(1.0).alias("b03"), dn(0.9).alias("b04"), dn(1.2).alias("b08"), dn(1.1).alias("b12"))


_OPT = PIX + """, q AS (SELECT block AS scene, "row" % 2 AS zone, v > -0.12 AS clear, greatest(floor((v + 0.9) * 4000)::INT + 500, 0) / 10000.0::DOUBLE AS b04, greatest(floor((v + 1.2) * 4000)::INT + 500, 0) / 10000.0::DOUBLE AS b08 FROM px),
g AS (SELECT scene, zone, avg((b08 - b04) / (b08 + b04)) FILTER (clear AND b08 + b04 > 0) AS ndvi, avg(clear::INT)::DOUBLE AS s FROM q GROUP BY 1, 2)"""


@query(f"WITH {_OPT} SELECT scene, zone, {R('CASE WHEN s >= 0.8 THEN ndvi END')} AS ndvi, {R('s')} AS clear_share FROM g WHERE scene IN (SELECT scene FROM g WHERE zone = 0 AND s >= 0.8)")
def optical_zones(spark, sf):
    o, _ = X.optical_zones(_scene_pixels(spark, sf))
    return o.select("scene", "zone", settled("ndvi").alias("ndvi"), settled("clear_share").alias("clear_share"))


@query(f"WITH {_OPT} SELECT scene, 'cloud' AS reason FROM g WHERE zone = 0 AND s < 0.8")
def optical_receipts(spark, sf):
    return X.optical_zones(_scene_pixels(spark, sf))[1].select("scene", "reason")


@query(f"""WITH {PIX}, k AS (SELECT label AS zone, "row" AS cls, count(*) FILTER (v > 0) AS n FROM px GROUP BY 1, 2), c AS (SELECT zone, cls, n FROM k WHERE cls <> 0 AND n > 0), t AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, cls) AS r, sum(n) OVER (PARTITION BY zone) AS a FROM c),
e AS (SELECT label AS zone, avg(v) AS elevation FROM px WHERE v > 0 GROUP BY 1) SELECT e.zone, coalesce(t.cls, 0) AS lc, {R('t.n / t.a::DOUBLE')} AS lc_share, {R('e.elevation')} AS elevation FROM e LEFT JOIN t ON t.zone = e.zone AND t.r = 1""")
def zone_covariates(spark, sf):
    p = pixels(spark, sf).where("v > 0").select(F.col("label").alias("zone"), F.col("row").alias("cls"), F.col("v").alias("elev"), F.lit(0.0).alias("slope"))
    return X.covariates(p).select("zone", "lc", settled("lc_share").alias("lc_share"), settled("elevation").alias("elevation"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 17 % 400)::DOUBLE AS x, (p_partkey * 29 % 400)::DOUBLE AS y FROM part), z AS (SELECT s_suppkey AS zone, (s_suppkey * 13 % 350)::DOUBLE AS x0, (s_suppkey * 31 % 350)::DOUBLE AS y0, (s_suppkey * 13 % 350)::DOUBLE + 40 AS x1, (s_suppkey * 31 % 350)::DOUBLE + 40 AS y1 FROM supplier)
SELECT p.id, p.x, p.y, coalesce(max(z.zone), 0) AS zone FROM p LEFT JOIN z ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2, 3""")
def painted_zones(spark, sf):
    d = lambda c, m, k: (F.col(c) * m % k).cast("double")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), d("p_partkey", 17, 400).alias("x"), d("p_partkey", 29, 400).alias("y"))
    z = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("zone"), d("s_suppkey", 13, 350).alias("x0"), d("s_suppkey", 31, 350).alias("y0")).withColumn("x1", F.col("x0") + 40).withColumn("y1", F.col("y0") + 40)
    return J.painted(p, z)


# -- rates, receipts, decisions, portfolio --------------------------------------------------------


@query("""WITH j AS (SELECT lang, source, quality FROM labels JOIN documents USING (doc_id)), g AS (SELECT 'lang' AS dimension, lang AS value, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM j GROUP BY lang UNION ALL SELECT 'source', source, count(*) FILTER (quality = 1), count(*) FROM j GROUP BY source),
w AS (SELECT *, k / n::DOUBLE AS p, 1.959963984540054 AS z FROM g) SELECT dimension, value, k, n, round(p, 9) AS rate, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))), 9)::DOUBLE AS lo FROM w""")
def rates_grouping_sets(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return A.rates_by(j, ["lang", "source"], "quality = 1").select("dimension", "value", "k", "n", F.round("rate", 9).alias("rate"), F.round("lo", 9).alias("lo"))


@query("""WITH c AS (SELECT CASE WHEN quality = 1 THEN 'REAL' ELSE 'NOT_REAL' END AS truth, CASE WHEN doc_id % 5 = 0 THEN 'CANT_TELL' WHEN toxic = 1 THEN 'NOT_REAL' ELSE 'REAL' END AS call FROM labels), n AS (SELECT truth, count(*) AS n FROM c GROUP BY 1), o AS (SELECT * FROM (VALUES ('REAL', 'REAL', 'detection'), ('REAL', 'NOT_REAL', 'miss'), ('REAL', 'CANT_TELL', 'cant_tell'), ('NOT_REAL', 'REAL', 'false_alarm'), ('NOT_REAL', 'NOT_REAL', 'correct'), ('NOT_REAL', 'CANT_TELL', 'cant_tell')) t(truth, call, outcome))
SELECT n.truth, o.outcome, count(c.call) AS k, any_value(n.n) AS n, round(count(c.call) / any_value(n.n)::DOUBLE, 9) AS rate FROM n JOIN o USING (truth) LEFT JOIN c ON c.truth = n.truth AND c.call = o.call GROUP BY 1, 2""")
def call_rates(spark, sf):
    c = table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "REAL").otherwise("NOT_REAL").alias("truth"), F.when(F.col("doc_id") % 5 == 0, "CANT_TELL").when(F.col("toxic") == 1, "NOT_REAL").otherwise("REAL").alias("call"))
    return A.call_rates(c).select("truth", "outcome", "k", "n", F.round("rate", 9).alias("rate"))


@query("""WITH r AS (SELECT event_type AS reason, 's' || (user_id % 40)::VARCHAR AS sensor, ts::DATE AS day, event_id::VARCHAR AS detail, CASE WHEN event_id % 97 = 0 THEN 'station' END AS scope FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY reason, sensor, coalesce(scope = 'station', false)) AS n FROM r),
f AS (SELECT *, coalesce(scope = 'station', false) OR (n <= 45 AND reason NOT IN ('coverage', 'invalid')) AS stay FROM k) SELECT reason, sensor, day, detail, 1::BIGINT AS count FROM f WHERE stay UNION ALL SELECT reason, sensor, min(day), count(*)::VARCHAR || ' observations dropped', count(*) FROM f WHERE NOT stay GROUP BY 1, 2""")
def receipts_by_reason(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(F.col("event_type").alias("reason"), F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("sensor"), F.to_date("ts").alias("day"), F.col("event_id").cast("string").alias("detail"), F.when(F.col("event_id") % 97 == 0, "station").alias("scope"))
    return A.compact_receipts(r, 45)


_RES = """res AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'NDVI' WHEN 1 THEN 'VH' ELSE 'NDWI' END AS signal, (p_partkey % 3)::INT - 1 AS expected_sign, (p_size - 25) / 100.0::DOUBLE AS point, (p_size - 25) / 100.0::DOUBLE - (p_partkey % 7) / 50.0::DOUBLE AS lo, (p_size - 25) / 100.0::DOUBLE + (p_partkey % 5) / 50.0::DOUBLE AS hi,
(p_partkey % 11) / 100.0::DOUBLE AS pre_rmse, 0.02::DOUBLE AS med, 15 + p_partkey % 30 AS n_donors, 18 + p_partkey % 40 AS n_pre, p_partkey % 13 AS n_post, (p_partkey % 17 + 1) / 60.0::DOUBLE AS placebo_p, (p_partkey % 9 - 4) / 60.0::DOUBLE AS pe, p_partkey % 19 = 0 AS fake FROM part)"""
_M = "CASE WHEN signal IN ('VV', 'VH', 'RATIO') THEN 1.0 ELSE 0.05 END::DOUBLE"
_LAND = f"""{_RES}, q AS (SELECT *, {_M} AS m, pre_rmse <= greatest(1.5 * med, CASE WHEN signal = 'VH' THEN 0.3 ELSE 0.02 END) OR (abs(point) >= 4 * pre_rmse AND NOT fake) AS fit,
CASE WHEN expected_sign > 0 THEN lo > 0 WHEN expected_sign < 0 THEN hi < 0 ELSE lo > 0 OR hi < 0 END AS ex, CASE WHEN expected_sign > 0 THEN hi < {_M} WHEN expected_sign < 0 THEN lo > -{_M} ELSE lo > -{_M} AND hi < {_M} END AS ro, (expected_sign > 0 AND hi < 0) OR (expected_sign < 0 AND lo > 0) AS op FROM res),
v AS (SELECT *, (n_donors < 20)::INT + (n_pre < 20)::INT + (n_post < 3)::INT + (NOT fit)::INT + (abs(pe) >= m AND sign(pe) = sign(point))::INT + (lo = hi)::INT AS n_reasons FROM q),
dec AS (SELECT *, CASE WHEN n_reasons > 0 THEN 'CANT_TELL' WHEN ex AND abs(point) >= m AND placebo_p <= 0.10 THEN CASE WHEN fake THEN 'CANT_TELL' ELSE 'REAL' END WHEN ex AND abs(point) >= m THEN 'CANT_TELL' WHEN op OR ro THEN 'NOT_REAL' ELSE 'CANT_TELL' END AS status FROM v)"""


def result_rows(spark, sf) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    d = lambda x, by: x.cast("double") / by
    pt = d(s - 25, 100)
    return table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 3 == 0, "NDVI").when(k % 3 == 1, "VH").otherwise("NDWI").alias("signal"), ((k % 3) - 1).cast("int").alias("expected_sign"), pt.alias("point"), (pt - d(k % 7, 50)).alias("lo"), (pt + d(k % 5, 50)).alias("hi"),
        d(k % 11, 100).alias("pre_rmse"), F.lit(0.02).alias("placebo_pre_rmse_median"), (15 + k % 30).alias("n_donors"), (18 + k % 40).alias("n_pre"), (k % 13).alias("n_post"), d(k % 17 + 1, 60).alias("placebo_p"), d(k % 9 - 4, 60).alias("placebo_effect_median"), F.array(k % 19 == 0).alias("time_placebo_flags"),
    )


@query(f"WITH {_LAND} SELECT id, signal, status, CASE WHEN n_reasons > 0 THEN n_reasons WHEN status = 'REAL' THEN 0 ELSE 1 END AS n_reasons FROM dec")
def verdict_rules(spark, sf):
    return D.land(result_rows(spark, sf)).select("id", "signal", "status", F.size("reasons").alias("n_reasons"))


@query(f"""WITH {_LAND}, g AS (SELECT *, id // 3 AS grp, CASE WHEN n_post < 3 THEN 'unavailable' WHEN status = 'REAL' THEN 'supportive' WHEN op THEN 'contradicting' ELSE 'neutral' END AS gr FROM dec),
e AS (SELECT grp AS id, 'clearing' AS change_type, coalesce(max(gr) FILTER (signal = 'NDVI'), 'unavailable') AS optical, coalesce(max(gr) FILTER (signal = 'VH'), 'unavailable') AS radar, max(placebo_p) FILTER (signal = 'NDVI' AND gr <> 'unavailable') AS po, max(placebo_p) FILTER (signal = 'VH' AND gr <> 'unavailable') AS pr FROM g GROUP BY 1)
SELECT id, optical, radar, {R('CASE WHEN po IS NOT NULL OR pr IS NOT NULL THEN least(1.0, ((po IS NOT NULL)::INT + (pr IS NOT NULL)::INT) * least(coalesce(po, 9), coalesce(pr, 9))) END')} AS p_combined,
CASE WHEN optical = 'supportive' AND radar = 'supportive' THEN 'both' WHEN (optical, radar) IN (('supportive', 'contradicting'), ('contradicting', 'supportive')) THEN 'conflict' WHEN optical = 'supportive' THEN 'optical-only' WHEN radar = 'supportive' THEN 'radar-only' ELSE 'none' END AS agreement FROM e""")
def evidence_bonferroni(spark, sf):
    d = D.land(result_rows(spark, sf)).withColumn("id", F.floor(F.col("id") / 3)).withColumn("change_type", F.lit("clearing"))
    return D.evidence(d).select("id", "optical", "radar", settled("p_combined").alias("p_combined"), "agreement")


@query(f"""WITH {_LAND}, o AS (SELECT id AS oid, point AS opoint, n_post AS on_post FROM dec WHERE signal = 'NDVI') SELECT dec.id, CASE WHEN status = 'NOT_REAL' AND coalesce(abs(opoint) >= 0.1 AND sign(opoint) = -1 AND on_post < 3, false) THEN 'CANT_TELL' ELSE status END AS status FROM dec LEFT JOIN o ON oid = dec.id - 1 WHERE signal = 'VH'""")
def combined_verdict(spark, sf):
    d = D.land(result_rows(spark, sf))
    optical = d.where("signal = 'NDVI'").withColumn("id", F.col("id") + 1)
    return D.combine(d.where("signal = 'VH'"), optical).select("id", "status")


@query("""WITH r AS (SELECT c_custkey AS id, c_acctbal / 100000 AS effect, (c_custkey % 20) / 200.0::DOUBLE AS p, (c_custkey % 10) / 100.0::DOUBLE AS pre_rmse, c_custkey % 6 > 0 AS covered, c_custkey % 3 = 0 AS claims, (c_custkey % 4) / 2.0::DOUBLE AS claimed, 0.7::DOUBLE AS est FROM customer)
SELECT id, CASE WHEN NOT covered THEN 'INCONCLUSIVE' WHEN p < 0.05 AND effect > 0.03 AND pre_rmse <= 0.06 AND est < 0.6 * claimed THEN 'PARTIAL' WHEN p < 0.05 AND effect > 0.03 AND pre_rmse <= 0.06 THEN 'VERIFIED' WHEN effect > 0.03 OR pre_rmse > 0.06 THEN 'INCONCLUSIVE' WHEN claims THEN 'REJECTED' ELSE 'BASELINE' END AS status FROM r""")
def field_states(spark, sf):
    return D.field(_fields(spark, sf)).select("id", "status")


def _fields(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    d = lambda x, by: x.cast("double") / by
    return table(spark, sf, "customer").select(k.alias("id"), (F.col("c_acctbal") / 100000).alias("effect"), d(k % 20, 200).alias("p"), d(k % 10, 100).alias("pre_rmse"), F.lit(0.06).alias("rmse_max"), (k % 6 > 0).alias("covered"), (k % 3 == 0).alias("claims"), d(k % 4, 2).alias("claimed_rate"), F.lit(0.7).alias("est_rate"))


_FS = SQL["field_states"]


@query(f"""WITH s AS ({_FS}), f AS (SELECT s.status, c_custkey AS id, greatest(c_acctbal / 1000, 0) AS central, (100 - c_custkey % 20)::DOUBLE AS confidence, (c_custkey % 4) / 2.0::DOUBLE AS claimed, c_custkey % 25 = 0 AS rev FROM s JOIN customer ON c_custkey = s.id)
SELECT count(*) AS n_fields, {R("sum(central) FILTER (status IN ('VERIFIED', 'PARTIAL'))", 4)} AS verified, {R("sum(central) FILTER (status IN ('VERIFIED', 'PARTIAL') AND confidence >= 95)", 4)} AS verified_at_95, count(*) FILTER (status = 'REJECTED') AS fraud_fields, {R("sum(claimed * 10) FILTER (status = 'REJECTED')", 4)} AS fraud_exposure, count(*) FILTER (rev) AS reversals,
{R("count(*) FILTER (rev) / count(*) FILTER (rev OR status IN ('VERIFIED', 'PARTIAL'))::DOUBLE / 5")} AS base_hazard FROM f""")
def portfolio_rollup(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("id"), F.greatest(F.col("c_acctbal") / 1000, F.lit(0.0)).alias("central"), (100 - k % 20).cast("double").alias("confidence"), (k % 25 == 0).alias("reversed"))
    f = D.field(_fields(spark, sf)).select("id", "status", "claimed_rate").join(c, "id").withColumns({"area_ha": F.lit(10.0), "peak_credit": F.col("central"), "last_year": F.lit(2025)})
    return A.portfolio(f).select("n_fields", settled("verified", 4).alias("verified"), settled("verified_at_95", 4).alias("verified_at_95"), "fraud_fields", settled("fraud_exposure", 4).alias("fraud_exposure"), "reversals", settled("base_hazard").alias("base_hazard"))


@query(f"""WITH y AS (SELECT c_custkey AS id, [(c_custkey % 9) / 20.0::DOUBLE, (c_custkey % 7) / 20.0::DOUBLE, (c_custkey % 5) / 20.0::DOUBLE] AS y, c_custkey % 25 = 0 AS rev FROM customer), s AS (SELECT *, greatest(list_max(y), 1e-6) AS peak, y[3] AS last, sqrt(greatest(list_sum([y[1] * y[1], y[2] * y[2], y[3] * y[3]]) / 3 - power(list_sum(y) / 3, 2), 0)) AS sd FROM y),
m AS (SELECT id, rev, greatest(least(0.6 + 1.6 * least(greatest((peak - last) / peak, 0), 1) + 0.6 * least(greatest(sd / peak, 0), 1), 2.5), 0.5) AS m FROM s), h AS (SELECT id, rev, CASE WHEN rev THEN greatest(least(0.05 * m, 0.6), 0.25) ELSE least(0.05 * m, 0.6) END AS h FROM m)
SELECT id, {R('h')} AS hazard, {R('CASE WHEN rev THEN 0.95 ELSE 1 - exp(-h * 10) END')} AS loss, {R('50 * h * 3', 4)} AS premium FROM h""")
def hazard_pricing(spark, sf):
    k = F.col("c_custkey")
    y = F.array(*[(k % m).cast("double") / 20 for m in (9, 7, 5)])
    c = table(spark, sf, "customer").select(k.alias("id"), y.alias("yearly"), (k % 25 == 0).alias("reversed"), F.lit("VERIFIED").alias("status"), F.lit(3.0).alias("central"))
    return A.priced(c, 0.05).select("id", settled("hazard").alias("hazard"), settled("loss").alias("loss"), settled("premium", 4).alias("premium"))


@query("""WITH r AS (SELECT s_suppkey AS case_id, CASE s_suppkey % 3 WHEN 0 THEN 'REAL' WHEN 1 THEN 'NOT_REAL' ELSE 'CANT_TELL' END AS status FROM supplier UNION ALL SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'REAL' ELSE 'NOT_REAL' END FROM supplier) SELECT case_id, CASE WHEN count(DISTINCT status) = 1 THEN min(status) ELSE 'CANT_TELL' END AS status, count(DISTINCT status) > 1 AS mixed FROM r GROUP BY 1""")
def strata_combined(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"))
    a = s.withColumn("status", F.when(F.col("case_id") % 3 == 0, "REAL").when(F.col("case_id") % 3 == 1, "NOT_REAL").otherwise("CANT_TELL"))
    return D.combine_air(a.union(s.withColumn("status", F.when(F.col("case_id") % 2 == 0, "REAL").otherwise("NOT_REAL"))))


@query("""WITH a AS (SELECT p_partkey AS id, (p_size - 30)::DOUBLE / 5 AS point, (p_size - 30)::DOUBLE / 5 - 1 AS lo, (p_size - 30)::DOUBLE / 5 + 1 AS hi, 10 + p_partkey % 10 AS nd, 50 + p_partkey % 50 AS np, 6 + p_partkey % 20 AS nq, p_partkey % 23 = 0 AS fake, (p_partkey % 31) / 200.0::DOUBLE AS p, 15 + p_partkey % 20 AS pn FROM part)
SELECT id, CASE WHEN nd < 12 OR np < 52 OR nq < 8 OR fake OR pn < 19 THEN 'CANT_TELL' WHEN lo > 0 AND point > 0 THEN 'NOT_REAL' WHEN hi < 0 AND point <= -1 THEN CASE WHEN p <= 0.1 THEN 'REAL' ELSE 'CANT_TELL' END WHEN lo > -1 THEN 'NOT_REAL' ELSE 'CANT_TELL' END AS status FROM a""")
def air_rules(spark, sf):
    k = F.col("p_partkey")
    pt = (F.col("p_size") - 30).cast("double") / 5
    p = (k % 31).cast("double") / 200
    t = F.lit(True)
    a = table(spark, sf, "part").select(k.alias("id"), pt.alias("point"), (pt - 1).alias("lo"), (pt + 1).alias("hi"), (10 + k % 10).alias("n_donors"), (50 + k % 50).alias("n_pre"), (6 + k % 20).alias("n_post"), F.array(k % 23 == 0).alias("time_placebo_flags"), p.alias("placebo_p"), p.alias("placebo_p_effect"), (15 + k % 20).alias("placebo_n"), F.lit(3).alias("treated_n"), F.lit(1.0).alias("pre_rmse"), F.lit(1.0).alias("placebo_pre_rmse_median"), (~t).alias("lead_flagged"), (~t).alias("boundary_hit"), (~t).alias("accepted_empty"), t.alias("exact_cohort"), t.alias("jackknife_applicable"), t.alias("jackknife_robust"), t.alias("donor_applicable"), t.alias("donor_robust"))
    return D.air(a).select("id", "status")


@query("""WITH p AS (SELECT c_custkey % 50 AS unit, 2018 + c_custkey % 7 AS y, c_acctbal / 10000 AS green, (c_custkey % 12) / 100.0::DOUBLE AS texture FROM customer), b AS (SELECT unit, avg(green) FILTER (y < 2021) AS pre, avg(green) FILTER (y >= 2021) AS post, avg(texture) FILTER (y >= 2021) AS anyt FROM p GROUP BY 1),
g AS (SELECT p.unit, max(coalesce(post - pre, 0)) AS uplift, coalesce(avg(texture) FILTER (y >= 2021 AND green > coalesce(pre + 0.06, 0.3)), max(anyt)) AS texture FROM p JOIN b USING (unit) GROUP BY 1) SELECT unit, CASE WHEN uplift < 0.06 THEN 'NO COVER' WHEN texture <= 0.08 THEN 'MANAGED COVER CROP' ELSE 'LIKELY WEEDS' END AS verdict FROM g""")
def management_verdict(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select((k % 50).alias("unit"), (2018 + k % 7).alias("y"), (F.col("c_acctbal") / 10000).alias("green"), ((k % 12).cast("double") / 100).alias("texture"))
    return D.management(p).select("unit", "verdict")


# -- text and documents ---------------------------------------------------------------------------


@query("SELECT p.page_id, n.n AS nth, regexp_extract(a, 'href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\"') AS l FROM pages) p, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS n) n, LATERAL (SELECT l[n.n] AS a) x")
def html_extract(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("i", "href"))
    return p.select("page_id", (F.col("i") + 1).cast("long").alias("nth"), "href")


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k FROM events, (SELECT unnest(['page', 'ref', 'k']) AS k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL")
def json_props_extract(spark, sf):
    e = table(spark, sf, "events")
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get_json_object("props", f"$.{k}").alias("value")) for k in ("page", "ref", "k")]))
    return e.select("event_id", x.alias("x")).where("x.value is not null").select("event_id", "x.value", "x.k")


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm_name FROM part")
def name_normalise(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), Rd.plain_name(F.col("p_name")).alias("norm_name"))


@query("SELECT c.case_id, c.truth, a.answer, t.call FROM (SELECT doc_id AS case_id, quality AS truth FROM labels) c JOIN (SELECT doc_id AS case_id, lang AS answer FROM documents) a USING (case_id) JOIN (SELECT doc_id AS case_id, toxic AS call FROM labels) t USING (case_id)")
def answers_scored(spark, sf):
    lab, doc = table(spark, sf, "labels"), table(spark, sf, "documents")
    return J.scored(lab.select(F.col("doc_id").alias("case_id"), F.col("quality").alias("truth")), doc.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("answer")), lab.select(F.col("doc_id").alias("case_id"), F.col("toxic").alias("call"))).select("case_id", "truth", "answer", "call")


_NUM = "CASE WHEN signal = 'VH' THEN printf('%.2f', {x}) ELSE printf('%.3f', {x}) END"


@query(f"""WITH {_LAND}, r AS (SELECT l_partkey AS id, string_agg('- ' || l_shipdate::DATE::VARCHAR || ': ' || l_returnflag || ' (' || l_linestatus || ')', chr(10) ORDER BY l_shipdate::DATE, l_returnflag, l_linestatus) AS t
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate::DATE, l_returnflag, l_linestatus) AS n FROM lineitem WHERE l_quantity < 20) WHERE n <= 5 GROUP BY 1)
SELECT dec.id, '# Run ' || dec.id || chr(10) || chr(10) || '| | |' || chr(10) || '|-|-|' || chr(10) || '| Verdict | ' || status || ' |' || chr(10) || '| Effect ' || CASE WHEN signal = 'VH' THEN 'dB' ELSE '' END || ' | ' || {_NUM.format(x="point")} || ' |' || chr(10)
|| '| Interval | ' || {_NUM.format(x="lo")} || ' to ' || {_NUM.format(x="hi")} || ' |' || chr(10) || '| Placebo p | ' || printf('%.2f', placebo_p) || ' |' || chr(10) || chr(10) || '## Dropped observations' || chr(10) || coalesce(t, 'none') AS markdown FROM dec LEFT JOIN r USING (id)""")
def report_markdown(spark, sf):
    """The whole report of each run, with its first receipts by day."""
    receipts = table(spark, sf, "lineitem").where("l_quantity < 20").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("reason"), F.col("l_linestatus").alias("detail"))
    return Sk.report(D.land(result_rows(spark, sf)), receipts, most=5)


@query("SELECT doc_id, lang FROM documents")
def review_whitelist(spark, sf):
    return G.only(table(spark, sf, "documents"), ["doc_id", "lang", "missing"])


@query("WITH s AS (SELECT o_orderkey AS scene, o_orderdate::DATE AS d, o_totalprice AS clear FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'), t AS (SELECT *, least(floor(date_diff('day', DATE '1998-01-01', d) * 8 / date_diff('day', DATE '1998-01-01', DATE '1999-12-31')::DOUBLE), 7)::INT AS slot FROM s) SELECT slot, scene, d FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY clear DESC, scene DESC) AS r FROM t) WHERE r = 1")
def clearest_per_slot(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("clear"))
    return Sk.picture_scenes(s, 8, "1998-01-01", "1999-12-31").select("slot", "scene", "d")


@query("WITH s AS (SELECT user_id AS unit, value, event_id FROM events), w AS (SELECT unit, sum(value) AS total FROM s GROUP BY 1) SELECT unit, round(cast(total AS DECIMAL(38,10)), 4)::DOUBLE AS total FROM w WHERE unit NOT IN (SELECT user_id FROM events WHERE value < 0)")
def excluded_units(spark, sf):
    e = table(spark, sf, "events")
    g = e.groupBy(F.col("user_id").alias("unit")).agg(F.sum("value").alias("total"))
    return g.join(e.where("value < 0").select(F.col("user_id").alias("unit")).distinct(), "unit", "left_anti").select("unit", settled("total", 4).alias("total"))


@query("WITH m AS (SELECT o_custkey AS unit, max(o_orderdate::DATE) AS d FROM orders GROUP BY 1) SELECT unit, count(*) OVER (PARTITION BY date_trunc('month', d)) AS peers FROM m")
def peers_by_month(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.max(F.col("o_orderdate").cast("date")).alias("d"))
    return m.select("unit", F.count(F.lit(1)).over(Window.partitionBy(F.trunc("d", "MM"))).alias("peers"))


@query("SELECT unit, count(*) AS n FROM (SELECT c_nationkey AS unit, o_orderdate::DATE AS d FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '2000-01-01') GROUP BY 1")
def analysis_window(spark, sf):
    return obs(spark, sf).where((F.col("d") >= "1996-01-01") & (F.col("d") < "2000-01-01")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'traffic' ELSE 'background' END AS stratum, s_acctbal / 1000 - 1 AS lo, s_acctbal / 1000 + 1 AS hi, CASE WHEN s_suppkey % 7 = 0 THEN 6 ELSE 12 END AS post_months FROM supplier), f AS (SELECT 'traffic' AS stratum, 12 AS m, 4.5::DOUBLE AS published)
SELECT id, CASE WHEN published IS NULL THEN 'no finding' WHEN m <> post_months THEN 'other horizon' WHEN published BETWEEN lo AND hi THEN 'inside' ELSE 'outside' END AS agreement FROM r LEFT JOIN f USING (stratum)""")
def published_findings(spark, sf):
    k = F.col("s_suppkey")
    r = table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 3 == 0, "traffic").otherwise("background").alias("stratum"), (F.col("s_acctbal") / 1000 - 1).alias("lo"), (F.col("s_acctbal") / 1000 + 1).alias("hi"), F.when(k % 7 == 0, 6).otherwise(12).alias("post_months"))
    f = spark.createDataFrame([("traffic", 12, 4.5, "study")], "stratum string, months int, effect double, study string")
    return J.with_findings(r, f).select("id", "agreement")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS hit, count(*) FILTER (quality = 1 AND toxic = 1) AS missed, count(*) FILTER (quality = 0 AND toxic = 0) AS false_alarm, count(*) FILTER (quality = 0 AND toxic = 1) AS correct, 0::BIGINT AS cant_tell FROM labels")
def site_tallies(spark, sf):
    s = table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "REAL").otherwise("NOT_REAL").alias("expected"), F.when(F.col("toxic") == 1, "NOT_REAL").otherwise("REAL").alias("call"))
    return A.tallies(s)


@query(f"""WITH e AS (SELECT user_id % 5 AS zone, date_trunc('minute', ts) AS minute, event_id AS scene, value AS v, (event_id % 11) / 10.0::DOUBLE AS c FROM events) SELECT minute, zone, {R('avg(v)')} AS v, max(c) AS clear_share FROM e GROUP BY 1, 2""")
def same_minute_merge(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("zone"), F.date_trunc("minute", "ts").alias("minute"), F.col("event_id").alias("scene"), F.col("value").alias("v"), ((F.col("event_id") % 11).cast("double") / 10).alias("clear_share"))
    return A.merge_same_minute(e)[0].withColumn("v", settled("v"))


@query("""WITH e AS (SELECT user_id % 5 AS zone, date_trunc('minute', ts) AS minute, event_id AS scene, (event_id % 11) / 10.0::DOUBLE AS c FROM events), s AS (SELECT minute, scene, row_number() OVER (PARTITION BY minute ORDER BY max(c) DESC, scene) AS r FROM e GROUP BY minute, scene) SELECT minute, scene, 'duplicate' AS reason FROM s WHERE r > 1""")
def same_minute_receipts(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("zone"), F.date_trunc("minute", "ts").alias("minute"), F.col("event_id").alias("scene"), F.col("value").alias("v"), ((F.col("event_id") % 11).cast("double") / 10).alias("clear_share"))
    return A.merge_same_minute(e)[1]


@query(f"""WITH {PIX}, g AS (SELECT "row", "col", CASE WHEN avg(v) > 0 THEN round(avg(v), 6) END AS v FROM px GROUP BY 1, 2), p AS (SELECT p_partkey % 8 + 0.2 AS y, p_size % 8 - 0.2 AS x, max(p_partkey)::DOUBLE AS v FROM part GROUP BY 1, 2), n AS (SELECT round(y)::INT AS "row", round(x)::INT AS "col", max(v) AS pv FROM p GROUP BY 1, 2)
SELECT "row", "col", coalesce(g.v, n.pv) AS v FROM g LEFT JOIN n USING ("row", "col")""")
def grid_alignment(spark, sf):
    g = pixels(spark, sf).groupBy("row", "col").agg(F.avg("v").alias("m")).select("row", "col", F.when(F.col("m") > 0, F.round("m", 6)).alias("v"))
    p = table(spark, sf, "part").select((F.col("p_partkey") % 8 + F.lit(0.2)).alias("y"), (F.col("p_size") % 8 - F.lit(0.2)).alias("x"), F.col("p_partkey").cast("double").alias("v"))
    return J.on_grid(p, g, 0.0, 0.0, 1.0)


@query("SELECT c_nationkey AS unit, count(*) FILTER (c_acctbal > 0) AS claims, count(*) FILTER (NOT c_acctbal > 0) AS donors FROM customer GROUP BY 1")
def claim_split(spark, sf):
    a, b = U.split_claims(table(spark, sf, "customer").withColumn("claims", F.col("c_acctbal") > 0))
    n = lambda df, name: df.groupBy(F.col("c_nationkey").alias("unit")).agg(F.count(F.lit(1)).alias(name))
    return n(a, "claims").join(n(b, "donors"), "unit", "full").na.fill(0)
