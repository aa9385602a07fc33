"""Operators on small rows with known answers, edge cases first."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.stats import bonferroni, step_up, wilson
from tidemark.operators import aggregates as A
from tidemark.operators import gates as G
from tidemark.operators import timebins as T
from tidemark.operators import topk as K
from tidemark.operators import windows as W
from tidemark.plans import tables
from tidemark.sources import readers as R
from tidemark.sources import sinks as Sk

D = dt.date


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_bins_are_floored_at_the_event(spark):
    r = spark.createDataFrame([(1, D(2023, 1, 1) + dt.timedelta(i), float(i)) for i in range(30)], "unit int, d date, v double")
    b = {x["k"]: (x["v"], x["n"], x["pre"]) for x in T.anchored_bins(r, "2023-01-15", 10).collect()}
    assert b[-1] == (8.5, 10, True) and b[0] == (18.5, 10, False) and b[-2][1] == 4


def test_empty_bins_are_there(spark):
    r = spark.createDataFrame([(1, D(2023, 1, 1), 1.0), (1, D(2023, 3, 1), 2.0), (2, D(2023, 1, 1), None)], "unit int, d date, v double")
    b = T.anchored_bins(r, "2023-01-01", 10)
    assert b.count() == 12 and b.where("v is null").count() == 10


def test_gap_repairs(spark):
    w = spark.createDataFrame([(1, D(2024, 1, 7), 1.0), (1, D(2024, 1, 14), None), (1, D(2024, 1, 21), 3.0), (2, D(2024, 1, 7), None), (2, D(2024, 1, 14), 1.0), (3, D(2024, 1, 7), 1.0), (3, D(2024, 1, 14), None), (3, D(2024, 1, 28), 3.0)], "unit int, week date, v double")
    r = {(x["unit"], x["week"].day): x["repaired"] for x in T.repair_single_gap(w).collect()}
    assert r[1, 14] == 2.0 and r[2, 7] is None and r[3, 14] is None
    d = spark.createDataFrame([(1, D(2024, 1, i + 1), v) for i, v in enumerate([None, 1.0, None, None, 4.0, None, None, None, None, 9.0])], "unit int, d date, v double")
    assert [x["repaired"] for x in T.repair_short_runs(d).orderBy("d").collect()] == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, None, 9.0]


def test_days_need_hours(spark):
    h = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, i), 2.0) for i in range(18)] + [(1, dt.datetime(2024, 1, 2, i), 2.0) for i in range(19)], "unit int, ts timestamp, v double")
    assert [x["v"] for x in T.daily_mean(h).orderBy("d").collect()] == [None, 2.0]


def test_despike_spares_water(spark):
    rows = [(1, D(2024, 1, 1) + dt.timedelta(5 * i), 0.7, -0.4) for i in range(9)]
    rows[4] = (1, rows[4][1], 0.1, 0.3)
    df = spark.createDataFrame(rows, "unit int, d date, v double, w double")
    assert G.despike(df).where("suspect").count() == 1 and G.despike(df, water="w").where("suspect").count() == 0
    assert G.despike(df.limit(0)).count() == 0


def test_scalars(spark):
    r = one(spark, a=S.norm_diff(F.lit(3.0), F.lit(1.0)), z=S.norm_diff(F.lit(-1.0), F.lit(0.5)), r=S.reflectance(F.lit(900), F.lit("04.00")), o=S.reflectance(F.lit(900), F.lit("02.14")), d=S.decibel(F.lit(0.0)), n=S.finite(F.lit(float("nan"))), k=S.placebo_count(F.lit(0.25), F.lit(19)), c=S.carbon(F.lit(0.1), F.lit(10.0), F.lit(True))["central"], u=S.utm_epsg(F.lit(180.0), F.lit(-1.0)), t=S.tile_name(F.lit(-3.0), F.lit(-61.0)), w=S.signed(F.lit(-1.26), F.lit("VH")))
    assert (r["a"], r["z"], r["r"], r["o"], r["d"], r["n"], r["k"], round(r["c"], 9), r["u"], r["t"], r["w"]) == (0.5, None, 0.0, 0.09, None, None, 4, 6.0, 32760, "00N_070W", "−1.3 dB")


def test_projection_against_known_point(spark):
    r = one(spark, p=S.to_utm(F.lit(3.0), F.lit(0.0)), q=S.to_utm(F.lit(-0.1276), F.lit(51.5072)))
    assert abs(r["p"]["x"] - 500000) < 1e-6 and abs(r["p"]["y"]) < 1e-6
    assert abs(r["q"]["x"] - 699_344) < 60 and abs(r["q"]["y"] - 5_710_195) < 120


def test_wilson_and_bonferroni(spark):
    r = one(spark, w=wilson(F.lit(8), F.lit(10)), n=wilson(F.lit(0), F.lit(0)), b=bonferroni(F.lit(0.04), F.lit(0.3)), o=bonferroni(F.lit(None).cast("double"), F.lit(0.3)))
    assert (round(r["w"]["lo"], 4), round(r["w"]["hi"], 4)) == (0.4902, 0.9433) and r["n"]["rate"] is None and r["b"] == 0.08 and r["o"] == 0.3


def test_step_up(spark):
    df = spark.createDataFrame(list(enumerate([0.0004, 0.001, 0.002, 0.003, 0.04, 0.3, 0.7])), "id int, p double")
    assert [x["found"] for x in step_up(df).orderBy("id").collect()] == [True] * 4 + [False] * 3


def test_polygons(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0))])
    r = one(spark, a=G.ring_area(ring), i=G.in_ring(F.lit(1.0), F.lit(1.0), ring), o=G.in_ring(F.lit(5.0), F.lit(1.0), ring), p=G.polygon_problem(ring, F.lit(0.0)))
    assert (r["a"], r["i"], r["o"], r["p"]) == (12.0, True, False, "smaller than 0.5 ha")


def test_polygon_edges_are_those_of_the_sql(spark, tmp_path):
    """Suppliers on the polygon's edges and corners: those on the left are inside."""
    import duckdb

    keys = [0, 405, 3460, 5595, 5630, 7730, 47_930, *range(400, 420)]
    spark.createDataFrame([(k, 1, 0.0) for k in keys], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    got = sorted(x["id"] for x in tables.inside_polygon(spark, str(tmp_path)).collect())
    assert got == sorted(x for (x,) in c.execute(tables.SQL["inside_polygon"]).fetchall()) and 405 in got


def test_receipts(spark):
    rows = [("coverage", "s", D(2024, 1, 1), "x", None)] * 2 + [("time", "s", D(2024, 1, i), "y", None) for i in (1, 2)] + [("time", "s", D(2024, 1, 3), "z", "station")]
    c = A.compact_receipts(spark.createDataFrame(rows, "reason string, sensor string, day date, detail string, scope string")).collect()
    assert sorted((x["reason"], x["count"]) for x in c) == [("coverage", 2), ("time", 1), ("time", 1), ("time", 1)]


def test_as_of_takes_the_last_one(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    e = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(1)), (3, "b", t(9))], "id int, key string, ts timestamp")
    l = spark.createDataFrame([(7, "a", t(2), 1.0), (8, "a", t(5), 2.0), (9, "a", t(6), 3.0)], "id int, key string, ts timestamp, x double")
    assert {x["id"]: x["x"] for x in W.as_of(e, l).collect()} == {1: 2.0, 2: None, 3: None}


def test_thinning(spark):
    df = spark.range(100).select("id")
    assert sorted(x["id"] for x in K.thin_evenly(df, ["id"], 5).collect()) == [0, 25, 50, 74, 99]
    assert K.thin_evenly(df.limit(3), ["id"], 5).count() == 3


def test_donor_ring_keeps_off(spark):
    r = K.donor_ring(0.0, 0.0, 10_000.0, 1000.0, 3000.0, spark, most=50).collect()
    assert len(r) == 50 and all(max(abs(x["x"]), abs(x["y"])) - 100 >= 700 for x in r) and max(x["distance"] for x in r) <= 3000


def test_csv_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("field_id,lat,2024-01-01,2024-01-17\na,1.5,0.3,\nb,2.5,x,0.4\n")
    assert sorted((x["unit"], x["d"].day, x["v"]) for x in R.wide_csv(spark, str(tmp_path / "w.csv")).collect() if x["v"]) == [("a", 1, 0.3), ("b", 17, 0.4)]
    (tmp_path / "l.csv").write_text("field_id,date,ndvi,lat\na,2024-01-02,0.2,\na,2024-01-01,nan,7\na,2024-01-03,0.4,8\n")
    p, u = R.long_csv(spark, str(tmp_path / "l.csv"))
    assert p.where("v is null").count() == 1 and u.first()["lat"] == "7"


def test_ragged_csv(spark):
    text = ["Station x", "GMT hour ending", "", "Date,time,Nitrogen dioxide,status,unit,Ozone,status", "31-12-2023,24:00,10,R,ug,1,R", "01-01-2024,01:00,11,N,ug,1,R", "01-01-2024,00:00,12,R,ug,1,R", "01-01-2024,02:00,-1,V,ug,1,R", "01-01-2024,03:00,13,P*,ug,1,R"]
    good, bad = R.ragged_csv(spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n int, line string"))
    assert sorted((x["ts"], x["v"]) for x in good.collect()) == [(dt.datetime(2023, 12, 31, 23), 10.0), (dt.datetime(2024, 1, 1, 2), 13.0)]
    assert sorted(x["reason"] for x in bad.collect()) == ["invalid", "invalid-status", "invalid-time"]


def test_monitor_json(spark):
    site = '{"@SiteCode":"A","@SiteName":"N","@SiteType":"Roadside","@Latitude":"51","@Longitude":"0","@DateOpened":"2001-01-01 00:00:00","@DateClosed":"","Species":{"@SpeciesCode":"NO2","@DateMeasurementStarted":"2003-01-01 00:00:00","@DateMeasurementFinished":""}}'
    r = R.monitor_sites(spark.createDataFrame([('{"Sites":{"Site":' + site + "}}",), ('{"Sites":{"Site":[' + site + "]}}",), ('{"Sites":{}}',)], "json string")).collect()
    assert len(r) == 2 and r[0]["opened"] == D(2003, 1, 1) and r[0]["stratum"] == "traffic" and r[0]["closed"] is None
    h = '{"RawAQData":{"Data":[{"@MeasurementDateGMT":"2024-01-01 00:00:00","@Value":"5"},{"@MeasurementDateGMT":"2024-01-01 01:00:00","@Value":""}]}}'
    good, bad = R.monitor_hours(spark.createDataFrame([("A", 0, h), ("A", 1, h.replace('"5"', '"6"'))], "station string, chunk int, json string"), "2024-01-01", "2025-01-01")
    assert [x["v"] for x in good.collect()] == [6.0] and bad.count() == 2


def test_html_stations(spark):
    p = spark.createDataFrame([("<table><tr><td><a href='x?uka_id=UKA1'>Site One</a></td><td>51.5</td><td>-0.1</td><td>Urban Background</td></tr><tr><td>bad</td></tr></table><select><option value=\"AB1\">Site  one</option></select>",)], "html string")
    r = R.coded_stations(R.html_stations(p), R.html_options(p)).collect()
    assert len(r) == 1 and r[0]["station"] == "AB1" and r[0]["stratum"] == "background"


def test_weather(spark):
    j = '{"hourly":{"time":["2024-01-01T00:00","2024-01-01T01:00"],"temperature_2m":[1,3],"precipitation":[null,2],"wind_speed_10m":[10,10],"wind_direction_10m":[0,180],"boundary_layer_height":[null,null]}}'
    r = R.weather_days(spark.createDataFrame([("p", j)], "place string, json string")).first()
    assert r["temperature_2m"] == 2 and r["precipitation"] == 2 and abs(r["wind_v"]) < 1e-9 and r["boundary_layer_height"] is None


def test_published_documents_never_change(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = Sk.documents(spark.createDataFrame([("x", float("nan"))], "id string, p double"))
    assert '"p":null' in a.first()["document"]
    Sk.publish(a, path)
    assert Sk.publish(Sk.documents(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "id string, p double")), path).count() == 1
    got = {x["id"]: x["document"] for x in Sk.published(spark, path).collect()}
    assert set(got) == {"x", "y"} and '"p":null' in got["x"]


def test_merged_draws_refuse_repeats(spark):
    from tidemark.operators.sets import merged_draws

    a = spark.createDataFrame([(1, 7)], "id int, seed int")
    with pytest.raises(Exception, match="drawn twice"):
        merged_draws([a, a]).collect()


def test_planted_fields_get_their_states(spark, sf):
    from tidemark.plans import planted as G2
    from tidemark.plans.verdicts import audit_claims

    r = audit_claims(spark, *G2.crops(spark, sf)).collect()
    assert sum(x["status"] == "VERIFIED" for x in r if x["role"] == "adopter") >= 4 and all(x["onset"] == 2021 for x in r if x["role"] == "adopter")
    assert not any(x["status"] in ("VERIFIED", "PARTIAL") for x in r if x["role"] in ("liar", "weak"))


def test_attacks_are_not_real(spark, sf):
    from tidemark.plans.attacks import red_team

    r = {x["attack"]: x for x in red_team(spark, sf, 2).collect()}
    assert r["step"]["REAL"] == 2 and all(r[a]["REAL"] == 0 for a in ("common_shock", "pre_trend", "no_fit", "one_bin", "untouched", "season_shift"))


def test_scenes_to_verdict(spark):
    """A cleared zone among quiet ones: from digital numbers to REAL, with receipts for cloud, versions and tiles."""
    import random

    from tidemark.plans import series as P

    r = random.Random(2)
    scenes, px = [], []
    for i in range(130):
        day = dt.datetime(2021, 1, 1, 10) + dt.timedelta(days=7 * i)
        box = {"west": 0.0, "south": 0.0, "east": 1.0, "north": 1.0}
        scenes.append((f"s{i}", day, "T1", "05.00", float(i % 50), box, 0.9))
        shared = r.gauss(0, 0.02)
        for z in range(31):
            nir = 0.42 + shared + 0.002 * z + r.gauss(0, 0.004) - (0.2 if z == 0 and day >= dt.datetime(2023, 1, 1) else 0)
            px += [(f"s{i}", z, 8 if i % 29 == 3 and z == 0 else 4, "05.00", 1500, 1000 + int(10000 * 0.08), 1000 + int(10000 * nir), 2500) for _ in range(2)]
    scenes += [("old", scenes[5][1], "T1", "02.00", 1.0, box, 0.9), ("side", scenes[6][1], "T2", "05.00", 1.0, box, 0.2), ("far", scenes[7][1], "T9", "05.00", 1.0, {"west": 9.0, "south": 9.0, "east": 10.0, "north": 10.0}, 0.9)]
    s = spark.createDataFrame(scenes, "scene string, ts timestamp, tile string, version string, cloud double, bbox struct<west:double,south:double,east:double,north:double>, share double")
    p = spark.createDataFrame(px, "scene string, zone int, cls int, baseline string, b03 int, b04 int, b08 int, b12 int")
    keep, why = P.wanted_scenes(s, (0.0, 0.0, 1.0, 1.0), "2023-01-01", 14)
    assert {(x["scene"], x["reason"]) for x in why.collect()} == {("old", "superseded"), ("side", "other tile")} and keep.count() == 130
    obs, receipts = P.optical_series(keep, p)
    assert receipts.where("reason = 'cloud'").count() == len([i for i in range(130) if i % 29 == 3])
    profile = P.Profile(donors=25, placebos=20, grid=21)
    v = P.verdict_of("a", P.panel_of(obs, "2023-01-01", 14, profile=profile), "clearing", profile).first()
    assert v["status"] == "REAL" and v["point"] < -0.1, v


def test_ring_groups(spark):
    cells = spark.createDataFrame([(f"c{i:03d}", float(i % 10), float(i // 10)) for i in range(100)] + [("far", 999.0, 999.0)], "cell string, x double, y double")
    g = K.ring_groups(cells, 5.0, per=10, least=3, groups=4).groupBy("group").count().orderBy("group").collect()
    assert [x["count"] for x in g] == [10, 10, 10, 10]
    assert len(K.annulus(0, 0, 10, 20, 50)) == 50 and all(10 <= (x * x + y * y) ** 0.5 <= 20 for x, y in K.annulus(0, 0, 10, 20, 50))
