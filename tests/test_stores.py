"""The raster source, polygon overlays, the commit log and what stands on it: against brute force, with several writers and half-written attempts."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import polygons as P
from tidemark.sources import commits as C
from tidemark.sources import raster as Ra

# -- rasters --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def image(spark):
    k = F.col("id")
    return spark.range(2 * 70 * 45).select((k % 2 * 9).alias("raster"), (F.floor(k / 90) - 20).cast("int").alias("row"), (F.floor(k / 2) % 45).cast("int").alias("col"), (k % 17 * 1.5).alias("nir"), F.when(k % 5 != 0, k % 11 - 2.0).alias("red")).where("(row + col) % 3 != 0")


@pytest.fixture(scope="module")
def stored(spark, image, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("raster") / "r")
    Ra.write(image, at, ["nir", "red"], 16, 6)
    return at


def test_raster_round_trip(spark, image, stored):
    key = lambda r: tuple((v is None, v or 0) for v in r)
    rows = lambda df: sorted(map(tuple, df.select("raster", "row", "col", "nir", "red").collect()), key=key)
    assert rows(Ra.read(spark, stored)) == rows(image)
    window = "raster = 9 and row > -3 and row <= 20 and col in (4, 5, 30) and nir > 3"
    assert rows(Ra.read(spark, stored).where(window)) == rows(image.where(window)) != []
    assert Ra.read(spark, stored, bands="red").columns == ["raster", "row", "col", "red"]
    assert Ra.read(spark, stored).where("row = 500").count() == 0 and Ra.read(spark, stored).where("raster is null").count() == 0


def test_raster_filters_reach_the_scan_and_fewer_bytes_are_read(spark, stored):
    df = Ra.read(spark, stored, expression="norm_diff(nir, red)").where("raster = 0 and row between 0 and 15 and value > 0")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "EqualTo(raster,0)" in plan and "GreaterThanOrEqual(row,0)" in plan and "LessThanOrEqual(row,15)" in plan
    read = lambda **o: Ra.read(spark, stored, receipts="1", **o).agg(F.sum("tiles_read"), F.sum("bytes_read"), F.count(F.lit(1))).first()
    whole, some, one = read(), read(raster="0:0", row="0:15"), read(raster="0:0", row="0:15", col="0:15", bands="red")
    assert whole[0] > some[0] > one[0] == 1 and whole[1] > some[1] > one[1] and whole[2] > some[2]


def test_raster_expressions(spark, image, stored):
    got = Ra.read(spark, stored, expression="norm_diff(nir, red)", codes="index")
    total = F.col("nir") + F.col("red")
    v = F.when(total > 0, (F.col("nir") - F.col("red")) / total)
    want = image.select("raster", "row", "col", F.coalesce(F.floor((v + 1) * 32000 + 0.5) + 1, F.lit(65535)).cast("int").alias("code"))
    assert got.select("raster", "row", "col", "code").exceptAll(want).count() == 0 and got.where("code = 65535 and value is not null").count() == 0
    with pytest.raises(Exception, match="expression must be"):
        Ra.read(spark, stored, expression="exec(nir)").count()


def test_raster_writes_are_whole(spark, image, tmp_path):
    at = str(tmp_path / "r")
    Ra.write(image.where("raster = 0"), at, ["nir", "red"], 16)
    Ra.write(image.where("raster = 9"), at, ["nir", "red"], 16, mode="append")
    assert Ra.read(spark, at).count() == image.count()
    bad = image.withColumn("nir", F.when(F.col("row") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("nir")))
    with pytest.raises(Exception, match="broken"):
        Ra.write(bad, at, ["nir", "red"], 16)
    assert Ra.read(spark, at).count() == image.count()  # shards of a write that failed aren't seen
    Ra.write(image.where("raster = 0 and row = 1"), at, ["nir", "red"], 16)
    assert Ra.read(spark, at).count() == image.where("raster = 0 and row = 1").count()
    empty = str(tmp_path / "none")
    Ra.write(image.where("raster = 77"), empty, ["nir", "red"])
    assert Ra.read(spark, empty).count() == 0


# -- polygons -------------------------------------------------------------------------------------


def inside(x, y, ring):
    c = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            c = not c
    return c


def features(spark, rows):
    point = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    return spark.createDataFrame([(z, s, f, k, point(r)) for z, s, f, rings in rows for k, r in enumerate(rings)], "zone string, side string, feature long, ring int, points array<struct<x:double,y:double>>")


def ring_rows(df):
    return [(r["zone"], r["hole"], [(p["x"], p["y"]) for p in r["points"]]) for r in df.collect()]


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


@pytest.mark.parametrize("per_band", [4, 512])
def test_overlays_of_random_polygons(spark, per_band):
    """Rings hold exactly the points that features hold, whatever crosses; areas of rings and trapezoids agree; bands change nothing."""
    r = random.Random(6)
    blob = lambda n: [[(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(n)]]
    rows = [(z, "b" if i > 4 else "a", i, blob(3 + i % 3)) for z in ("p", "q") for i in range(8)]
    traps = P.trapezoids(features(spark, rows), per_band).cache()
    areas, got = {x["zone"]: x["area"] for x in P.area(traps).collect()}, ring_rows(P.rings(traps))
    for zone in ("p", "q"):
        mine = [ring for z, _, ring in got if z == zone]
        assert abs(sum(map(shoelace, mine)) - areas[zone]) < 1e-4
        assert all((shoelace(ring) < 0) == hole for z, hole, ring in got if z == zone)
        for _ in range(1500):
            x, y = r.uniform(0, 10), r.uniform(0, 10)
            of = {s: any(inside(x, y, f[3][0]) for f in rows if f[0] == zone and f[1] == s) for s in "ab"}
            assert (sum(inside(x, y, ring) for ring in mine) % 2 == 1) == (of["a"] and not of["b"])


def square(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_overlays_with_holes_and_touching_sides(spark):
    rows = [("hole", "a", 1, [square(0, 0, 10, 10), square(2, 2, 3, 3)]), ("hole", "a", 2, [square(3, 3, 1, 1)]), ("touch", "a", 1, [square(0, 0, 4, 4)]), ("touch", "a", 2, [square(4, 0, 4, 4)]), ("corner", "a", 1, [square(0, 0, 2, 2)]), ("corner", "a", 2, [square(2, 2, 2, 2)]), ("flat", "a", 1, [[(0, 0), (5, 5)]])]
    got = ring_rows(P.union(features(spark, rows)))
    of = lambda z: sorted((hole, abs(shoelace(ring)), len(ring)) for zone, hole, ring in got if zone == z)
    assert of("hole") == [(False, 1, 4), (False, 100, 4), (True, 9, 4)]
    assert of("touch") == [(False, 32, 4)] and of("corner") == [(False, 4, 4), (False, 4, 4)] and of("flat") == []


def test_difference_of_nothing_raises(spark):
    rows = [("x", "a", 1, [square(0, 0, 2, 2)]), ("x", "b", 2, [square(-1, -1, 5, 5)])]
    with pytest.raises(Exception, match="nothing is left of zone x"):
        P.difference(features(spark, rows)).collect()
    rows.append(("x", "a", 3, [square(3, 3, 4, 4)]))
    assert abs(sum(shoelace(ring) for _, _, ring in ring_rows(P.difference(features(spark, rows)))) - 15) < 1e-9


# -- the commit log -------------------------------------------------------------------------------


def test_a_manifest_has_one_creator(spark, tmp_path):
    log, won = C.Log(spark, str(tmp_path / "t")), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if log.create(1, {"add": [f"data/{i}"], "remove": [], "all": None, "note": {}}) else None) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and log.state().folders == [f"data/{won[0]}"]


def test_two_writers_publish_each_id_once(spark, tmp_path):
    path, got = str(tmp_path / "runs"), {}

    def write(who):
        df = spark.range(0, 400).where(f"id % 2 = 0 or id % 3 = {who}").select("id", F.lit(who).alias("writer"))
        got[who] = {r["id"] for r in C.publish(df, path).collect()}

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = C.published(spark, path).collect()
    assert sorted(r["id"] for r in rows) == sorted(set.union(*got.values())) == list(range(400))
    assert all(r["id"] in got[r["writer"]] for r in rows) and sum(map(len, got.values())) == 400
    before = {r["id"]: r["writer"] for r in rows}
    assert C.publish(spark.range(0, 401).select("id", F.lit(9).alias("writer")), path).count() == 1
    assert {r["id"]: r["writer"] for r in C.published(spark, path).collect()} == {**before, 400: 9}


def test_a_lost_race_is_seen(spark, tmp_path, monkeypatch):
    """The second writer has read the log before the first one commits: it still publishes only what is left."""
    path = str(tmp_path / "runs")
    commit, first = C.Log.commit, []

    def late(self, state, add, remove, note=None):
        if not first:
            first.append(1)
            C.publish(spark.createDataFrame([(1, "other"), (2, "other")], "id long, v string"), path)
        return commit(self, state, add, remove, note)

    monkeypatch.setattr(C.Log, "commit", late)
    C.publish(spark.createDataFrame([(2, "mine"), (3, "mine"), (None, "mine")], "id long, v string"), path)
    assert sorted(((r["id"], r["v"]) for r in C.published(spark, path).collect()), key=str) == [(1, "other"), (2, "other"), (3, "mine"), (None, "mine")]


def test_attempts_without_a_manifest_are_not_seen_and_swept(spark, tmp_path):
    path = str(tmp_path / "t")
    C.publish(spark.range(3), path)
    log = C.Log(spark, path)
    lost = log.attempt(spark.range(3, 9))
    assert C.published(spark, path).count() == 3 and log.sweep() == [] and log.sweep(0) == [lost] and C.published(spark, path).count() == 3


def test_snapshots_keep_the_log_short(spark, tmp_path, monkeypatch):
    log, read = C.Log(spark, str(tmp_path / "t")), []
    for i in range(45):
        assert log.commit(log.state(), [f"data/{i}"], [f"data/{i - 3}"] if i % 4 == 3 else [], {"n": i})
    assert not log.commit(C.State(10, [], {}), ["data/x"], [])
    one = C.Log._read
    monkeypatch.setattr(C.Log, "_read", lambda self, v: read.append(v) or one(self, v))
    s = log.state()
    assert s.version == 45 and s.note == {"n": 44} and s.folders == [f"data/{i}" for i in range(45) if not (i % 4 == 0 and i + 3 < 45)] and len(read) == 6


def test_readers_of_a_stage_see_whole_versions(spark, tmp_path):
    path, made = str(tmp_path / "s"), []
    make = lambda n: lambda: made.append(n) or spark.range(n, numPartitions=3)
    assert C.stage(spark, path, "one", make(10)).count() == 10
    reader = C.staged(spark, path)
    assert C.stage(spark, path, "one", make(99)).count() == 10 and made == [10]
    with pytest.raises(Exception, match="broken"):
        C.stage(spark, path, "two", lambda: spark.range(50, numPartitions=5).select(F.when(F.col("id") == 49, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")))
    assert C.staged(spark, path).count() == 10  # half of "two" was written
    assert C.stage(spark, path, "two", make(20)).count() == 20
    assert reader.count() == 10 and C.staged(spark, path).count() == 20
    C.Log(spark, path).sweep(0)
    assert C.staged(spark, path).count() == 20


# -- the fetch cache ------------------------------------------------------------------------------


def test_requests_are_fetched_once_and_bodies_kept_once(spark, tmp_path):
    calls, path = str(tmp_path / "calls"), str(tmp_path / "cache")
    (tmp_path / "calls").mkdir()

    def fetch(missing):
        def each(batches):
            import uuid

            for b in batches:
                for u in b["url"]:
                    open(f"{calls}/{uuid.uuid4().hex}", "w").write(u)
                yield b.assign(body=[None if "bad" in u else b"same" if "same" in u else u.encode() for u in b["url"]])[["request", "body"]]

        return missing.repartition(3).mapInPandas(each, "request string, body binary")

    asked = spark.createDataFrame([("u1", {"a": "1", "b": "2"}), ("u1", {"b": "2", "a": "1"}), ("u1", {"a": "2"}), ("same1", {}), ("same2", None), ("bad", {})], "url string, params map<string,string>").repartition(4)
    got = C.fetched(asked, path, fetch).collect()
    n = lambda: len(list((tmp_path / "calls").iterdir()))
    assert len(got) == 6 and n() == 5  # the order of parameters makes no other request
    assert len({r["request"] for r in got if r["url"] == "u1"}) == 2 and {bytes(r["body"]) for r in got if r["url"] == "u1"} == {b"u1"}
    assert C.published(spark, f"{path}/bodies").count() == 2 and [r["body"] for r in got if r["url"] == "bad"] == [None]
    again = C.fetched(asked.where("url != 'bad'"), path, fetch).collect()
    assert n() == 5 and all(r["body"] is not None for r in again)
    C.fetched(asked, path, fetch).count()
    assert n() == 6  # what failed is asked for again
