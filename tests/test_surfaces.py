"""SQL functions, the table function of tasks, monitoring by timers, halos: the same as columns, engine, batch and untiled forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sql as Sq
from tidemark.operators import engine as E
from tidemark.operators import grid as X
from tidemark.operators import windows as W
from tidemark.plans import surfaces
from tidemark.streaming import events as St


def test_sql_functions_are_inlined(spark, sf, same):
    """Both surfaces give the same rows, and neither plan has Python or a call that isn't built in."""
    by_sql, by_columns = surfaces.sql_functions(spark, sf), surfaces.places_by_columns(surfaces.places(spark, sf))
    same(by_sql.toPandas(), by_columns.toPandas())
    plan = by_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "tm_" not in plan and "Join" not in plan
    assert spark.sql("SELECT tm_finite(double('nan')), tm_finite(double('infinity')), tm_finite(1), tm_decibel(0), tm_norm_diff(-1, 0), tm_index_code(NULL)").first() == (None, None, 1.0, None, None, 65535)


def test_task_function_is_the_engine(spark):
    rows = [(v, u, k, float(u + k), k < 5) for v, n in (("a", 4), ("b", 75)) for u in range(n) for k in range(8)]
    panel = spark.createDataFrame(rows, "verdict string, unit long, k long, v double, pre boolean")
    want = E.tasks(panel, 60).select("verdict", F.explode("todo").alias("t")).select("verdict", "t.kind", "t.j")
    Sq.register(spark)
    panel.createOrReplaceTempView("tm_rows")
    got = spark.sql("SELECT verdict, kind, j FROM tm_tasks(TABLE(SELECT * FROM tm_rows) PARTITION BY (verdict), 60, 3, 0, 0D)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="takes a table with verdict and unit"):
        spark.sql("SELECT * FROM tm_tasks(TABLE(SELECT 1 AS x) PARTITION BY (x), 60, 3, 0, 0D)")


DAY = 86_400_000


def write_events(spark, folder, rows):
    df = spark.createDataFrame([(u, dt.datetime.fromtimestamp(ms / 1000, dt.UTC).replace(tzinfo=None), v) for u, ms, v in rows], "user_id long, ts timestamp, value double")
    df.coalesce(1).write.mode("append").parquet(folder)


def brute(rows, width, closed_before, floor, share=0.45):
    """user -> last closing, by the batch rule."""
    sums = {}
    for u, ms, v in rows:
        if (ms // width + 1) * width <= closed_before:
            sums.setdefault(u, {}).setdefault(ms // width, []).append(v)
    out = {}
    for u, periods in sums.items():
        e = [(p, sum(v) / len(v)) for p, v in sorted(periods.items())]
        peak = max(x for _, x in e)
        at = next(p for p, x in e if x == peak)
        recent = sum(x for _, x in e[-2:]) / len(e[-2:])
        hit = peak >= floor and recent < floor and recent < share * peak
        below = [p for p, x in e if p > at and x < floor]
        out[u] = (len(e), round(peak, 6), at, round(recent, 6), hit, float(below[0] if below else e[-1][0]) if hit else None)
    return out


def test_monitoring_restarts_where_it_stopped(spark, tmp_path):
    """Files that arrive while the stream is down, out of order within the watermark: after restarts it says what the batch operator says."""
    St.with_rocksdb(spark)
    r = random.Random(4)
    base = 19_000 * DAY
    rows = [(u, base + d * DAY + r.randrange(DAY), max(0.0, r.gauss(50 if d < 20 or u % 2 else 10, 8))) for u in range(6) for d in range(40) for _ in range(3)]
    rows.sort(key=lambda x: x[1] + r.randrange(DAY // 2))  # half a day out of order
    folder, at = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, len(rows), 180):
        write_events(spark, folder, rows[i : i + 180])
        got = St.run_once(St.reversals(St.events(spark, folder), 4 * DAY, 30.0), at)
    got = {x["user_id"]: (x["periods"], x["peak"], x["peak_period"], x["recent"], x["detected"], x["reversal_period"]) for x in surfaces.last_closings(got).collect()}
    assert got == brute(rows, 4 * DAY, max(ms for _, ms, _ in rows) - DAY, 30.0) and any(x[4] for x in got.values()) and not all(x[4] for x in got.values())
    years = spark.createDataFrame([(u, d, v) for u, ms, v in rows for d in [ms // (4 * DAY)] if (d + 1) * 4 * DAY <= max(m for _, m, _ in rows) - DAY], "unit long, y long, e double").groupBy("unit", "y").agg(F.avg("e").alias("e"))
    batch = {x["unit"]: (x["detected"], x["reversal_year"]) for x in W.reversal(years, F.lit(10.0), 30.0).collect()}
    assert {u: (x[4], x[5]) for u, x in got.items()} == batch


def test_rows_behind_the_watermark_do_not_reopen_a_period(spark, tmp_path):
    St.with_rocksdb(spark)
    base, folder, at = 19_000 * DAY, str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, base + DAY, 40.0), (1, base + 9 * DAY, 60.0)], [(1, base + 2 * DAY, 1000.0), (1, base + 30 * DAY, 5.0), (None, base, 1.0), (2, base + 29 * DAY, None)]):
        write_events(spark, folder, batch)
        got = St.run_once(St.reversals(St.events(spark, folder), 4 * DAY, 30.0), at)
    assert sorted((x["user_id"], x["period"], x["e"]) for x in got.collect()) == [(1, base // (4 * DAY), 40.0), (1, (base + 9 * DAY) // (4 * DAY), 60.0)]


def test_ties_of_means_do_not_hang_on_the_order_of_adding(spark, tmp_path, same):
    """Two periods of one mean, and means of just the floor, of values in any order: the query and its SQL say the same."""
    import duckdb

    r, width, base = random.Random(8), 2 * DAY, 9_900 * 2 * DAY
    rows = []
    for u in range(60):
        peak, edge = [37.47, 27.66, 63.74, 44.11, 24.87], [47.53, 10.07, 33.62, 28.78]  # their means are 39.57 and 30
        r.shuffle(peak)
        r.shuffle(edge)
        for period, values in enumerate([[39.57], peak, edge, [12.5], [3.1]] if u % 2 else [peak, [39.57], edge, [12.5], [3.1]]):
            rows += [(u, base + period * width + j * 1000, v) for j, v in enumerate(values)]
    write_events(spark, f"{tmp_path}/events.parquet", [*rows, (99, base + 9 * width, 1.0)])
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = surfaces.stream_reversals(spark, str(tmp_path)).toPandas()
    same(got, c.execute(surfaces.SQL["stream_reversals"]).df())
    assert set(got["peak_period"]) == {9_900} and set(got["reversal_period"]) == {9_903.0}


def test_state_is_held_by_groups_not_by_users(spark, tmp_path):
    """Calls to the state store are made for a group's periods: what is open is a row of state a group, not a user. Values may be decimals."""
    St.with_rocksdb(spark)
    folder, at = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(u, 19_000 * DAY + d * DAY + u, 10.0 + u % 7 + d) for u in range(2500) for d in (1, 6)]
    write_events(spark, folder, rows)
    got = St.run_once(St.reversals(St.events(spark, folder).withColumn("value", F.col("value").cast("decimal(9,2)")), 4 * DAY, 30.0), at)
    assert sorted((x["user_id"], x["e"]) for x in got.collect()) == [(u, 11.0 + u % 7) for u in range(2500)]
    left = spark.read.format("statestore").option("path", f"{at}/checkpoint").option("stateVarName", "open").load()
    assert 0 < left.count() <= 1024


def test_groups_of_users_restart_as_single_users_do(spark, tmp_path):
    """Users who share a group, some of them absent from periods, late within the watermark, over restarts."""
    St.with_rocksdb(spark)
    r, base, folder, at = random.Random(12), 19_000 * DAY, str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(u, base + d * DAY + r.randrange(DAY), max(0.0, r.gauss(50 if d < 20 or u % 2 else 10, 8))) for u in range(50) for d in range(40) if (d // 4 + u) % 5 or u % 3 for _ in range(2)]
    rows.sort(key=lambda x: x[1] + r.randrange(DAY // 2))
    for i in range(0, len(rows), 900):
        write_events(spark, folder, rows[i : i + 900])
        got = St.run_once(St.reversals(St.events(spark, folder), 4 * DAY, 30.0, groups=3), at)
    got = {x["user_id"]: (x["periods"], x["peak"], x["peak_period"], x["recent"], x["detected"], x["reversal_period"]) for x in surfaces.last_closings(got).collect()}
    assert got == brute(rows, 4 * DAY, max(ms for _, ms, _ in rows) - DAY, 30.0) and any(x[4] for x in got.values()) and not all(x[4] for x in got.values())


def test_who_returns_while_a_timer_is_due_loses_no_rows(spark, tmp_path):
    """A user whose events are there when the timer fires is not forgotten, nor are its open periods; one without any is."""
    St.with_rocksdb(spark)
    base, w = 4_750 * 4 * DAY, 4 * DAY
    early, back, alone = [(1, base + DAY, 90.0), (2, base + 3 * w, 7.0)], [(1, base + 5 * w, 20.0), (1, base + 6 * w, 40.0)], [(2, base + 7 * w + 2 * DAY, 6.0)]
    last = [(1, base + 9 * w, 20.0), (2, base + 12 * w, 5.0)]
    for name, batches, peak in (("there", [early, back + alone, last], 90.0), ("gone", [early, alone, last], 20.0)):
        for batch in batches:
            write_events(spark, f"{tmp_path}/{name}", batch)
            got = St.run_once(St.reversals(St.events(spark, f"{tmp_path}/{name}"), w, 30.0, idle_periods=4, groups=1), f"{tmp_path}/{name}-out")
        rows = sorted((x["user_id"], x["period"] - base // w, x["e"], x["peak"]) for x in got.collect())
        assert rows == [(1, 0, 90.0, 90.0), *([(1, 5, 20.0, 90.0), (1, 6, 40.0, 90.0)] if name == "there" else []), (1, 9, 20.0, peak), (2, 3, 7.0, 7.0), (2, 7, 6.0, 7.0)]


def test_files_of_a_table_are_not_late_to_each_other(spark, tmp_path, same):
    """Files over the same days, and an empty one: the query and its SQL say the same."""
    import duckdb

    base = 9_900 * 2 * DAY
    for u in range(4):
        write_events(spark, f"{tmp_path}/events.parquet", [(u, base + d * DAY, 60.0 if d < 4 else 5.0 + u) for d in range(12)])
    write_events(spark, f"{tmp_path}/events.parquet", [])
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = surfaces.stream_reversals(spark, str(tmp_path)).toPandas()
    same(got, c.execute(surfaces.SQL["stream_reversals"]).df())
    assert sorted(got["user_id"]) == [0, 1, 2, 3] and got["detected"].all()


@pytest.mark.parametrize("tile", [1, 5, 64])
def test_slopes_over_tiles(spark, tile):
    k = F.col("id")
    dem = spark.range(2 * 23 * 31).select((k % 2).alias("b"), (F.floor(k / 62) - 4).alias("row"), (F.floor(k / 2) % 31).alias("col"), F.pmod(F.xxhash64("id"), F.lit(90)).cast("double").alias("elev"))
    whole = X.slopes(dem, 30.0, ["b"]).select("b", "row", "col", F.round("slope", 6).alias("slope"))
    got = X.tiled_slopes(dem, 30.0, ["b"], tile).select("b", "row", "col", F.round("slope", 6).alias("slope"))
    assert got.count() == dem.count() and got.exceptAll(whole).count() == 0
    hole = X.tiled_slopes(dem.where("not (row = 3 and col = 7)"), 30.0, ["b"], tile)
    assert hole.where("row = 3 and col in (6, 8) and slope is not null").count() == 0
