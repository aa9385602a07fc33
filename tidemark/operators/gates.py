"""Filters and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import c, great_circle_m


def covering(scenes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Scenes whose bounding box meets box (west, south, east, north); an unknown footprint stays."""
    w, s, e, n = box
    b = F.col("bbox")
    return scenes.where(b.isNull() | ((b["west"] <= e) & (b["east"] >= w) & (b["south"] <= n) & (b["north"] >= s)))


def array_median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.element_at(s, mid + 1)).otherwise((F.element_at(s, mid) + F.element_at(s, mid + 1)) / 2)


def despike(obs: DataFrame, days: int = 40, drop: float = 0.12, mads: float = 3.0, unit: str = "unit", day: str = "d", value: str = "v", water: str | None = None) -> DataFrame:
    """obs with suspect: values far below the median of their neighbours in time, unless the water index rises as much.

    A frame of days collects each value's neighbours; medians are taken in arrays, as frames have none.
    """
    t = F.unix_date(day)
    w = Window.partitionBy(unit).orderBy(t).rangeBetween(-days, days)
    me = F.struct(t.alias("t"), F.col(value).alias("v"), (F.col(water) if water else F.lit(None).cast("double")).alias("w"))
    df = obs.withColumn("_near", F.collect_list(F.when(F.col(value).isNotNull(), me)).over(w))
    # One entry of the row itself is taken out, by value and time.
    nb = lambda f: F.filter(F.transform("_near", lambda x: x[f]), lambda v: v.isNotNull())
    without = lambda arr, v: F.concat(F.slice(arr, 1, F.array_position(arr, v) - 1), F.slice(arr, F.array_position(arr, v) + 1, F.size(arr)))
    df = df.withColumn("_v", F.when(F.col(value).isNotNull(), without(nb("v"), F.col(value))))
    df = df.withColumn("_m", array_median(F.col("_v")))
    mad = array_median(F.transform("_v", lambda v: F.abs(v - F.col("_m")))) * 1.4826
    df = df.withColumn("_t", F.greatest(F.lit(drop), mads * mad))
    out = (F.size("_v") >= 2) & (F.col("_m") - F.col(value) > F.col("_t"))
    if water:
        df = df.withColumn("_w", F.when(F.col(water).isNotNull() & F.col(value).isNotNull(), without(nb("w"), F.col(water))))
        wet = (F.size("_w") >= 2) & (F.col(water) - array_median(F.col("_w")) > F.col("_t")) & (F.col(water) > 0)
        out = out & ~F.coalesce(wet, F.lit(False))
    return df.withColumn("suspect", F.coalesce(out, F.lit(False))).drop("_near", "_v", "_m", "_t", "_w")


def coverage_gate(df: DataFrame, observed: str, least: float = 0.40, unit: str = "unit") -> DataFrame:
    """unit, coverage, covered: share of rows observed."""
    return df.groupBy(unit).agg(F.avg(F.col(observed).cast("double")).alias("coverage")).withColumn("covered", F.col("coverage") >= least)


def beyond_buffer(donors: DataFrame, metres: float, distance: str = "distance_m") -> DataFrame:
    """Donors at least so far away; unknown distances stay."""
    return donors.where(F.col(distance).isNull() | (F.col(distance) >= metres))


def changed(delta, threshold, sign: int) -> Column:
    """Whether a change is beyond the threshold in the expected direction; null is not."""
    hit = c(delta) < c(threshold) if sign < 0 else c(delta) > c(threshold) if sign > 0 else F.abs(c(delta)) > c(threshold)
    return F.coalesce(hit, F.lit(False))


def contaminated(stations: DataFrame, policies: DataFrame, start: str, end: str) -> DataFrame:
    """stations with the first policy (by date, name) launched near them within the window, else null.

    policies is a registry of a few rows (name, launched, lat, lon, radius_km), so it is broadcast.
    """
    p = policies.where(F.col("launched").between(start, end)).select("name", "launched", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "radius_km")
    near = stations.join(F.broadcast(p), great_circle_m("lat", "lon", "_lat", "_lon") <= F.col("radius_km") * 1000)
    first = near.groupBy("station").agg(F.min(F.struct("launched", "name")).alias("policy"))
    return stations.join(first, "station", "left")


def uncontaminated(stations: DataFrame, policies: DataFrame, start: str, end: str) -> DataFrame:
    return contaminated(stations, policies, start, end).where("policy is null").drop("policy")


def in_polygon(x, y, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a closed ring, edges counted as inside along the lower and left sides."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            cross = ((F.lit(y1) > c(y)) != (F.lit(y2) > c(y))) & (c(x) < (x2 - x1) * (c(y) - y1) / (y2 - y1) + x1)
            out = out != cross
    return out


def in_ring(x, y, ring: Column) -> Column:
    """The same against an array<struct<x, y>> column."""
    n = F.size(ring)
    step = lambda a, i: F.when(
        ((ring[i]["y"] > c(y)) != (ring[(i + 1) % n]["y"] > c(y))) & (c(x) < (ring[(i + 1) % n]["x"] - ring[i]["x"]) * (c(y) - ring[i]["y"]) / (ring[(i + 1) % n]["y"] - ring[i]["y"]) + ring[i]["x"]),
        ~a,
    ).otherwise(a)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), step)


def pick_treated(stations: DataFrame, event: str, ring: list[tuple[float, float]], most: int = 30) -> DataFrame:
    """Active stations of the two strata inside the ring, those opened first, up to `most` of each stratum."""
    e = F.lit(event).cast("date")
    on = (F.coalesce("opened", e) <= e) & (F.coalesce("closed", e) >= e)
    df = stations.where(F.col("stratum").isin("traffic", "background") & on & in_polygon("lon", "lat", ring))
    w = Window.partitionBy("stratum").orderBy(F.coalesce("opened", F.lit("2100-01-01").cast("date")), "station")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array<struct<x, y>>."""
    n = F.size(ring)
    term = lambda a, i: a + ring[i]["x"] * ring[(i + 1) % n]["y"] - ring[(i + 1) % n]["x"] * ring[i]["y"]
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), term)) / 2


def polygon_problem(ring: Column, lat: Column) -> Column:
    """Why an area (corners in metres) can't be analysed; null if it can: 3 corners, 0.5 to 500 ha, not polar."""
    ha = ring_area(ring) / 10_000
    return F.when(F.coalesce(F.size(ring), F.lit(0)) < 3, "fewer than three corners").when(F.abs(lat) > 85, "too near a pole").when(ha < 0.5, "smaller than 0.5 ha").when(ha > 500, "larger than 500 ha")


def dataset_problems(panel: DataFrame, units: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """issue, detail: what stands against analysing a panel (unit, d, v) of units (unit, claims)."""
    a = panel.agg(F.countDistinct("d").alias("days"), F.avg(F.col("v").isNull().cast("double")).alias("gaps"), F.count_if((F.col("v") < low) | (F.col("v") > high)).alias("odd"))
    u = units.agg(F.count_if(~F.col("claims")).alias("donors"))
    tests = [("few-dates", F.col("days") < 24, F.col("days")), ("no-donors", F.col("donors") == 0, F.col("donors")), ("gaps", F.col("gaps") > 0.6, F.col("gaps")), ("range", F.col("odd") > 0, F.col("odd"))]
    one = a.crossJoin(u)  # a row by a row
    return one.select(F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(n).alias("issue"), d.cast("string").alias("detail"))) for n, t, d in tests]))).alias("x")).select("x.*")


def only(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that are there; nothing else leaves."""
    return df.select(*[a for a in allowed if a in df.columns])


def listed(df: DataFrame, flag: str = "listed") -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(True)))
