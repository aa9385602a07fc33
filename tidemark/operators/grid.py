"""Pixel tables (scene, row, col, bands ...): zonal extraction, texture, change maps. Decoded rasters come as such tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLEAR_FRACTION
from ..functions.scalar import decibel, fixed, norm_diff, reflectance
from .gates import changed

CLEAR_CLASSES = (4, 5, 6)


def window(pixels: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """The part of a raster, clipped to it: a predicate that reaches the scan."""
    return pixels.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def upsample(pixels: DataFrame, k: int) -> DataFrame:
    """Each pixel as k x k pixels."""
    i = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1)))
    return pixels.withColumn("_i", i).withColumn("row", F.col("row") * k + F.floor(F.col("_i") / k).cast("int")).withColumn("col", F.col("col") * k + (F.col("_i") % k).cast("int")).drop("_i")


def decimate(pixels: DataFrame, k: int) -> DataFrame:
    """Every k-th pixel."""
    return pixels.where((F.col("row") % k == k // 2) & (F.col("col") % k == k // 2)).withColumn("row", F.floor(F.col("row") / k).cast("int")).withColumn("col", F.floor(F.col("col") / k).cast("int"))


def optical_zones(pixels: DataFrame, least: float = CLEAR_FRACTION) -> tuple[DataFrame, DataFrame]:
    """Observations (scene, zone, ndvi, ndwi, nbr, clear_share) of scenes whose zone 0 is clear, and receipts for the others.

    pixels: scene, zone, cls, baseline, b03, b04, b08, b12 (digital numbers). One pass; only scenes that pass go on.
    """
    r = {b: reflectance(b, "baseline") for b in ("b03", "b04", "b08", "b12")}
    clear = F.col("cls").isin(*CLEAR_CLASSES)
    idx = {"ndvi": norm_diff(r["b08"], r["b04"]), "ndwi": norm_diff(r["b03"], r["b08"]), "nbr": norm_diff(r["b08"], r["b12"])}
    g = pixels.groupBy("scene", "zone").agg(*[F.avg(F.when(clear, v)).alias(k) for k, v in idx.items()], F.avg(clear.cast("double")).alias("clear_share"))
    own = g.where(F.col("zone") == 0).select("scene", F.col("clear_share").alias("own"))
    ok = own.where(F.col("own") >= least)
    obs = g.join(ok.select("scene"), "scene", "left_semi")
    for k in idx:
        obs = obs.withColumn(k, F.when(F.col("clear_share") >= least, F.col(k)))
    receipts = own.where(F.col("own") < least).select("scene", F.lit("cloud").alias("reason"), fixed("own", 2).alias("detail"))
    return obs, receipts


def radar_zones(pixels: DataFrame, least: float = CLEAR_FRACTION) -> DataFrame:
    """scene, zone, vv, vh (dB of the mean power), ratio, valid_share over pixels valid in both channels."""
    ok = (F.col("vv") > 0) & (F.col("vh") > 0)
    g = pixels.groupBy("scene", "zone").agg(F.avg(F.when(ok, F.col("vv"))).alias("a"), F.avg(F.when(ok, F.col("vh"))).alias("b"), F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("valid_share"))
    good = F.col("valid_share") >= least
    return g.select("scene", "zone", F.when(good, decibel("a")).alias("vv"), F.when(good, decibel("b")).alias("vh"), F.when(good, decibel("b") - decibel("a")).alias("ratio"), "valid_share")


def parcels(cube: DataFrame, tile: int = 20, value: str = "v") -> DataFrame:
    """parcel, t, v: tile means of a cube (t, row, col, v), for parcels with at least a quarter of the dates (4 at least)."""
    g = cube.groupBy(F.floor(F.col("row") / tile).alias("pr"), F.floor(F.col("col") / tile).alias("pc"), "t").agg(F.avg(value).alias("v"))
    n = cube.agg(F.countDistinct("t").alias("T"))
    ok = g.groupBy("pr", "pc").agg(F.count("v").alias("c")).join(F.broadcast(n)).where(F.col("c") >= F.greatest(F.lit(4), F.floor(F.col("T") / 4))).select("pr", "pc")
    return g.join(ok, ["pr", "pc"], "left_semi").select(F.concat_ws(":", "pr", "pc").alias("parcel"), "t", "v")


# -- texture of blocks (block, t, row, col, v): name -> aggregate --------------------------------


def skewness(v) -> Column:
    return F.when(F.count(v) >= 8, F.skewness(v))


def bimodality(v) -> Column:
    k = F.kurtosis(v) + 3
    return F.when((F.count(v) >= 8) & (k > 0), (F.pow(F.skewness(v), 2) + 1) / k)


def perimeter(v: str = "v", ring: int = 2, row: str = "row", col: str = "col", h: str = "h", w: str = "w") -> Column:
    core = F.col(row).between(F.lit(ring), F.col(h) - ring - 1) & F.col(col).between(F.lit(ring), F.col(w) - ring - 1)
    inner, outer = F.avg(F.when(core, F.col(v))), F.avg(F.when(~core, F.col(v)))
    return F.when((F.max(h) > 2 * ring) & (F.max(w) > 2 * ring) & (inner != 0), outer / inner)


EXTRACTORS = {"texture_std": F.stddev_pop, "albedo": F.avg, "skew": skewness, "bimodality": bimodality}


def textures(pixels: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """by and the extractors wanted, in one aggregation."""
    return pixels.groupBy(*by).agg(*[EXTRACTORS[n]("v").alias(n) for n in names or EXTRACTORS])


def contrast(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, contrast: mean squared difference of neighbours across and down."""
    a = F.lag("v").over(Window.partitionBy(*by, "row").orderBy("col"))
    b = F.lag("v").over(Window.partitionBy(*by, "col").orderBy("row"))
    d = pixels.withColumn("_h", F.pow(F.col("v") - a, 2)).withColumn("_v", F.pow(F.col("v") - b, 2))
    n = F.count("_h") + F.count("_v")
    return d.groupBy(*by).agg(F.when(n > 0, (F.coalesce(F.sum("_h"), F.lit(0.0)) + F.coalesce(F.sum("_v"), F.lit(0.0))) / n).alias("contrast"))


def perimeters(pixels: DataFrame, by: list[str], ring: int = 2) -> DataFrame:
    size = pixels.groupBy(*by).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    return pixels.join(size, by).groupBy(*by).agg(perimeter(ring=ring).alias("perimeter_ratio"))


# -- change maps ----------------------------------------------------------------------------------


def tail_threshold(control: DataFrame, sign: int, value: str = "delta", share: float = 0.05) -> DataFrame:
    """One row: the change that a share of the control pixels exceeds in the expected direction."""
    q = F.percentile(value, F.lit(share)) if sign < 0 else F.percentile(value, F.lit(1 - share)) if sign > 0 else F.percentile(F.abs(value), F.lit(1 - share))
    return control.agg(q.alias("threshold"))


def cells(pixels: DataFrame, size: int, ncols: int) -> DataFrame:
    return pixels.withColumn("cell", (F.floor(F.col("row") / size) * ncols + F.floor(F.col("col") / size) + 1).cast("int"))


def cell_fractions(pixels: DataFrame, threshold, sign: int, least: float = 0.8) -> DataFrame:
    """cell, fraction of its control pixels changed, for cells with enough of them against the largest cell."""
    ctrl = F.col("control")
    g = pixels.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(ctrl).alias("n_ctrl"), F.count_if(ctrl & changed("delta", threshold, sign)).alias("n_chg"))
    most = g.agg(F.max("n").alias("_most"))
    return g.join(F.broadcast(most)).where((F.col("n_ctrl") > 0) & (F.col("n_ctrl") >= least * F.col("_most"))).select("cell", (F.col("n_chg") / F.col("n_ctrl")).alias("fraction"))


def area_change(pixels: DataFrame, sign: int, size: int, ncols: int) -> DataFrame:
    """One row: threshold, the area's fraction changed, and its placebo p among cells. pixels: row, col, delta, area, control."""
    t = tail_threshold(pixels.where("control"), sign)
    df = cells(pixels, size, ncols).join(F.broadcast(t))
    frac = df.where("area").agg(F.avg(changed("delta", "threshold", sign).cast("double")).alias("fraction"), F.max("threshold").alias("threshold"))
    c = cell_fractions(df, "threshold", sign).join(F.broadcast(frac.select(F.col("fraction").alias("_f"))))
    p = c.agg(((F.count_if(F.col("fraction") >= F.col("_f")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.count(F.lit(1)).alias("n_cells"))
    return frac.crossJoin(p)  # a row by a row


def clearest(scenes: DataFrame, n: int = 8) -> DataFrame:
    """Of scenes (scene, post, tile, minute, cloud) the n clearest of each period: one of each minute, all of the tile that most scenes have.

    Unknown cloud comes last; ties go to the earlier minute, then the smaller name.
    """
    tile = scenes.groupBy("tile").agg(F.count(F.lit(1)).alias("_n")).agg(F.max(F.struct("_n", "tile"))["tile"].alias("tile"))
    order = [F.col("cloud").asc_nulls_last(), F.col("minute"), F.col("scene")]
    one = scenes.join(F.broadcast(tile), "tile", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("post", "minute").orderBy(*order))).where("_r = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy("post").orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def period_change(pixels: DataFrame, scenes: DataFrame, least: int = 3, n: int = 8) -> DataFrame:
    """row, col, delta: the median after less the median before, over the clearest scenes; null with fewer than `least` clear values in a period.

    pixels: scene, row, col, v (null where not clear). One aggregation gives both composites.
    """
    df = pixels.join(F.broadcast(clearest(scenes, n).select("scene", "post")), "scene")  # at most 2 n rows
    of = lambda post: F.when(F.col("post") == post, F.col("v"))
    g = df.groupBy("row", "col").agg(F.median(of(True)).alias("_b"), F.median(of(False)).alias("_a"), F.count(of(True)).alias("_nb"), F.count(of(False)).alias("_na"))
    return g.select("row", "col", F.when((F.col("_na") >= least) & (F.col("_nb") >= least), F.col("_b") - F.col("_a")).alias("delta"))


def matched_controls(delta: DataFrame, ground: DataFrame, margin: int) -> DataFrame:
    """delta (row, col, delta) with area and control: pixels of the area's most frequent class outside the margin around it.

    ground: row, col, cls (0: unknown), area. Distance is to the area's nearest pixel: an area pixel marks every pixel within the margin, an
    equi-join by tiles of that size.
    """
    g = ground.where("area AND cls <> 0").groupBy("cls").agg(F.count(F.lit(1)).alias("_n")).agg(F.max(F.struct("_n", (-F.col("cls")).alias("_m")))["_m"].alias("_m"))
    tile = lambda x: F.floor(F.col(x) / margin)
    near = F.explode(F.array(*[F.struct((tile("row") + i).alias("i"), (tile("col") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    # only the ends of the area's runs and of its columns can be nearest to a pixel outside it
    edge = lambda by, o: F.coalesce(F.lag("area").over(Window.partitionBy(by).orderBy(o)) & F.lead("area").over(Window.partitionBy(by).orderBy(o)), F.lit(False))
    rim = ground.withColumn("_in", edge("row", "col") & edge("col", "row")).where("area AND NOT _in")
    rim = rim.select(F.col("row").alias("r"), F.col("col").alias("c"), near.alias("t")).select("r", "c", "t.i", "t.j")
    hit = ground.where("NOT area").select("row", "col", tile("row").alias("i"), tile("col").alias("j")).join(rim, ["i", "j"])
    close = hit.where(F.pow(F.col("row") - F.col("r"), 2) + F.pow(F.col("col") - F.col("c"), 2) <= margin * margin).select("row", "col").distinct().withColumn("_near", F.lit(True))
    df = delta.join(ground, ["row", "col"]).join(close, ["row", "col"], "left").join(F.broadcast(g))  # one row
    control = ~F.col("area") & F.col("_near").isNull() & (F.col("cls") == -F.col("_m")) & F.col("delta").isNotNull()
    return df.select("row", "col", "delta", (F.col("area") & F.col("delta").isNotNull()).alias("area"), F.coalesce(control, F.lit(False)).alias("control"))


def covariates(pixels: DataFrame) -> DataFrame:
    """zone, lc, lc_share, elevation, slope: dominant class (the smaller one among equals) and terrain. pixels: zone, cls, elev, slope."""
    n = pixels.where("cls <> 0").groupBy("zone", "cls").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("zone").agg(F.max(F.struct("n", (-F.col("cls")).alias("m"))).alias("t"), F.sum("n").alias("all"))
    rest = pixels.groupBy("zone").agg(F.avg("elev").alias("elevation"), F.avg("slope").alias("slope"))
    return rest.join(top, "zone", "left").select("zone", F.coalesce(-F.col("t.m"), F.lit(0)).alias("lc"), (F.col("t.n") / F.col("all")).alias("lc_share"), "elevation", "slope")


def slopes(dem: DataFrame, res: float, by: list[str]) -> DataFrame:
    """dem (by, row, col, elev) with slope in degrees by central differences."""
    wx, wy = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")
    gx = (F.lead("elev").over(wx) - F.lag("elev").over(wx)) / (2 * res)
    gy = (F.lead("elev").over(wy) - F.lag("elev").over(wy)) / (2 * res)
    return dem.withColumn("slope", F.degrees(F.atan(F.hypot(gx, gy))))


def with_halo(pixels: DataFrame, tile: int, halo: int = 1) -> DataFrame:
    """pixels (row, col ...) with their tile (tr, tc), and copies of those within `halo` of another tile's edge for that tile (ghost)."""
    at = lambda c, d: F.floor((F.col(c) + d) / tile)
    steps = [(0, 0), *[(d * r, d * c) for d in (-halo, halo) for r, c in ((1, 0), (0, 1))]]
    tiles = F.array_distinct(F.array(*[F.struct(at("row", r).alias("tr"), at("col", c).alias("tc")) for r, c in steps]))
    df = pixels.select("*", F.explode(tiles).alias("_t")).select(*pixels.columns, F.col("_t.tr").alias("tr"), F.col("_t.tc").alias("tc"))
    return df.withColumn("ghost", (F.col("tr") != at("row", 0)) | (F.col("tc") != at("col", 0)))


def tiled_slopes(dem: DataFrame, res: float, by: list[str], tile: int = 512) -> DataFrame:
    """slopes() of rasters of any size: tiles get their neighbours' edges, so that no window is wider than a tile. Null where a neighbour is missing."""
    keys = [*by, "tr", "tc"]

    def step(axis: str, other: str) -> Column:
        w = Window.partitionBy(*keys, other).orderBy(axis)
        a, b = F.lag(F.struct(axis, "elev")).over(w), F.lead(F.struct(axis, "elev")).over(w)
        return F.when((a[axis] == F.col(axis) - 1) & (b[axis] == F.col(axis) + 1), (b["elev"] - a["elev"]) / (2 * res))

    df = with_halo(dem, tile).withColumns({"_gx": step("col", "row"), "_gy": step("row", "col")}).where(~F.col("ghost"))
    return df.withColumn("slope", F.degrees(F.atan(F.hypot("_gx", "_gy")))).select(*dem.columns, "slope")


def tiled_covariates(dem: DataFrame, zones: DataFrame, res: float, by: list[str], tile: int = 512) -> DataFrame:
    """by, zone, slope (mean) and cover (the commonest, the smallest of equals) over all tiles that a zone has pixels in.

    dem: by, row, col, elev, cover. zones: by, zone, row, col. Sums and counts are combined by tile before they meet.
    """
    px = tiled_slopes(dem, res, by, tile).join(zones, [*by, "row", "col"])
    counts = px.groupBy(*by, "zone", "cover").agg(F.count(F.lit(1)).alias("_n"), F.sum("slope").alias("_s"), F.count("slope").alias("_k"))
    best = F.max_by("cover", F.struct("_n", -F.col("cover")))
    return counts.groupBy(*by, "zone").agg((F.sum("_s") / F.sum("_k")).alias("slope"), best.alias("cover"))


def snapped(zones: DataFrame, step: int = 60) -> DataFrame:
    """One row: bounds of the zones (x0, y0, x1, y1), snapped outwards."""
    lo, hi = lambda v: F.floor(F.min(v) / step) * step, lambda v: F.ceil(F.max(v) / step) * step
    return zones.agg(lo("x0").alias("x0"), lo("y0").alias("y0"), hi("x1").alias("x1"), hi("y1").alias("y1"))


def read_resolution(width_m: float, height_m: float, most: int, choices=(40, 60, 80)) -> int:
    """The finest resolution whose window has at most `most` pixels."""
    for r in choices:
        if (width_m / r) * (height_m / r) <= most:
            return r
    raise ValueError("the window is too large at any resolution")


def resolution_of(width_m, height_m, most: int, choices=(40, 60, 80)) -> Column:
    """read_resolution for a table of windows; null where none fits."""
    return F.coalesce(*[F.when((width_m / r) * (height_m / r) <= most, F.lit(r)) for r in choices])


def signal_panel(cube: DataFrame, signal: str, tile: int = 20) -> DataFrame:
    """parcel, t, v: a texture signal of each parcel and date."""
    df = cube.withColumn("parcel", F.concat_ws(":", F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)))
    if signal == "texture_contrast":
        return contrast(df, ["parcel", "t"]).withColumnRenamed("contrast", "v")
    if signal == "perimeter_ratio":
        df = df.withColumn("row", F.col("row") % tile).withColumn("col", F.col("col") % tile)
        return perimeters(df, ["parcel", "t"]).withColumnRenamed("perimeter_ratio", "v")
    return df.groupBy("parcel", "t").agg(EXTRACTORS[signal]("v").alias("v"))
