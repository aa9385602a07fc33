"""From scenes and pixels to series: pruning before any pixel, zonal means, merging, haze filter, bins, donors, verdicts.

Scenes are pruned by footprint, processing version, tile and cloud before pixels are joined; what is
dropped on the way becomes receipts. What several branches read - zonal means, despiked series, the complete panel - is
cut into checkpoints, so that pixels are read once. A profile only sets sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import minute_key
from ..operators import aggregates as A
from ..operators import gates as G
from ..operators import grid as X
from ..operators import sets as U
from ..operators import timebins as T
from ..operators import topk as K
from .base import cut


@dataclass(frozen=True)
class Profile:
    donors: int = 80
    per_bin: int | None = None
    placebos: int = 60
    grid: int = 41


FULL, LIVE = Profile(), Profile(donors=40, per_bin=2, placebos=40, grid=21)


def wanted_scenes(scenes: DataFrame, box: tuple[float, float, float, float], event: str, width: int, profile: Profile = FULL) -> tuple[DataFrame, DataFrame]:
    """Scenes to read (scene, minute, d ...), and receipts. scenes: scene, ts, tile, version, cloud, bbox, share (of the area)."""
    s = G.covering(scenes, box).withColumn("minute", minute_key("ts")).withColumn("d", F.to_date("ts"))
    newest = U.latest_version(s, ["minute", "tile"], "version", "scene")
    best = K.best_per_key(newest, ["minute"], [F.desc(F.coalesce("share", F.lit(0.0))), "scene"])
    out = K.top_per_bin(best, event, width, profile.per_bin).drop("k", "rank") if profile.per_bin else best
    why = lambda a, b, reason: a.join(b.select("scene"), "scene", "left_anti").select("scene", F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("detail"))
    return out, why(s, newest, "superseded").unionByName(why(newest, best, "other tile")).unionByName(why(best, out, "bin is full"))


def optical_series(scenes: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unit (zone), d, v (NDVI), w (NDWI) without haze, and receipts. pixels as in grid.optical_zones()."""
    px = pixels.join(scenes.select("scene"), "scene", "left_semi")
    obs, dropped = X.optical_zones(px)
    obs = cut(obs.join(scenes.select("scene", "minute", "d"), "scene"))
    merged, twice = A.merge_same_minute(obs, "ndvi")
    water, _ = A.merge_same_minute(obs, "ndwi")
    day = obs.select("minute", "d").distinct()
    s = merged.join(water.select("minute", "zone", "ndwi"), ["minute", "zone"]).join(day, "minute").select(F.col("zone").alias("unit"), "d", F.col("ndvi").alias("v"), F.col("ndwi").alias("w"))
    s = cut(G.despike(cut(s), water="w"))
    haze = s.where("suspect and unit = 0").select(F.concat(F.lit("day "), F.col("d").cast("string")).alias("scene"), F.lit("haze").alias("reason"), F.lit(None).cast("string").alias("detail"))
    receipts = dropped.unionByName(twice.select("scene", "reason", F.lit(None).cast("string").alias("detail"))).unionByName(haze)
    return s.withColumn("v", F.when(~F.col("suspect"), F.col("v"))).drop("suspect"), receipts


def panel_of(series: DataFrame, event: str, width: int, covariates: DataFrame | None = None, profile: Profile = FULL) -> DataFrame:
    """unit, k, v, pre: the treated unit 0 and its chosen donors on complete bins, gaps filled by position."""
    full = cut(T.complete_panel(cut(T.anchored_bins(series, event, width)), 0).select("unit", "k", F.col("v_full").alias("v"), "pre"))
    scored = K.donor_rmse(full, 0)
    if covariates is not None:
        own = covariates.where("zone = 0").select(F.col("lc").alias("own_lc"), F.col("elevation").alias("own_elevation"))
        scored = scored.join(covariates.select(F.col("zone").alias("unit"), "lc", "elevation"), "unit", "left").join(F.broadcast(own))  # one row
        keep = K.pick_donors(scored, F.col("own_lc"), F.col("own_elevation"), k=profile.donors)
    else:
        keep = K.pick_donors(scored, k=profile.donors)
    return full.join(keep.select("unit").union(keep.sparkSession.range(1).select(F.lit(0).cast(keep.schema["unit"].dataType).alias("unit"))), "unit", "left_semi")


def verdict_of(name: str, panel: DataFrame, change: str, profile: Profile = FULL) -> DataFrame:
    """The decided row of one area's panel."""
    from ..config import CHANGES
    from .verdicts import land_verdicts

    signal, sign, _, _ = CHANGES[change]
    p = panel.select(F.lit(name).alias("verdict"), F.col("unit").cast("long").alias("unit"), F.col("k").cast("long").alias("k"), "v", "pre")
    return land_verdicts(panel.sparkSession, p, signal, sign, profile.donors, profile.placebos, profile.grid)
