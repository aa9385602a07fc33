"""Union and difference of polygons with holes, as trapezoids between edge events and as rings; distances of cells from them.

Features are (zone, side, feature, ring, points): rings of one feature are taken even-odd, so that an inner ring is a hole;
side 'a' is what a zone includes, 'b' what is taken off. A zone's plane is cut into bands of equal numbers of vertices; a
band's task sweeps upwards over its edges' ends and crossings and gives trapezoids, left to right, of what is inside.
Areas are sums over trapezoids. Rings come from their sides: horizontal sides that a trapezoid below and one above have
both cancel. Coordinates are settled to 10^-9, so that crossings computed from either edge are one point.

Rings with fewer than three points or null coordinates are no area; touching features are one; a zone without area has
no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAPEZOID = "y0 double, y1 double, l0 double, l1 double, r0 double, r1 double"
NEAR = 1e-7  # points of a ring that are nearer are one, and sides that bend less are straight
PER_BAND = 512  # vertices of a zone that one band has, about


def sides(features: DataFrame) -> DataFrame:
    """zone, side, feature, x1, y1, x2, y2 (y1 <= y2) of all rings."""
    ok = F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    f = features.withColumn("_p", ok).where(F.size("_p") >= 3)
    at = lambda i: F.col("_p")[F.pmod(i, F.size("_p"))]
    ends = F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.struct(at(i)["x"].alias("ax"), at(i)["y"].alias("ay"), at(i + 1)["x"].alias("bx"), at(i + 1)["y"].alias("by")))
    e = f.select("zone", "side", "feature", F.explode(ends).alias("e"))
    low = F.col("e.ay") < F.col("e.by")
    pick = lambda a, b: F.when(low, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}")).cast("double")
    return e.select("zone", "side", "feature", pick("ax", "bx").alias("x1"), pick("ay", "by").alias("y1"), pick("bx", "ax").alias("x2"), pick("by", "ay").alias("y2"))


def edges(features: DataFrame) -> DataFrame:
    """sides() without the horizontal ones."""
    return sides(features).where("y1 < y2")


def banded(e: DataFrame, per_band: int = PER_BAND) -> DataFrame:
    """Edges with the bands (band, lo, hi) that they meet: bounds are quantiles of a zone's vertices, at most one for each per_band of them."""
    n = e.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.min("y1").alias("_lo"), F.max("y2").alias("_hi"))
    rank = F.percent_rank().over(Window.partitionBy("zone").orderBy("y1"))
    marks = e.select("zone", "y1").distinct().withColumn("_q", rank).join(n, "zone").withColumn("_b", F.floor(F.col("_q") * F.ceil(F.col("n") / per_band)))
    bounds = marks.groupBy("zone", "_b").agg(F.min("y1").alias("lo"), F.first("_hi").alias("_hi"))
    bounds = bounds.withColumn("hi", F.coalesce(F.lead("lo").over(Window.partitionBy("zone").orderBy("lo")), F.col("_hi"))).select("zone", F.col("_b").alias("band"), "lo", "hi")
    return e.join(bounds, "zone").where("y1 < hi and y2 > lo")


def _x(e: np.ndarray, y: float) -> np.ndarray:
    """Where edges (x1, y1, x2, y2) are at y; their ends are exact."""
    x = e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    return np.round(np.where(y == e[:, 1], e[:, 0], np.where(y == e[:, 3], e[:, 2], x)), 9)


def _crossings(e: np.ndarray, y0: float, y1: float) -> np.ndarray:
    """Heights between y0 and y1 at which edges cross."""
    a, b = _x(e, y0), _x(e, y1)
    i, j = np.triu_indices(len(e), 1)
    d0, d1 = a[i] - a[j], b[i] - b[j]
    cross = d0 * d1 < 0
    return np.round(y0 + (y1 - y0) * d0[cross] / (d0[cross] - d1[cross]), 9)


def sweep(e: np.ndarray, feature: np.ndarray, taken_off: np.ndarray, lo: float, hi: float) -> list[tuple]:
    """Trapezoids between lo and hi of the union of features less those taken off."""
    ys = np.unique(np.concatenate([[lo, hi], e[:, 1], e[:, 3]]))
    out = []
    for a, b in zip(ys[:-1], ys[1:], strict=True):
        if a < lo or b > hi:
            continue
        on = np.flatnonzero((e[:, 1] <= a) & (e[:, 3] >= b))
        if not len(on):
            continue
        cuts = np.unique(np.concatenate([[a, b], _crossings(e[on], a, b)]))
        for y0, y1 in zip(cuts[:-1], cuts[1:], strict=True):
            x0, x1 = _x(e[on], y0), _x(e[on], y1)
            inside, count, begun = set(), [0, 0], None
            for k in np.lexsort((x1, x0, x0 + x1)):
                f, side = int(feature[on[k]]), int(taken_off[on[k]])
                was = count[0] > 0 and count[1] == 0
                count[side] += -1 if f in inside else 1
                inside ^= {f}
                now = count[0] > 0 and count[1] == 0
                if now and not was:
                    begun = (x0[k], x1[k])
                elif was and not now:
                    if out and out[-1][:2] == (y0, y1) and out[-1][4:] == begun:  # they touch along a side
                        begun = out.pop()[2:4]
                    if begun[0] < x0[k] or begun[1] < x1[k]:
                        out.append((y0, y1, *begun, x0[k], x1[k]))
    return out


def trapezoids(features: DataFrame, per_band: int = PER_BAND) -> DataFrame:
    """zone and TRAPEZOID: what a zone's 'a' features cover and none of its 'b' features does."""
    zone = features.schema["zone"].dataType.simpleString()

    def swept(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, _ = pd.factorize(pdf["side"].astype(str) + "/" + pdf["feature"].astype(str))
        e = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        rows = sweep(e, f, (pdf["side"] == "b").to_numpy(), float(pdf["lo"].iloc[0]), float(pdf["hi"].iloc[0]))
        out = pd.DataFrame(rows, columns=["y0", "y1", "l0", "l1", "r0", "r1"])
        out.insert(0, "zone", pd.Series([key[0]] * len(out), dtype=pdf["zone"].dtype))
        return out

    return banded(edges(features), per_band).groupBy("zone", "band").applyInPandas(swept, f"zone {zone}, {TRAPEZOID}")


def area(traps: DataFrame) -> DataFrame:
    return traps.groupBy("zone").agg(F.sum((F.col("y1") - F.col("y0")) * (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2).alias("area"))


def boundary(traps: list[tuple]) -> list[list[tuple[float, float]]]:
    """Rings around trapezoids: outer ones counter-clockwise, holes clockwise, without points on straight sides."""
    level: dict[float, dict[float, int]] = defaultdict(lambda: defaultdict(int))
    ahead: dict[tuple, list[tuple]] = defaultdict(list)
    for y0, y1, l0, l1, r0, r1 in traps:
        ahead[(r0, y0)].append((r1, y1))
        ahead[(l1, y1)].append((l0, y0))
        for y, a, b, s in ((y0, l0, r0, 1), (y1, l1, r1, -1)):
            level[y][a] += s
            level[y][b] -= s
    for y, steps in level.items():  # what only one of the two sides has stays
        xs, depth = sorted(steps), 0
        for a, b in zip(xs, xs[1:], strict=False):
            depth += steps[a]
            p, q = ((a, y), (b, y)) if depth > 0 else ((b, y), (a, y))
            ahead[p] += [q] * abs(depth)
    rings = []
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0])
    for start in sorted(ahead):
        while ahead[start]:
            ring, at = [start], ahead[start].pop()
            while at != start:
                nxt, last = ahead[at], ring[-1]
                back = np.arctan2(last[1] - at[1], last[0] - at[0])
                # At a point of several rings the first side clockwise from where we came keeps each ring simple.
                k = min(range(len(nxt)), key=lambda i: (back - np.arctan2(nxt[i][1] - at[1], nxt[i][0] - at[0])) % (2 * np.pi) or 2 * np.pi)  # noqa: B023
                ring.append(at)
                at = nxt.pop(k)
            ring = [p for i, p in enumerate(ring) if abs(p[0] - ring[i - 1][0]) + abs(p[1] - ring[i - 1][1]) > NEAR]
            n = len(ring)
            ring = [ring[i] for i in range(n) if abs(turn(ring[i - 1], ring[i], ring[(i + 1) % n])) > NEAR]
            if len(ring) > 2:
                rings.append(ring)
    return rings


def rings(traps: DataFrame) -> DataFrame:
    """zone, ring, hole, points of the boundary of each zone's trapezoids: as large as the boundary, one task a zone."""
    zone = traps.schema["zone"].dataType.simpleString()

    def stitched(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = boundary(list(pdf[["y0", "y1", "l0", "l1", "r0", "r1"]].itertuples(index=False, name=None)))
        hole = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) < 0 for r in got]
        return pd.DataFrame({"zone": pd.Series([key[0]] * len(got), dtype=pdf["zone"].dtype), "ring": range(len(got)), "hole": hole, "points": [[{"x": x, "y": y} for x, y in r] for r in got]})

    return traps.groupBy("zone").applyInPandas(stitched, f"zone {zone}, ring int, hole boolean, points array<struct<x:double,y:double>>")


def union(features: DataFrame) -> DataFrame:
    """Rings of what any feature of a zone covers."""
    return rings(trapezoids(features.withColumn("side", F.lit("a"))))


def difference(features: DataFrame) -> DataFrame:
    """Rings of what a zone's 'a' features cover and its 'b' features don't; a zone of which nothing is left raises when the result is used."""
    zones = features.where("side = 'a'").select("zone").distinct()
    left = rings(trapezoids(features))
    df = zones.join(left, "zone", "left")
    check = F.assert_true(F.col("ring").isNotNull(), F.concat(F.lit("nothing is left of zone "), F.col("zone").cast("string")))
    return df.where(check.isNull())


# -- distances ------------------------------------------------------------------------------------


def _to_segment(px: Column, py: Column) -> Column:
    """From a point to the side (x1, y1, x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = dx * dx + dy * dy
    t = F.when(d > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / d))).otherwise(0.0)
    return F.hypot(px - F.col("x1") - t * dx, py - F.col("y1") - t * dy)


def _to_cell(px: Column, py: Column) -> Column:
    """From a point to the cell (x0, y0, x9, y9)."""
    out = lambda v, a, b: F.greatest(F.col(a) - v, v - F.col(b), F.lit(0.0))
    return F.hypot(out(px, "x0", "x9"), out(py, "y0", "y9"))


def _cell_to_side() -> Column:
    """From a cell to a side: 0 where they meet, else a corner's or an end's distance."""
    corners = [(F.col(x), F.col(y)) for x in ("x0", "x9") for y in ("y0", "y9")]
    turn = [(F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1")) for x, y in corners]
    boxes = (F.least("x1", "x2") <= F.col("x9")) & (F.greatest("x1", "x2") >= F.col("x0")) & (F.col("y1") <= F.col("y9")) & (F.col("y2") >= F.col("y0"))
    meets = boxes & (F.least(*turn) <= 0) & (F.greatest(*turn) >= 0)
    return F.when(meets, 0.0).otherwise(F.least(*[_to_segment(x, y) for x, y in corners], _to_cell(F.col("x1"), F.col("y1")), _to_cell(F.col("x2"), F.col("y2"))))


def gaps(features: DataFrame, cells: DataFrame, reach: float) -> DataFrame:
    """cells (zone, cell, x0, y0, x9, y9) with gap: their distance, edge to edge, from what the zone's features cover, null beyond `reach`.

    Sides are cut into pieces of `reach` at most, which a grid of that width indexes; a cell meets the pieces in the grid
    squares within reach of it. Whether a cell lies inside is told by the sides right of its centre, in its band of the
    grid: a cell that meets no side is inside as a whole or not at all. A point is a cell without width.
    """
    keys = ["zone", "cell"]
    at = lambda v: F.floor(v / reach)
    span = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    e = sides(features)
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / reach)).cast("int")
    cut = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")
    p = e.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    p = p.select("zone", *[cut(a, b, F.col("_i") + d).alias(o) for o, a, b, d in (("x1", "x1", "x2", 0), ("y1", "y1", "y2", 0), ("x2", "x1", "x2", 1), ("y2", "y1", "y2", 1))])
    p = p.select("*", span(F.least("x1", "x2"), F.greatest("x1", "x2")).alias("_tx")).select("*", span(F.col("y1"), F.col("y2")).alias("_ty"))
    near = cells.select(*keys, "x0", "y0", "x9", "y9", span(F.col("x0") - reach, F.col("x9") + reach).alias("_tx")).select("*", span(F.col("y0") - reach, F.col("y9") + reach).alias("_ty"))
    gap = near.join(p, ["zone", "_tx", "_ty"]).groupBy(*keys).agg(F.min(_cell_to_side()).alias("_gap")).where(F.col("_gap") <= reach)

    mid = cells.select(*keys, ((F.col("x0") + F.col("x9")) / 2).alias("_x"), ((F.col("y0") + F.col("y9")) / 2).alias("_y")).withColumn("_ty", at(F.col("_y")))
    up = e.where("y1 < y2").select("zone", "feature", "x1", "y1", "x2", "y2", span(F.col("y1"), F.col("y2")).alias("_ty"))
    right = (F.col("y1") <= F.col("_y")) & (F.col("y2") > F.col("_y")) & (F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) > F.col("_x"))
    inside = mid.join(up, ["zone", "_ty"]).where(right).groupBy(*keys, "feature").agg((F.count(F.lit(1)) % 2 == 1).alias("_odd")).where("_odd").select(*keys).distinct().withColumn("_in", F.lit(True))
    df = cells.join(gap, keys, "left").join(inside, keys, "left")
    return df.withColumn("gap", F.when(F.col("_in"), 0.0).otherwise(F.col("_gap"))).drop("_gap", "_in")


def control_cells(features: DataFrame, side: float, inner: float, outer: float) -> DataFrame:
    """zone, cell, x, y (centre), gap, distance: squares of a lattice over each zone's box and `outer` around it, at least `inner` off, edge to edge, with their centre within `outer` of what the zone covers."""
    p = F.explode("points").alias("p")
    box = features.select("zone", p).groupBy("zone").agg(F.min("p.x").alias("_x0"), F.min("p.y").alias("_y0"), F.max("p.x").alias("_x1"), F.max("p.y").alias("_y1"))
    steps = lambda a, b: F.sequence(F.floor((F.col(a) - outer) / side), F.floor((F.col(b) + outer) / side))
    c = box.select("zone", "_y0", "_y1", F.explode(steps("_x0", "_x1")).alias("i")).select("zone", "i", F.explode(steps("_y0", "_y1")).alias("j"))
    c = c.select("zone", F.concat_ws(":", "i", "j").alias("cell"), (F.col("i") * side).alias("x0"), (F.col("j") * side).alias("y0"), ((F.col("i") + 1) * side).alias("x9"), ((F.col("j") + 1) * side).alias("y9"))
    g = gaps(features, c, outer).where(F.col("gap") >= inner)
    mid = g.select("zone", "cell", *[((F.col(a) + F.col(b)) / 2).alias(o) for o, a, b in (("x0", "x0", "x9"), ("y0", "y0", "y9"), ("x9", "x0", "x9"), ("y9", "y0", "y9"))])
    d = gaps(features, mid, outer).where("gap is not null").select("zone", "cell", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("gap").alias("distance"))
    return d.join(g.select("zone", "cell", "gap"), ["zone", "cell"])
