"""Connected components of raster masks, and seeded samples of event boxes and empty boxes from them.

Pixels are (window, row, col, hit ...), each window whole. Runs of a row are the nodes of the graph; an edge joins runs
that touch across or diagonally. Labels come from alternating star steps on the edges, so that neither a window nor a
component has to fit one task; every step is cut by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import hash_budget

SHIFT = 2**31  # a run's id is its row times this and its first column


def runs(pixels: DataFrame) -> DataFrame:
    """window, row, col, run: the pixels hit, each with the id of its run of the row."""
    w = Window.partitionBy("window", "row").orderBy("col")
    df = pixels.where("hit").select("window", "row", "col").withColumn("_g", F.col("col") - F.row_number().over(w))
    first = F.min("col").over(Window.partitionBy("window", "row", "_g"))
    return df.select("window", "row", "col", (F.col("row").cast("long") * SHIFT + first).alias("run"))


def touching(nodes: DataFrame) -> DataFrame:
    """window, u, v (u > v): runs of neighbouring rows that touch, by an equi-join on the pixel above."""
    below = nodes.select("window", F.col("row") + 1, F.explode(F.array(F.col("col") - 1, F.col("col"), F.col("col") + 1)), F.col("run")).toDF("window", "row", "col", "v")
    return nodes.join(below, ["window", "row", "col"]).select("window", F.col("run").alias("u"), "v").distinct()


def stars(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """window, run, label: each run with a smaller one in its component, and the smallest of them.

    A large step hangs a node's larger neighbours on the smallest of its neighbourhood, a small step its smaller ones;
    the edges are stars when a round changes none.
    """

    def hung(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select("window", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("window", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, ["window", "u"]).select("window", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("window", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["window", "u"]).where("v <> m").select("window", F.col("v").alias("u"), F.col("m").alias("v"))
        return small.unionByName(low.withColumnRenamed("m", "v")).distinct()

    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("window", "u", "v").cast("decimal(38,0)"))).first()
    edges = cut(edges)
    seen = state(edges)
    while True:
        edges = cut(hung(edges))
        now = state(edges)
        if now == seen:
            return edges.select("window", F.col("u").alias("run"), F.col("v").alias("label"))
        seen = now


def components(pixels: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """window, row, col, label: the pixels hit with their 8-connected component, named by its first run in reading order."""
    nodes = cut(runs(pixels))
    return nodes.join(stars(touching(nodes), cut), ["window", "run"], "left").select("window", "row", "col", F.coalesce("label", "run").alias("label"))


def boxes(labelled: DataFrame, pixels: DataFrame, least: int, most: int, box: int, share: float) -> DataFrame:
    """A row for each usable component: window, label, n, row0, row1, col0, col1 (ends exclusive), fraction.

    Usable: of least to most pixels, off the window's edges, filling at least a share of its box. The box is the bounding
    box less a pixel on each side (where more than two remain), cropped about the centroid to at most `box` pixels.
    """
    size = pixels.groupBy("window").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    g = labelled.groupBy("window", "label").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"), F.avg("row").alias("cy"), F.avg("col").alias("cx"))
    g = g.where(F.col("n").between(least, most)).join(size, "window").where("r0 > 0 AND c0 > 0 AND r1 < _h AND c1 < _w")
    for a, b in (("r0", "r1"), ("c0", "c1")):
        wide = F.col(b) - F.col(a) > 2
        g = g.withColumns({a: F.when(wide, F.col(a) + 1).otherwise(F.col(a)), b: F.when(wide, F.col(b) - 1).otherwise(F.col(b))})
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(box)) / ((F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")))))
    g = g.withColumn("_s", scale)
    for a, b, mid in (("r0", "r1", "cy"), ("c0", "c1", "cx")):
        side = F.greatest(F.lit(1), F.floor((F.col(b) - F.col(a)) * F.col("_s")).cast("int"))
        at = F.least(F.greatest(F.bround(F.col(mid) - side / 2.0).cast("int"), F.col(a)), F.col(b) - side)
        g = g.withColumns({f"_{a}": F.when(F.col("_s") < 1, at).otherwise(F.col(a)), f"_{b}": F.when(F.col("_s") < 1, at + side).otherwise(F.col(b))})
    inside = (F.col("row") >= F.col("_r0")) & (F.col("row") < F.col("_r1")) & (F.col("col") >= F.col("_c0")) & (F.col("col") < F.col("_c1"))
    df = labelled.join(g, ["window", "label"]).groupBy("window", "label", "n", *[F.col(f"_{c}").alias(n) for c, n in (("r0", "row0"), ("r1", "row1"), ("c0", "col0"), ("c1", "col1"))]).agg(F.count_if(inside).alias("_in"))
    df = df.withColumn("fraction", F.col("_in") / ((F.col("row1") - F.col("row0")) * (F.col("col1") - F.col("col0")))).drop("_in")
    return df.where(F.col("fraction") >= share)


def empty_boxes(pixels: DataFrame, h: int, w: int, rows: int, cols: int) -> DataFrame:
    """window, row0, col0: every h x w box of sound pixels with nothing hit in it or within rows and cols of it.

    pixels: window, row, col, hit, sound. Counts slide along a row, then down a column; positions whose margin leaves the window don't count.
    """
    along, down = Window.partitionBy("window", "row").orderBy("col"), Window.partitionBy("window", "col").orderBy("row")
    one = lambda x: F.coalesce(F.col(x), F.lit(False)).cast("int")
    df = pixels.withColumns({"_bad": F.sum(1 - one("sound")).over(along.rowsBetween(0, w - 1)), "_hit": F.sum(one("hit")).over(along.rowsBetween(-cols, w - 1 + cols))})
    df = df.withColumns({"_bad": F.sum("_bad").over(down.rowsBetween(0, h - 1)), "_hit": F.sum("_hit").over(down.rowsBetween(-rows, h - 1 + rows))})
    size = pixels.groupBy("window").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    fits = F.col("row").between(F.lit(rows), F.col("_h") - h - rows) & F.col("col").between(F.lit(cols), F.col("_w") - w - cols)
    return df.where("_bad = 0 AND _hit = 0").join(size, "window").where(fits).select("window", F.col("row").alias("row0"), F.col("col").alias("col0"))


def sampled(candidates: DataFrame, seed: int, most: int = 1) -> DataFrame:
    """Of each window's candidates (window, key ...) the first by a seeded hash of the key, with n_candidates of the window."""
    n = candidates.groupBy("window").agg(F.count(F.lit(1)).alias("n_candidates"))
    return hash_budget(candidates, most, seed, key="key", by=["window"]).join(n, "window")
