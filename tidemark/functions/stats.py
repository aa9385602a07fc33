"""Small statistics as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import c

Z95 = 1.959963984540054


def wilson(k, n, z: float = Z95) -> Column:
    """struct(rate, lo, hi): a proportion with its 95 % Wilson interval; null without trials."""
    n_ = F.when(c(n) > 0, c(n).cast("double"))
    p = c(k) / n_
    d = 1 + z * z / n_
    mid, half = (p + z * z / (2 * n_)) / d, z / d * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))
    return F.struct(p.alias("rate"), F.greatest(F.lit(0.0), mid - half).alias("lo"), F.least(F.lit(1.0), mid + half).alias("hi"))


def fit_ratio(effect, pre) -> Column:
    """Root mean square after over before the event (an aggregate)."""
    sq = c(effect) * c(effect)
    return F.sqrt(F.avg(F.when(~c(pre), sq))) / (F.sqrt(F.avg(F.when(c(pre), sq))) + 1e-9)


def rank_p(hit) -> Column:
    """(hits + 1) / (rows + 1), an aggregate over placebo units."""
    return (F.count_if(c(hit)) + 1) / (F.count(F.lit(1)) + 1)


def step_up(df: DataFrame, p: str = "p", key: str = "id", alpha: float = 0.05, family: str | None = None, parts: int = 4096) -> DataFrame:
    """df with found: false-discovery step-up over p (0 to 1), by family.

    Ranks come from counts of distinct p, summed within equal parts of the range of p; a part starts from the counts of the
    parts before it, a row a part. So no task sorts a whole family.
    """
    keys = [family] if family else []
    by = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.floor(F.col(p) * parts))
    per = by.groupBy(*keys, "_b").agg(F.sum("_c").alias("_k"))  # at most parts + 1 rows a family
    w = Window.partitionBy(*keys)
    per = per.select(*keys, "_b", F.coalesce(F.sum("_k").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_k").over(w).alias("_n"))
    by = by.join(per, [*keys, "_b"]).withColumn("_r", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(p)))
    cut = by.where(F.col(p) <= alpha * F.col("_r") / F.col("_n")).groupBy(*keys).agg(F.max(p).alias("_cut"))
    df = df.join(F.broadcast(cut), keys, "left") if keys else df.crossJoin(F.broadcast(cut))  # one row a family
    return df.withColumn("found", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def bonferroni(*ps) -> Column:
    """min(1, k min p) over those that are there."""
    k = sum((F.when(c(p).isNotNull(), 1).otherwise(0) for p in ps[1:]), F.when(c(ps[0]).isNotNull(), 1).otherwise(0))
    low = F.least(*[F.coalesce(c(p), F.lit(9.0)) for p in ps])
    return F.when(k > 0, F.least(F.lit(1.0), k * low))


def cyclic_p(residuals, post) -> Column:
    """Share of cyclic windows, as long as the post period, whose absolute mean reaches the post period's.

    residuals, post: arrays in order of time, the post period last; all windows of one row, in built-in functions.
    """
    u, t = c(residuals), F.size(c(residuals))
    q = F.size(F.filter(c(post), lambda x: x))
    run = F.aggregate(F.concat(u, u), F.array(F.lit(0.0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    stat = lambda s: F.abs(F.element_at(run, s + q + 1) - F.element_at(run, s + 1)) / q
    seen = stat(t - q)
    return F.aggregate(F.transform(F.sequence(F.lit(0), t - 1), lambda s: F.when(stat(s) >= seen - 1e-12, 1).otherwise(0)), F.lit(0), lambda a, v: a + v) / t
