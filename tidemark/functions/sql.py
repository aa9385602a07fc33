"""The scalar library for SQL users: SQL functions that Catalyst inlines, and task expansion as a table function.

register(spark) makes them session functions named tm_...; a query with them has the plan of the same query written with
the columns of functions.scalar. tm_tasks takes a table argument partitioned by verdict.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import EARTH_M
from .scalar import CLOUD, SCALE

_HALF = "pow(sin(radians({b} - {a}) / 2), 2)"

# name -> (parameters, type, body)
SCALARS = {
    "tm_finite": ("x DOUBLE", "DOUBLE", "CASE WHEN NOT isnan(x) AND abs(x) <> double('infinity') THEN x END"),
    "tm_norm_diff": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a + b > 0 THEN (a - b) / (a + b) END"),
    "tm_decibel": ("x DOUBLE", "DOUBLE", "CASE WHEN x > 0 THEN 10 * log10(x) END"),
    "tm_index_code": ("v DOUBLE", "INT", f"coalesce(CAST(floor((v + 1) * {SCALE} + 0.5D) + 1 AS INT), {CLOUD})"),
    "tm_reflectance": ("dn DOUBLE, baseline STRING", "DOUBLE", "CASE WHEN coalesce(try_cast(baseline AS DOUBLE) >= 4.0D, false) THEN greatest(dn - 1000, 0D) ELSE dn END / 10000"),
    "tm_great_circle_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", f"2 * {EARTH_M}D * asin(sqrt(least(1D, {_HALF.format(a='lat1', b='lat2')} + cos(radians(lat1)) * cos(radians(lat2)) * {_HALF.format(a='lon1', b='lon2')})))"),
    "tm_utm_epsg": ("lon DOUBLE, lat DOUBLE", "INT", "CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INT)"),
    "tm_bin": ("day DATE, event DATE, width INT", "INT", "CAST(floor(datediff(day, event) / width) AS INT)"),
    "tm_off_season": ("day DATE, lat DOUBLE", "BOOLEAN", "CASE WHEN coalesce(lat < 0, false) THEN pmod(month(day) + 5, 12) + 1 ELSE month(day) END IN (10, 11, 12, 3, 4)"),
}

# name -> (parameters, columns, body)
TABLES = {
    "tm_tiles": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, size DOUBLE", "tx BIGINT, ty BIGINT", "SELECT inline(flatten(transform(sequence(floor(x0 / size), floor(x1 / size)), x -> transform(sequence(floor(y0 / size), floor(y1 / size)), y -> struct(x, y)))))"),
}


class Tasks:
    """verdict, kind, j, theta: the fits that a verdict needs, from its units.

    Arguments: a table (verdict, unit, ...) partitioned by verdict, the most placebo units, fake dates, and null effects to
    test with their span. Unit 0 is the treated one; placebo units are evenly spaced among the others in their order. A
    partition's task holds that verdict's unit numbers, and no more.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, placebos: AnalyzeArgument, fake: AnalyzeArgument, thetas: AnalyzeArgument, span: AnalyzeArgument) -> AnalyzeResult:
        from pyspark.sql.types import DoubleType, LongType, StringType, StructType

        if not rows.isTable or not {"verdict", "unit"} <= {f.name for f in rows.dataType.fields}:
            raise ValueError("tm_tasks takes a table with verdict and unit, partitioned by verdict")
        schema = StructType().add("verdict", rows.dataType["verdict"].dataType).add("kind", StringType()).add("j", LongType()).add("theta", DoubleType())
        return AnalyzeResult(schema)

    def __init__(self) -> None:
        self.verdict, self.units, self.how = None, set(), None

    def eval(self, rows, placebos: int, fake: int, thetas: int, span: float) -> None:
        self.verdict, self.how = rows["verdict"], (placebos, fake, thetas, span)
        self.units.add(rows["unit"])

    def terminate(self):
        if not self.how:
            return
        placebos, fake, thetas, span = self.how
        n = len(self.units - {0})
        yield self.verdict, "treated", 0, None
        for j in range(1, fake + 1):
            yield self.verdict, "time", j, None
        for i in range(min(n, placebos)):
            yield self.verdict, "space", i if n <= placebos else round(i * (n - 1) / (placebos - 1)), None
        for j in range(thetas):
            yield self.verdict, "theta", j, -span + 2 * span * j / (thetas - 1) if thetas > 1 else 0.0


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    spark.udtf.register("tm_tasks", udtf(Tasks))
