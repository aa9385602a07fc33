"""Sources: catalogues, CSV in two shapes, monitor and weather JSON, ragged CSV, HTML tables, cached stages.

Readers give long tables with null for what wasn't observed; rows that are refused become receipts (reason, detail).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, site_stratum, utc_time
from .commits import staged

SCENE = "scene string, sensor string, ts timestamp, cloud double, hrefs map<string,string>, props map<string,string>, bbox struct<west:double,south:double,east:double,north:double>, epsg int"


def scenes(spark: SparkSession, path: str, sensor: str, start: str, end: str, cloud: float | None = None) -> DataFrame:
    """A scene catalogue in Parquet; sensor, time and cloud go down to the scan."""
    df = spark.read.schema(SCENE).parquet(path).where((F.col("sensor") == sensor) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return df if cloud is None else df.where(F.col("cloud") < cloud)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def long_csv(spark: SparkSession, path: str, unit: str = "field_id", day: str = "date", value: str = "ndvi", meta: tuple[str, ...] = ("lat", "lon", "area_ha", "claims_adoption")) -> tuple[DataFrame, DataFrame]:
    """Panel (unit, d, v) and one row of metadata a unit: the first value by date of each."""
    raw = spark.read.option("header", True).csv(path)
    d = F.col(day).cast("date")
    panel = raw.select(F.col(unit).alias("unit"), d.alias("d"), finite(F.col(value).try_cast("double")).alias("v"))
    got = [m for m in meta if m in raw.columns]
    units = raw.groupBy(F.col(unit).alias("unit")).agg(*[F.min_by(m, F.when(F.col(m).isNotNull(), d)).alias(m) for m in got], F.count(F.lit(1)).alias("rows"))
    return panel, units


def wide_csv(spark: SparkSession, path: str, unit: str = "field_id") -> DataFrame:
    """unit, d, v: every column named by a date is an observation."""
    raw = spark.read.option("header", True).csv(path)
    days = [c for c in raw.columns if re.fullmatch(r"\d{4}-\d{2}-\d{2}", c)]
    df = raw.select(unit, *days).unpivot([unit], days, "d", "v")
    return df.select(F.col(unit).alias("unit"), F.col("d").cast("date").alias("d"), finite(F.col("v").try_cast("double")).alias("v"))


def object_or_array(text, path: str, item: str) -> F.Column:
    """array<item>: what JSON has at path, whether it is a list, one object, or absent."""
    one = F.get_json_object(text, path)
    return F.when(F.ltrim(one).startswith("["), F.from_json(one, f"array<{item}>")).when(one.isNotNull(), F.array(F.from_json(one, item))).otherwise(F.from_json(F.lit("[]"), f"array<{item}>"))


def monitor_sites(raw: DataFrame, species: str = "NO2") -> DataFrame:
    """station, name, lat, lon, stratum, opened, closed of a JSON document column: site dates cut to the instrument's."""
    day = lambda x: F.coalesce(F.try_to_timestamp(F.nullif(x, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.nullif(x, F.lit(""))), F.lit(None)).cast("date")
    site = "struct<`@SiteCode`:string,`@SiteName`:string,`@SiteType`:string,`@Latitude`:string,`@Longitude`:string,`@DateOpened`:string,`@DateClosed`:string,Species:string>"
    s = raw.select(F.explode(object_or_array(F.col("json"), "$.Sites.Site", site)).alias("s")).select("s.*")
    kind = "struct<`@SpeciesCode`:string,`@DateMeasurementStarted`:string,`@DateMeasurementFinished`:string>"
    s = s.withColumn("sp", F.filter(object_or_array(F.concat(F.lit('{"x":'), F.coalesce("Species", F.lit("null")), F.lit("}")), "$.x", kind), lambda x: x["@SpeciesCode"] == species)).where(F.size("sp") > 0)
    begun = F.array_min(F.transform("sp", lambda x: day(x["@DateMeasurementStarted"])))
    ended = F.when(~F.exists("sp", lambda x: day(x["@DateMeasurementFinished"]).isNull()), F.array_max(F.transform("sp", lambda x: day(x["@DateMeasurementFinished"]))))
    return s.select(
        F.col("`@SiteCode`").alias("station"), F.col("`@SiteName`").alias("name"), F.col("`@Latitude`").try_cast("double").alias("lat"), F.col("`@Longitude`").try_cast("double").alias("lon"), site_stratum("`@SiteType`").alias("stratum"),
        F.greatest(day(F.col("`@DateOpened`")), begun).alias("opened"), F.least(day(F.col("`@DateClosed`")), ended).alias("closed"),
    )


def monitor_hours(raw: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """station, ts, v of hourly JSON chunks (station, chunk, json), the last chunk's row where several have an hour; and receipts."""
    rows = raw.select("station", "chunk", F.explode(F.from_json(F.get_json_object("json", "$.RawAQData.Data"), "array<struct<`@MeasurementDateGMT`:string,`@Value`:string>>")).alias("x"))
    rows = rows.select("station", "chunk", utc_time("x.`@MeasurementDateGMT`").alias("ts"), finite(F.col("x.`@Value`").try_cast("double")).alias("v"), F.col("x.`@MeasurementDateGMT`").alias("at"), F.col("x.`@Value`").alias("said"))
    ok = F.coalesce(F.col("ts").isNotNull() & (F.col("v") >= 0), F.lit(False))
    good = rows.where(ok & (F.col("ts") >= start) & (F.col("ts") < end))
    last = good.withColumn("_r", F.row_number().over(Window.partitionBy("station", "ts").orderBy(F.desc("chunk")))).where("_r = 1")
    return last.select("station", "ts", "v"), rows.where(~ok).select("station", F.substring("at", 1, 10).alias("day"), F.when(F.col("ts").isNull(), "invalid-time").otherwise("invalid").alias("reason"), F.col("said").alias("detail"))


def html_stations(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of station tables: name, lat, lon, site type and id from the first link of each table row with coordinates."""
    r = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("r"))
    cells = r.withColumn("c", F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"\s+", " "))))
    num = lambda i: F.try_element_at("c", F.lit(i)).try_cast("double")
    df = cells.select(F.try_element_at("c", F.lit(1)).alias("name"), num(2).alias("lat"), num(3).alias("lon"), F.try_element_at("c", F.lit(4)).alias("site_type"), F.nullif(F.regexp_extract("r", r"[?&](?:uka_id|site_id)=([A-Za-z0-9]+)", 1), F.lit("")).alias("uk_air_id"))
    return df.where("lat is not null and lon is not null")


def html_options(pages: DataFrame, html: str = "html") -> DataFrame:
    """norm_name, code of the options of select boxes."""
    o = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<option\s[^>]*value=[\"']?[A-Za-z0-9]+[\"']?[^>]*>[^<]*"), 0)).alias("o"))
    return o.select(plain_name(F.regexp_extract("o", r">([^<]*)$", 1)).alias("norm_name"), F.regexp_extract("o", r"value=[\"']?([A-Za-z0-9]+)", 1).alias("code"))


def plain_name(x) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def coded_stations(stations: DataFrame, options: DataFrame) -> DataFrame:
    df = stations.withColumn("norm_name", plain_name(F.col("name"))).join(options, "norm_name", "left")
    return df.withColumn("station", F.coalesce("code", "uk_air_id")).withColumn("stratum", site_stratum("site_type")).drop("norm_name", "code")


def ragged_csv(lines: DataFrame, sensor: str = "NO2") -> tuple[DataFrame, DataFrame]:
    """ts, v and receipts of files (file, n, line) with a preamble: header line, date, time, value and status columns are found.

    Hours are labelled by their end if the file says so, and by their start else; 24:00 stays on its day.
    """
    low = F.lower("line")
    is_head = low.rlike(r"\bdate\b") & low.rlike(r"no2|nitrogen dioxide")
    head = lines.groupBy("file").agg(F.min(F.when(is_head, F.col("n"))).alias("h"), F.max(F.when(is_head, F.struct((-F.col("n")).alias("m"), "line")))["line"].alias("names"), F.max(low.rlike(r"gmt\s+hour\s+ending")).alias("ending")).where("h is not null")
    names = F.transform(F.split("names", ","), lambda x: plain_name(x))
    at = lambda test: F.array_position(F.transform(names, lambda x: test(x)), True)
    head = head.withColumns({
        "di": at(lambda x: x.isin("date", "measurement date") | x.startswith("date ")), "ti": at(lambda x: x.isin("time", "measurement time") | x.startswith("time ")),
        "vi": at(lambda x: ((x == "no2") | x.startswith("nitrogen dioxide")) & ~x.contains("status") & ~x.contains("unit")), "names": names,
    }).withColumn("si", F.when(F.coalesce(F.try_element_at("names", (F.col("vi") + 1).cast("int")), F.lit("")).rlike("^status"), F.col("vi") + 1))
    rows = lines.join(F.broadcast(head), "file").where((F.col("n") > F.col("h")) & (F.trim("line") != ""))  # a row a file
    rows = rows.withColumn("f", F.transform(F.split("line", ",", -1), lambda x: F.trim(F.regexp_replace(x, '^"|"$', ""))))
    get = lambda i: F.try_element_at("f", F.col(i).cast("int"))
    day = F.coalesce(F.try_to_timestamp(get("di"), F.lit("dd-MM-yyyy")), F.try_to_timestamp(get("di"), F.lit("dd/MM/yyyy")), F.try_to_timestamp(get("di"), F.lit("yyyy-MM-dd")))
    first = F.when(F.col("ending"), 1).otherwise(0)
    hour = F.nullif(F.regexp_extract(get("ti"), r"^(\d{1,2}):00(?::00)?$", 1), F.lit("")).cast("int")
    ts = F.when(F.col("ti") == 0, day).when(hour.between(first, F.lit(24)), day + F.make_dt_interval(F.lit(0), hour - first))
    v, status = finite(get("vi").try_cast("double")), F.upper(get("si"))
    why = F.when(ts.isNull(), "invalid-time").when(F.col("si").isNotNull() & ~F.coalesce(status.isin("R", "P", "P*", "V"), F.lit(False)), "invalid-status").when(v.isNull() | (v < 0), "invalid")
    rows = rows.select("file", "n", ts.alias("ts"), v.alias("v"), why.alias("reason"), F.substring(get("di"), 1, 10).alias("day"), get("vi").alias("said"))
    good = rows.where("reason is null").withColumn("_r", F.row_number().over(Window.partitionBy("file", "ts").orderBy(F.desc("n")))).where("_r = 1").select("file", "ts", "v")
    return good, rows.where("reason is not null").select("file", "day", F.lit(sensor).alias("sensor"), "reason", F.concat(F.lit("value "), F.coalesce("said", F.lit("missing"))).alias("detail"))


def weather_days(raw: DataFrame) -> DataFrame:
    """place, d and daily weather of hourly JSON arrays (place, json): means, wind as a vector, rain as a sum where there is any."""
    h = "struct<time:array<string>,temperature_2m:array<double>,precipitation:array<double>,wind_speed_10m:array<double>,wind_direction_10m:array<double>,boundary_layer_height:array<double>>"
    df = raw.select("place", F.from_json(F.get_json_object("json", "$.hourly"), h).alias("h"))
    df = df.select("place", F.explode(F.arrays_zip(*[F.col(f"h.{c}").alias(c) for c in ("time", "temperature_2m", "precipitation", "wind_speed_10m", "wind_direction_10m", "boundary_layer_height")])).alias("x")).select("place", "x.*")
    rad = F.radians("wind_direction_10m")
    df = df.withColumn("u", -F.col("wind_speed_10m") * F.sin(rad)).withColumn("v", -F.col("wind_speed_10m") * F.cos(rad))
    return df.groupBy("place", F.to_date(F.to_timestamp("time")).alias("d")).agg(F.avg("temperature_2m").alias("temperature_2m"), F.when(F.count("precipitation") >= 1, F.sum("precipitation")).alias("precipitation"), F.avg("u").alias("wind_u"), F.avg("v").alias("wind_v"), F.avg("boundary_layer_height").alias("boundary_layer_height"))


def cases(spark: SparkSession, items: str, calls: str) -> DataFrame:
    """Items (a JSON list) with the calls (JSON lines) that were made on them."""
    return spark.read.option("multiLine", True).json(items).join(spark.read.json(calls), "case_id")


def stage(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The last whole version of a stage that sinks.stage() has written."""
    return staged(spark, f"{folder}/key={key}")
