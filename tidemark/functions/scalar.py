"""Scalar functions as Column factories: all built-in expressions, so that plans stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_M, EFFECT_REFERENCE, RATE_CENTRAL, RATE_HIGH, RATE_LOW, WORDS


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x) -> Column:
    """Null for NaN and infinities: every gate below takes null for 'not observed'."""
    v = c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(math.inf)), v)


def settled(x, digits: int = 6) -> Column:
    """Rounded half up in decimals: sums taken in another order give the same number."""
    return F.round(c(x).cast("decimal(38,10)"), digits).cast("double")


def norm_diff(a, b, positive: bool = True) -> Column:
    """(a - b) / (a + b); null unless the sum is positive (positive=False: unless it is not zero)."""
    total = c(a) + c(b)
    return F.when(total > 0 if positive else total != 0, (c(a) - c(b)) / total)


def spectral_indices(bands: list[str]) -> dict[str, Column]:
    """Those of seven indices for which bands has what they need; bands hold reflectances."""
    have = set(bands)
    nd = lambda a, b: norm_diff(a, b, positive=False)
    ratio = lambda n, d: F.when(d != 0, n / d)
    b = F.col
    needs = {
        "NDVI": ({"B08", "B04"}, lambda: nd("B08", "B04")),
        "EVI": ({"B08", "B04", "B02"}, lambda: ratio(2.5 * (b("B08") - b("B04")), b("B08") + 6 * b("B04") - 7.5 * b("B02") + 1)),
        "NDRE": ({"B08", "B05"}, lambda: nd("B08", "B05")),
        "NDWI": ({"B03", "B08"}, lambda: nd("B03", "B08")),
        "NDMI": ({"B08", "B11"}, lambda: nd("B08", "B11")),
        "NDTI": ({"B11", "B12"}, lambda: nd("B11", "B12")),
        "BSI": ({"B11", "B04", "B08", "B02"}, lambda: ratio(b("B11") + b("B04") - b("B08") - b("B02"), b("B11") + b("B04") + b("B08") + b("B02"))),
    }
    return {name: make() for name, (need, make) in needs.items() if need <= have}


def reflectance(dn, baseline) -> Column:
    """Digital number to reflectance: from processing baseline 04.00 on, 1000 is taken off and the rest floored at 0."""
    offset = F.coalesce(c(baseline).try_cast("double") >= 4.0, F.lit(False))
    return F.when(offset, F.greatest(c(dn).cast("double") - 1000, F.lit(0.0))).otherwise(c(dn).cast("double")) / 10000


def reflectance_by_date(dn, day, since: str = "2022-01-25") -> Column:
    """The older rule: the offset goes by the date of acquisition."""
    return F.when(c(day) >= F.lit(since).cast("date"), F.greatest(c(dn).cast("double") - 1000, F.lit(0.0))).otherwise(c(dn).cast("double")) / 10000


def decibel(x) -> Column:
    return F.when(c(x) > 0, 10 * F.log10(c(x)))


SCALE, CLOUD, MASKED = 32000.0, 65535, 0


def encode_index(v) -> Column:
    """An index from -1 to 1 as a 16-bit code; null is the code for cloud."""
    return F.coalesce((F.floor((c(v) + 1) * SCALE + 0.5) + 1).cast("int"), F.lit(CLOUD))


def decode_index(high, low) -> Column:
    """struct(value, clear) of a code's two bytes; value is null where the code says so."""
    q = c(high).cast("int") * 256 + c(low).cast("int")
    return F.struct(F.when(q.between(1, int(2 * SCALE) + 1), (q - 1) / SCALE - 1).alias("value"), (~q.isin(CLOUD, MASKED)).alias("clear"))


def encode_decibel(v, low: float = -50.0, high: float = 15.0, scale: float = 1000.0) -> Column:
    return (F.floor((F.least(F.greatest(c(v), F.lit(low)), F.lit(high)) - low) * scale + 0.5) + 1).cast("int")


def decode_decibel(high_byte, low_byte, low: float = -50.0, high: float = 15.0, scale: float = 1000.0) -> Column:
    """Linear power of a code's two bytes; null where the code is none."""
    q = c(high_byte).cast("int") * 256 + c(low_byte).cast("int")
    return F.when(q.between(1, round((high - low) * scale) + 1), F.pow(F.lit(10.0), ((q - 1) / scale + low) / 10))


def great_circle_m(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    """Great-circle distance; null if a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(c(b) - c(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(c(lat1))) * F.cos(F.radians(c(lat2))) * half(lon1, lon2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def utm_epsg(lon, lat) -> Column:
    zone = F.least(F.greatest(F.floor((c(lon) + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(c(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_utm(lon, lat, zone=None) -> Column:
    """struct(x, y): transverse Mercator on WGS84 by Krueger's series (to n^3; millimetres within a zone)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    z = c(zone) if zone is not None else F.least(F.greatest(F.floor((c(lon) + 180) / 6) + 1, F.lit(1)), F.lit(60))
    phi, lam = F.radians(c(lat)), F.radians(c(lon) - (z * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(al, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + 0.9996 * big_a * x).alias("x"), (F.when(c(lat) < 0, 10_000_000.0).otherwise(0.0) + 0.9996 * big_a * y).alias("y"))


def off_season(day, lat=None) -> Column:
    """Whether a date is in the months of the off-season, half a year later in the south."""
    m = F.month(c(day))
    south = F.pmod(m + 5, F.lit(12)) + 1
    return F.when(F.coalesce(c(lat) < 0, F.lit(False)), south).otherwise(m).isin(10, 11, 12, 3, 4) if lat is not None else m.isin(10, 11, 12, 3, 4)


def site_stratum(label) -> Column:
    s = F.translate(F.lower(F.trim(F.coalesce(c(label), F.lit("")))), "_", " ")
    return F.when(s.rlike("traffic|roadside|kerb"), "traffic").when(s.rlike("background|urban cent(re|er)|suburban"), "background").otherwise("unknown")


def active_on(opened, closed, day) -> Column:
    """opened <= day <= closed, with open ends where null."""
    return (F.coalesce(c(opened), c(day)) <= c(day)) & (F.coalesce(c(closed), c(day)) >= c(day))


def doy_distance(a, b) -> Column:
    d = F.abs(c(a) - c(b))
    return F.least(d, 366 - d)


def off_season_weight(doy) -> Column:
    step = F.when((c(doy) >= 288) | (c(doy) <= 120), 1.0).otherwise(0.0)
    return 0.5 * (step + F.least(F.greatest(F.cos((c(doy) - 30) / 90.0), F.lit(0.0)), F.lit(1.0)))


def content_id(*parts, size: int = 16) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[c(p).cast("string") for p in parts]), 256), 1, size)


def fixed(v, digits: int) -> Column:
    return F.when(c(v).isNotNull(), F.format_string(f"%.{digits}f", c(v).cast("double")))


def magnitude(v, signal) -> Column:
    radar = c(signal).isin("VV", "VH", "RATIO")
    return F.when(radar, F.concat(fixed(F.abs(c(v)), 1), F.lit(" dB"))).otherwise(fixed(F.abs(c(v)), 2))


def signed(v, signal) -> Column:
    """With sign; minus as its own character, as printed."""
    radar = c(signal).isin("VV", "VH", "RATIO")
    body = F.when(radar, F.concat(fixed(F.abs(c(v)), 1), F.lit(" dB"))).otherwise(fixed(F.abs(c(v)), 2))
    return F.concat(F.when(c(v) < 0, "−").otherwise("+"), body)


def moved(v, signal) -> Column:
    word = F.coalesce(*[F.when(c(signal) == k, w) for k, w in WORDS.items()])
    return F.concat(word, F.when(c(v) < 0, " fell by ").otherwise(" rose by "), magnitude(v, signal))


def minute_key(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm")


def epsg_number(s) -> Column:
    return F.nullif(F.regexp_extract(c(s), r"(\d{4,6})\s*$", 1), F.lit("")).cast("int")


def utc_time(s) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c(s), r"Z$", "+00:00"))


def days_from(day, anchor) -> Column:
    return F.datediff(c(day), c(anchor))


def placebo_count(p, n) -> Column:
    """k of p = (k + 1) / (n + 1); halves round to even."""
    return F.greatest(F.bround(c(p) * (c(n) + 1)).cast("int") - 1, F.lit(0))


def pixel_m(lat, degrees: float = 0.00025) -> Column:
    return F.struct((111_320.0 * degrees * F.cos(F.radians(c(lat)))).alias("width"), F.lit(110_574.0 * degrees).alias("height"))


def size_bucket(ha) -> Column:
    return F.when(c(ha) < 5, "small").when(c(ha) < 25, "medium").otherwise("large")


def tile_name(lat, lon, step: int = 10) -> Column:
    """Name of the tile by its upper left corner."""
    top, left = F.ceil(c(lat) / step) * step, F.floor(c(lon) / step) * step
    pad = lambda v, n: F.lpad(F.abs(v).cast("string"), n, "0")
    return F.concat(pad(top, 2), F.when(top >= 0, "N").otherwise("S"), F.lit("_"), pad(left, 3), F.when(left >= 0, "E").otherwise("W"))


def carbon(effect, area_ha, verified) -> Column:
    """struct(low, central, high, rate): zero unless verified and positive."""
    on = c(verified) & (c(effect) > 0)
    rate = RATE_LOW + F.least(F.greatest(c(effect) / EFFECT_REFERENCE, F.lit(0.0)), F.lit(1.0)) * (RATE_CENTRAL - RATE_LOW)
    z = lambda v: F.when(on, v).otherwise(0.0)
    return F.struct(z(RATE_LOW * c(area_ha)).alias("low"), z(rate * c(area_ha)).alias("central"), z(RATE_HIGH * c(area_ha)).alias("high"), z(rate).alias("rate"))


def instability(yearly) -> Column:
    """0.5 to 2.5 for an array of yearly effects: decline from the peak and volatility against it."""
    y = c(yearly)
    n = F.size(y)
    peak = F.greatest(F.array_max(y), F.lit(1e-6))
    mean = F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / n
    std = F.sqrt(F.aggregate(y, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    clip = lambda v, a, b: F.least(F.greatest(v, F.lit(a)), F.lit(b))
    m = 0.6 + 1.6 * clip((peak - F.element_at(y, -1)) / peak, 0.0, 1.0) + 0.6 * clip(std / peak, 0.0, 1.0)
    return F.when(n < 2, 1.0).otherwise(clip(m, 0.5, 2.5))


def hazard(base, yearly, reversed_) -> Column:
    h = F.least(F.greatest(F.greatest(c(base), F.lit(0.01)) * instability(yearly), F.lit(0.0)), F.lit(0.6))
    return F.when(c(reversed_), F.greatest(h, F.lit(0.25))).otherwise(h)


def survival(rate, reversed_, horizon: int = 10) -> Column:
    years = F.sequence(F.lit(0), F.lit(horizon))
    return F.when(c(reversed_), F.transform(years, lambda t: F.when(t == 0, 1.0).otherwise(0.05))).otherwise(F.transform(years, lambda t: F.exp(-c(rate) * t)))


def or_zero(x) -> Column:
    """0 for what is no finite number."""
    return F.coalesce(finite(c(x).try_cast("double")), F.lit(0.0))


def bin_index(day, anchor, width: int) -> Column:
    """Bins counted from the anchor, which begins bin 0; floors, so that days before it are negative."""
    return F.floor(F.datediff(c(day), c(anchor)) / width).cast("int")


def week_ending(day) -> Column:
    """The Sunday that ends the week."""
    return F.date_add(F.trunc(c(day), "WEEK"), 6)
