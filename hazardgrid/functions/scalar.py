"""Scalar expressions; all stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NIGHT_HOURS, PEAK_HOURS

# Variant characters and what they stand for.
NAME_FROM = "臺０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ　"
NAME_TO = "台0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz "
DIGITS_FROM, DIGITS_TO = "零〇一二三四五六七八九", "00123456789"

#: Tens and hundreds between digits, in this order: (pattern, pieces).
#: A piece is the number of a group or text.
NUMERALS = (
    ("([1-9])十([1-9])", (1, 2)), ("([1-9])十", (1, "0")), ("十([1-9])", ("1", 1)), ("十", ("10",)),
    ("([1-9])百([1-9][0-9])", (1, 2)), ("([1-9])百0?([1-9])", (1, "0", 2)), ("([1-9])百", (1, "00")),
)


def kernel_squared(d2: Column, radius: float) -> Column:
    """Epanechnikov weight from a squared distance; 0 from the radius on."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    return F.when(d2 >= radius * radius, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - d2 / (radius * radius)))


def kernel(distance: Column, radius: float) -> Column:
    """Epanechnikov weight of a distance."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    return F.when(distance >= radius, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.pow(distance / radius, F.lit(2.0))))


def severity(fatalities: Column, weight: float) -> Column:
    return 1.0 + fatalities * weight


def star(score: Column) -> Column:
    """Half stars from 0.5 to 5, halves rounded to even."""
    return F.greatest(F.lit(0.5), F.least(F.lit(5.0), F.bround(score / 20 * 2) / 2))


def clamp_score(value: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value.cast("double")))).cast("int")


def confidence(n: Column) -> Column:
    return F.when(n >= 30, "high").when(n >= 12, "mid").otherwise("low")


def tone(score: Column) -> Column:
    return F.when(score < 60, "bad").when(score < 75, "mid").otherwise("ok")


def grade(score: Column) -> Column:
    return F.when(score < 45, "higher risk").when(score < 60, "medium risk").when(score < 80, "fairly safe").otherwise("very safe")


def bars(score: Column) -> Column:
    """Bars of ten, halves rounded up."""
    return F.round(score / 10).cast("int")


def text_hash(text: Column) -> Column:
    """31 * n + code modulo 997 over the characters."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda n, c: (n * 31 + F.ascii(c)) % 997)


def is_peak(hour: Column) -> Column:
    return hour.isin(*PEAK_HOURS)


def is_night(hour: Column) -> Column:
    return hour.isin(*NIGHT_HOURS)


def mentions(parties: Column, *words: str) -> Column:
    """Whether a text, null as empty, holds any of the words."""
    text = F.coalesce(parties, F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def minutes(km: Column, kmh: float) -> Column:
    return F.greatest(F.lit(2), F.bround(km / kmh * 60).cast("int"))


def floored_km(length_m: Column) -> Column:
    return F.greatest(length_m / 1000.0, F.lit(0.1))


def high_per_km(n: Column, km: Column) -> Column:
    return n / F.greatest(km, F.lit(0.5))


def occurred_at(ymd: Column, hms: Column) -> Column:
    return F.concat(F.substring(ymd, 1, 4), F.lit("-"), F.substring(ymd, 5, 2), F.lit("-"), F.substring(ymd, 7, 2), F.lit(" "), F.substring(hms, 1, 2), F.lit(":"), F.substring(hms, 3, 2))


def route_label(index: Column) -> Column:
    return F.when(index == 0, "shortest").otherwise(F.concat(F.lit("alternative "), F.char(64 + index)))


def normalise_name(name: Column) -> Column:
    """Variant characters, full width, Chinese numerals below a thousand, case and outer blanks."""
    out = F.translate(F.translate(name, NAME_FROM, NAME_TO), DIGITS_FROM, DIGITS_TO)
    for pattern, pieces in NUMERALS:
        out = F.regexp_replace(out, pattern, "".join(f"${p}" if isinstance(p, int) else p for p in pieces))
    return F.lower(F.trim(out))


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces; a shorter text is one piece."""

    def pieces(one: Column) -> Column:
        n = F.length(one)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(one, i, F.lit(3)))
        return F.array_distinct(F.when(n == 0, F.array().cast("array<string>")).otherwise(cut))

    # bound to a variable: a text that is computed would be computed again for each piece
    return F.transform(F.array(text), pieces)[0]


def jitter(ident: Column, reach: float) -> tuple[Column, Column]:
    """A fixed offset for each id, within ``reach`` on either axis, from its MD5."""
    digest = F.md5(ident.cast("string"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint").cast("double")
    return part(1) / 4294967295.0 * 2 * reach - reach, part(9) / 4294967295.0 * 2 * reach - reach


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin; equirectangular, for the extent of a city."""
    metre = math.pi / 180 * 6371008.8
    return (lon - lon0) * (metre * math.cos(math.radians(lat0))), (lat - lat0) * metre


def unproject(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    metre = math.pi / 180 * 6371008.8
    return lat0 + y / metre, lon0 + x / (metre * math.cos(math.radians(lat0)))
