"""SQL functions that Spark lacks or reads in another way, with the common server meaning, as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """concat that skips nulls."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def substr(text: Column, start: Column, length: Column) -> Column:
    """substring whose start may lie before the text; that part of the length is lost."""
    start, length = start.cast("int"), length.cast("int")
    lost = F.least(F.lit(0), start - 1)
    return F.substr(text, F.greatest(start, F.lit(1)), F.greatest(F.lit(0), length + lost))


def left(text: Column, n: int) -> Column:
    """First n characters; all but the last -n where n is negative."""
    return F.substr(text, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.lit(0), F.length(text) + n))


def right(text: Column, n: int) -> Column:
    """Last n characters; all but the first -n where n is negative."""
    size = F.least(F.length(text), F.lit(n)) if n >= 0 else F.greatest(F.lit(0), F.length(text) + n)
    return F.substr(text, F.length(text) - size + 1, size)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps, folded: 64-bit numbers need at most 92."""
    state = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    step = lambda s, _: state(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % F.nullif(s["y"], F.lit(0))))
    return F.abs(F.aggregate(F.sequence(F.lit(1), F.lit(92)), state(a.cast("bigint"), b.cast("bigint")), step, lambda s: s["x"]))


def lcm(a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise((F.abs(a * b) / F.nullif(gcd(a, b), F.lit(0))).cast("bigint"))


def array_length(a: Column) -> Column:
    """Null for an empty array."""
    return F.nullif(F.size(a), F.lit(0))


def array_position(a: Column, value: Column) -> Column:
    """Null where the value is absent."""
    return F.nullif(F.array_position(a, value), F.lit(0).cast("bigint"))


def contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def width_bucket(value: Column, bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda x: x <= value))


def day_of_week(ts: Column) -> Column:
    """0 for Sunday."""
    return F.dayofweek(ts) - 1


def epoch(ts: Column) -> Column:
    """Seconds since 1970 with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def date_bin(seconds: int, ts: Column, origin: str) -> Column:
    """Start of the bin of so many seconds, counted from origin, that holds ts."""
    start = F.unix_micros(F.lit(origin).cast("timestamp"))
    size = F.lit(seconds * 1_000_000)
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros - start, size)).cast("timestamp_ntz")


def age_months_days(later: Column, earlier: Column) -> Column:
    """Struct of whole months and the days left over."""
    months = F.floor(F.months_between(later, earlier)).cast("int")
    return F.struct(months.alias("months"), F.datediff(later, F.add_months(earlier, months)).alias("days"))


def erf(x: Column) -> Column:
    """Error function by its power series near 0 and by 1 - erfc beyond; about 1e-12."""
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.cast("double").alias("t"), x.cast("double").alias("s")), lambda a, n: F.struct((-a["t"] * x * x / n).alias("t"), (a["s"] - a["t"] * x * x / n / (2 * n + 1)).alias("s")), lambda a: a["s"] * 2 / F.sqrt(F.lit(math.pi)))
    return F.when(F.abs(x) < 2.5, near).otherwise(F.signum(x) * (1 - _erfc_far(F.abs(x))))


def erfc(x: Column) -> Column:
    """1 - erf, exact in its small values."""
    return F.when(F.abs(x) < 2.5, 1 - erf(x)).when(x > 0, _erfc_far(x)).otherwise(2 - _erfc_far(-x))


def _erfc_far(x: Column) -> Column:
    """The continued fraction x + (1/2)/(x + (2/2)/(x + ...)), for x of 2.5 and more."""
    x = F.greatest(x.cast("double"), F.lit(2.5))
    below = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(60))), x, lambda a, n: x + n / 2.0 / a)
    return F.exp(-x * x) / F.sqrt(F.lit(math.pi)) / below


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams of two lower-cased, padded words."""

    def trigrams(t: Column) -> Column:
        padded = F.concat(F.lit("  "), F.lower(t), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))

    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(h))


# Ranges: structs of lo, hi, with lo included and hi not; null ends are open


def range_of(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull() | hi.isNull() | (lo < hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def range_contains(r: Column, x: Column) -> Column:
    return F.coalesce(r["lo"] <= x, F.lit(True)) & F.coalesce(x < r["hi"], F.lit(True))


def range_overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(a["lo"] < b["hi"], F.lit(True)) & F.coalesce(b["lo"] < a["hi"], F.lit(True))


def range_adjacent(a: Column, b: Column) -> Column:
    return F.coalesce(a["hi"] == b["lo"], F.lit(False)) | F.coalesce(b["hi"] == a["lo"], F.lit(False))


def range_intersection(a: Column, b: Column) -> Column:
    return F.when(range_overlaps(a, b), F.struct(F.greatest(a["lo"], b["lo"]).alias("lo"), F.least(a["hi"], b["hi"]).alias("hi")))


def range_merge(a: Column, b: Column) -> Column:
    """The smallest range that holds both; open ends stay open."""
    lo = F.when(a["lo"].isNotNull() & b["lo"].isNotNull(), F.least(a["lo"], b["lo"]))
    hi = F.when(a["hi"].isNotNull() & b["hi"].isNotNull(), F.greatest(a["hi"], b["hi"]))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def range_union(a: Column, b: Column) -> Column:
    """Both ranges as one, null where a gap lies between them."""
    return F.when(range_overlaps(a, b) | range_adjacent(a, b), range_merge(a, b))


def range_minus(a: Column, b: Column) -> Column:
    """What of a lies outside b, null if that is nothing; b may not part a in two."""
    left, right = a["lo"] < b["lo"], b["hi"] < a["hi"]
    cut = F.when(left & right, F.raise_error(F.lit("the difference is not one range"))).when(left, F.struct(a["lo"].alias("lo"), F.least(a["hi"], b["lo"]).alias("hi"))).when(right, F.struct(F.greatest(a["lo"], b["hi"]).alias("lo"), a["hi"].alias("hi")))
    return F.when(~range_overlaps(a, b), a).otherwise(cut)


# Numbers, dates and texts in patterns


def quote_ident(name: Column) -> Column:
    """A name as it must stand in SQL: quoted unless it is plain."""
    return F.when(name.rlike("^[a-z_][a-z0-9_$]*\\z"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_nullable(text: Column) -> Column:
    return F.coalesce(quote_literal(text), F.lit("NULL"))


def trunc(x: Column, digits: int = 0) -> Column:
    """Cut towards zero after so many digits."""
    scale = F.lit(10.0**digits)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding of floats: halves to the even neighbour."""
    return F.bround(x, digits)


def initcap(text: Column) -> Column:
    """First letter of each run of letters and digits in upper case, the rest in lower."""
    return F.array_join(F.transform(F.split(F.lower(text), "(?<=[^\\p{Alnum}])|(?=[^\\p{Alnum}])"), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")


# Patterns of to_char and what Spark calls them, longest first.
DATE_PATTERNS = [("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("Q", "q"), ("DDD", "DDD")]


def date_pattern(pattern: str) -> str:
    """A to_char pattern as Spark's date_format reads it; other letters stand for themselves."""
    known = sorted(DATE_PATTERNS, key=lambda p: -len(p[0]))
    names = dict(known)
    pieces = re.findall("|".join(re.escape(k) for k, _ in known) + r"|[A-Za-z](?:(?!" + "|".join(re.escape(k) for k, _ in known) + r")[A-Za-z])*|[^A-Za-z]+", pattern)
    return "".join(names.get(x, f"'{x}'" if x[0].isalpha() else x) for x in pieces)


def to_char_date(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, date_pattern(pattern))


def to_date(text: Column, pattern: str) -> Column:
    return F.to_date(text, date_pattern(pattern))


def justify(seconds: Column) -> Column:
    """Days, hours, minutes and seconds of a number of seconds: months are never made of days."""
    days = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    return F.struct(days.alias("days"), F.floor(rest / 3600).cast("int").alias("hours"), F.floor(rest % 3600 / 60).cast("int").alias("minutes"), (rest % 60).cast("int").alias("seconds"))


def at_time_zone(ts: Column, zone: str) -> Column:
    """The local time in a zone of a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def unaccent(text: Column) -> Column:
    """Common accented letters without their accents."""
    return F.translate(text, "àáâãäåèéêëìíîïòóôõöùúûüçñÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÇÑ", "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN")


def scale_of(number: Column) -> Column:
    """Digits behind the point of a number as text."""
    return F.coalesce(F.length(F.nullif(F.split_part(number, F.lit("."), F.lit(2)), F.lit(""))), F.lit(0))


def trim_scale(number: Column) -> Column:
    """A number as text without zeros at the end of its fraction."""
    return F.when(number.contains("."), F.rtrim(F.rtrim(number, F.lit("0")), F.lit("."))).otherwise(number)


# Row forms


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def limit_with_ties(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows and all that tie with the last of them: a bounded top-k finds the border, a filter the rows."""
    named = df.select("*", F.struct(*order).alias("_key")) if all(isinstance(o, str) for o in order) else None
    if named is None:
        raise ValueError("order takes column names; sort descending by a negated column")
    border = named.orderBy("_key").limit(n).agg(F.max("_key").alias("_border"))
    return named.crossJoin(F.broadcast(border)).where(F.col("_key") <= F.col("_border")).drop("_key", "_border")


def nulls_last(name: str, descending: bool = False) -> Column:
    """The sort order of a column with the reference's default for nulls: last ascending, first descending."""
    return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()
