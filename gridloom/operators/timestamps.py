"""Mixed timestamp texts to one UTC instant.

An ordered cascade of anchored patterns turns a text into named parts; the first pattern that fits decides and the
parts are then checked strictly (no month 13, no 30 February, no 13 PM). A zone or offset in the text holds;
otherwise the caller's default zone does, and a date alone is its midnight in UTC. Local times that a clock change
skipped give ``nonexistent``; those it repeated give ``ambiguous`` unless the text tells the offset.

Everything is built-in column arithmetic, so the parse stays in the scan's stage and needs no shuffle. Columns that
start with an underscore are reserved for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month names and the offsets, in minutes, of zone abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600,
}

_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?: ?([ap])\.?m\.?)?"
_ZONE = r"(?: ?(z|[a-z]{3,4}|[+-]\d{2}(?::?\d{2})?))?"
_CLOCK = rf"(?:(?:t| |, ?){_TIME}{_HALF}{_ZONE})?"


@dataclass(frozen=True)
class Pattern:
    """One anchored format. ``parts`` maps the regex groups to the fields, separated by ``|``:

    order, a, b, c, hour, minute, second, fraction, half, zone — order ``ymd``, ``dmy``, ``num`` (the country
    decides between day and month first) or ``sec``/``ms`` (an epoch in a).
    """

    name: str
    regex: str
    parts: str


CASCADE = (
    Pattern("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_CLOCK}$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    Pattern("numeric", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_CLOCK}$", "num|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    Pattern("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}){_CLOCK}$", "dmy|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    Pattern("day month year", rf"^(\d{{1,2}})[ -]{_MONTH},?[ -](\d{{4}}|\d{{2}}){_CLOCK}$", "dmy|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    Pattern("month day year", rf"^{_MONTH} (\d{{1,2}}),? (\d{{4}}){_CLOCK}$", "dmy|$2|$1|$3|$4|$5|$6|$7|$8|$9"),
    Pattern("compact", r"^(\d{4})(\d{2})(\d{2})(?:[t ]?(\d{2})(\d{2})(\d{2})?)?(z)?$", "ymd|$1|$2|$3|$4|$5|$6|||$7"),
    Pattern("epoch seconds", r"^(\d{9,10})$", "sec|$1||||||||"),
    Pattern("epoch milliseconds", r"^(\d{12,13})$", "ms|$1||||||||"),
)

_DAY_US = 86_400_000_000


def _whole(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def clean(text: Column) -> Column:
    """Lower case, outer blanks off, any run of (also non-breaking) blanks one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s  -​ 　]+", " "))


def split_parts(text: Column, cascade: tuple[Pattern, ...] = CASCADE) -> Column:
    """Parts, as an array of ten texts, of the first pattern that fits the ``clean`` text; null if none does."""
    tries = [F.when(text.rlike(p.regex), F.regexp_replace(text, p.regex, p.parts)) for p in cascade]
    return F.split(F.coalesce(*tries), r"\|", -1)


def with_read(df: DataFrame, text: Column, day_first: Column, out: str) -> DataFrame:
    """Add struct ``out`` (naive_us, offset_min, has_clock) of a timestamp text; null where it can't be read.

    ``day_first`` orders purely numeric dates; where it is null such a date is unreadable, unless day and month are
    the same number. Each step is a projection of its own, so no pattern is matched twice.
    """
    at = lambda i: F.element_at("_parts", i + 1)
    col = F.col
    month_names = F.expr("map(" + ", ".join(f"'{m}', '{i + 1}'" for i, m in enumerate(MONTHS)) + ")")
    offsets = F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in ABBREVIATIONS.items()) + ")")
    names = ("_order", "_a", "_b", "_c", "_hour", "_minute", "_second", "_fraction", "_half", "_zone_text")

    df = df.withColumn("_text", clean(text)).withColumn("_parts", split_parts(col("_text"))).withColumn("_first", day_first)
    df = df.withColumns({n: at(i) for i, n in enumerate(names)})
    same = col("_a").try_cast("int") == col("_b").try_cast("int")
    numeric_day = F.when(col("_first") | same, col("_a")).when(~col("_first"), col("_b"))
    numeric_month = F.when(col("_first") | same, col("_b")).when(~col("_first"), col("_a"))
    year = F.when(col("_order") == "ymd", col("_a")).otherwise(col("_c"))
    df = df.withColumns({
        "_year": F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year),
        "_month": F.when(col("_order") == "num", numeric_month).otherwise(F.coalesce(F.try_element_at(month_names, col("_b")), col("_b"))),
        "_day": F.when(col("_order") == "ymd", col("_c")).when(col("_order") == "num", numeric_day).otherwise(col("_a")),
        "_hour": _whole(col("_hour")), "_minute": _whole(col("_minute")), "_second": F.coalesce(_whole(col("_second")), F.lit(0)),
        "_has_clock": col("_hour") != "",
    })
    half = F.when(col("_hour").between(1, 12), col("_hour") % 12 + F.when(col("_half") == "p", 12).otherwise(0))
    sign = F.substring("_zone_text", 1, 1)
    digits = F.rpad(F.regexp_replace(F.substring("_zone_text", 2, 9), ":", ""), 4, "0")
    df = df.withColumns({
        "_date_us": F.unix_date(F.concat("_year", F.lit("-"), "_month", F.lit("-"), "_day").try_cast("date")).cast("long") * _DAY_US,
        "_hour": F.when(col("_half") == "", col("_hour")).otherwise(half),
        "_micros": F.when(col("_fraction") == "", F.lit(0)).otherwise(F.substring(F.rpad("_fraction", 6, "0"), 1, 6).try_cast("long")),
        "_zone_hour": F.substring(digits, 1, 2).try_cast("int"), "_zone_minute": F.substring(digits, 3, 2).try_cast("int"),
        "_signed": sign.isin("+", "-"), "_sign": F.when(sign == "-", -1).otherwise(1),
    })
    midnight = (col("_hour") == 24) & (col("_minute") == 0) & (col("_second") == 0)
    within = col("_hour").between(0, 23) & col("_minute").between(0, 59) & col("_second").between(0, 59)
    stated = F.when(col("_zone_hour").between(0, 18) & col("_zone_minute").between(0, 59), (col("_zone_hour") * 60 + col("_zone_minute")) * col("_sign"))
    df = df.withColumns({
        "_clock_us": F.when(~col("_has_clock"), F.lit(0)).when(
            within | midnight, (col("_hour") * 3600 + col("_minute") * 60 + col("_second")).cast("long") * 1_000_000 + col("_micros")
        ),
        "_offset": F.when(col("_signed"), stated).otherwise(F.try_element_at(offsets, col("_zone_text"))),
        "_epoch": col("_order").isin("sec", "ms"),
    })
    epoch_us = col("_a").try_cast("long") * F.when(col("_order") == "sec", 1_000_000).otherwise(1000)
    zone_read = (col("_zone_text") == "") | col("_offset").isNotNull()
    df = df.withColumn("_naive", F.when(col("_epoch"), epoch_us).when(zone_read, col("_date_us") + col("_clock_us")))
    offset = F.when(col("_epoch"), F.lit(0)).otherwise(col("_offset"))
    read = F.struct(col("_naive").alias("naive_us"), offset.alias("offset_min"), (col("_has_clock") | col("_epoch")).alias("has_clock"))
    df = df.withColumn(out, F.when(col("_naive").isNotNull(), read))
    return df.drop(*[c for c in df.columns if c in _WORK])


def with_instant(df: DataFrame, read: Column, zone: Column, out: str) -> DataFrame:
    """Add struct ``out`` (utc_us, status) for a ``with_read`` struct and the default ``zone``, an IANA name or null.

    status: ok, unreadable, no_zone, nonexistent, ambiguous; utc_us is null unless ok. The partition id in the last
    step is always true; being non-deterministic, it keeps a later filter from being pushed down through all steps,
    which would copy each step's expression into the next and match every pattern hundreds of times.
    """
    col = F.col
    shows = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), col("_zone")))
    df = df.withColumns({"_read": read, "_zone": zone}).withColumns({"_naive": col("_read.naive_us"), "_offset": col("_read.offset_min")})
    needs_zone = col("_read").isNotNull() & col("_offset").isNull() & col("_read.has_clock") & col("_zone").isNotNull()
    # The earlier instant is given for a repeated time; the same clock then shows again after the change.
    df = df.withColumn("_earlier", F.when(needs_zone, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_naive"), col("_zone")))))
    repeated = reduce(lambda a, b: a | b, [shows(col("_earlier") + m * 60_000_000) == col("_naive") for m in (30, 60, 120)])
    df = df.withColumn(
        "_status",
        F.when(col("_read").isNull(), "unreadable")
        .when(col("_offset").isNotNull() | ~col("_read.has_clock"), "ok")
        .when(col("_zone").isNull(), "no_zone")
        .when(shows(col("_earlier")) != col("_naive"), "nonexistent")
        .when(repeated, "ambiguous")
        .otherwise("ok"),
    )
    us = F.when(col("_offset").isNotNull(), col("_naive") - col("_offset").cast("long") * 60_000_000).when(col("_earlier").isNull(), col("_naive")).otherwise(col("_earlier"))
    result = F.struct(F.when(col("_status") == "ok", us).alias("utc_us"), col("_status").alias("status"))
    df = df.withColumn(out, F.when(F.spark_partition_id() >= 0, result))
    return df.drop("_read", "_zone", "_naive", "_offset", "_earlier", "_status")


_WORK = frozenset(
    "_text _parts _first _order _a _b _c _hour _minute _second _fraction _half _zone_text _year _month _day _has_clock _date_us"
    " _micros _zone_hour _zone_minute _signed _sign _clock_us _offset _epoch _naive".split()
)


def known_zone(zone: Column) -> Column:
    """``zone`` if it is an IANA name, else null; for small lookup tables, so that no row can fail later."""
    names = ", ".join(f"'{z}'" for z in sorted(available_timezones()))
    return F.when(F.array_contains(F.expr(f"array({names})"), zone), zone)
