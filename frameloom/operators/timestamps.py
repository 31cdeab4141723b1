"""Normalisation of timestamps written in mixed formats, precisions and time zones."""

from __future__ import annotations

import math
import zoneinfo
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.text import plain, trim_blank
from frameloom.session import small_side

#: The formats a value may be read in; the place in this list is the bit in a format mask.
FORMATS = ("ymd", "dmy", "mdy", "day_month_name", "month_name_day", "compact", "epoch_s", "epoch_ms", "epoch_us")

# Zone abbreviations with one offset each, in minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "cet": 60, "cest": 120,
}

_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)"
)
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s?([ap])\.?m\.?(?![a-z]))?\s?((?:[^\d:.,\s|][^|]*)?)$"
_SEP = r"(?:,?\s|t)"
_SHAPES = {
    "ymd": r"(?i)^(\d{4})[-:/.](\d{1,2})[-:/.](\d{1,2})" + _SEP + _TIME,
    "numeric": r"(?i)^(\d{1,2})[-:/.](\d{1,2})[-:/.](\d{4})" + _SEP + _TIME,
    "day_month_name": rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[-. ]{{1,2}}{_MONTH}[-., ]{{1,2}}(\d{{4}})" + _SEP + _TIME,
    "month_name_day": rf"(?i)^{_MONTH}[-. ]{{1,2}}(\d{{1,2}})(?:st|nd|rd|th)?,?[- ](\d{{4}})" + _SEP + _TIME,
    "compact": (
        r"(?i)^(\d{4})(\d{2})(\d{2})[t_ -]?(\d{2})(\d{2})(?:(\d{2})(?:[_.,]?(\d{3}|(?<=[_.,])\d{1,9}))?)?"
        r"(?:\s?([ap])\.?m\.?(?![a-z]))?\s?((?:[^\d:.,\s|][^|]*)?)$"
    ),
}
_OFFSET = r"(?i)^(?:utc|gmt)?([+-])(\d{1,2}(?=:|\s?[\[(]|$)|\d{2}):?(\d{2})?(?:\s?[\[(][^\])]*[\])])?$"

#: How much less likely than its share of a source a format is taken to be, where the data's contract says so: dates in
#: digits that don't begin with the year begin with the day.
DAY_FIRST = {"mdy": 1e-18}

#: What each format counts beforehand in a source's mixture, in values: none gets a share of zero.
SMOOTHING = 0.01
_DAY = 86_400_000_000


def _settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which the optimizer doesn't see through: the columns are evaluated
    once each, however often later steps use them."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("r")).select("r.*")


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("bigint")


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar; null where the date does not exist."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    # Years begin in March here, so that the leap day is the last day of a year.
    y = year - F.when(month <= 2, 1).otherwise(0)
    shifted = F.pmod(month + 9, F.lit(12))
    days = y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + F.floor((shifted * 153 + 2) / 5) + day - 719_469
    return F.when((year >= 1) & month.between(1, 12) & (day >= 1) & (day <= length), days)


def _known_zones(spark: SparkSession) -> DataFrame:
    """Zone names by lower case: those of the running JVM, a list bounded by the tz database."""
    try:
        names = list(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # a session without a JVM gateway
        names = sorted(zoneinfo.available_timezones())
    pairs = {n.lower(): n for n in sorted(names) if "/" in n and not n.startswith("SystemV")}
    return spark.createDataFrame(sorted(pairs.items()), "zone_lower string, zone string")


def parse_readings(values: DataFrame, value: str) -> DataFrame:
    """Add ``readings``: each admissible reading of a value as (format, local or absolute microseconds), and
    ``zone_text``: what the value says about its zone (empty: nothing; null: it has no readable time)."""
    t = F.regexp_replace(trim_blank(F.col(f"`{value}`").cast("string")), r"\s+", " ")
    t = F.translate(t, "年月时時", "--::")
    t = F.regexp_replace(F.regexp_replace(t, r"日\s?", " "), r"(\d):(\d{1,2})分(\d{1,2})秒?", "$1:$2:$3")
    t = F.regexp_replace(t, r"(\d:\d{2})分|(\d)秒", "$1$2")
    t = F.regexp_replace(t, r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s", "")
    led = F.regexp_replace(t, r"(?i)^(?:utc|gmt)\s(?=\d)(.*)$", "$1 UTC")
    fields = F.lit(None).cast("string")
    for shape, pattern in reversed(_SHAPES.items()):
        layout = "|".join([shape, "$1", "$2", "$3", "$4", "$5", "$6", "$7", "$8", "$9"])
        fields = F.when(F.col("t").rlike(pattern), F.regexp_replace(F.col("t"), pattern, layout)).otherwise(fields)
    counts = F.when(F.col("t").rlike(r"^(\d{10}|\d{13}|\d{16})$"), F.col("t"))
    split = _settled(values.withColumn("t", led))
    split = _settled(split.withColumn("n", counts).withColumn("f", F.split(F.when(F.col("n").isNull(), fields), r"\|")))

    # Each step is a column of its own, so that what several later ones use is evaluated once.
    part = {name: F.col("f")[i] for i, name in enumerate(("shape", "p1", "p2", "p3", "h", "mi", "se", "fr", "half", "rest"))}
    split = _settled(split.withColumns({f"f_{name}": column for name, column in part.items()}))
    months = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")
    month_of = lambda c: F.ceil(F.call_function("instr", months, F.substring(F.lower(c), 1, 3)) / 3)
    shape, hour, half = F.col("f_shape"), F.col("f_hour"), F.lower("f_half")
    split = split.withColumns(
        {
            "f_hour": _number(F.col("f_h")),
            "f_minute": _number(F.col("f_mi")),
            "f_second": F.coalesce(_number(F.col("f_se")), F.lit(0)),
            "f_year": _number(F.when(shape.isin("ymd", "compact"), F.col("f_p1")).otherwise(F.col("f_p3"))),
            "f_month": F.when(shape == "day_month_name", month_of(F.col("f_p2")))
            .when(shape == "month_name_day", month_of(F.col("f_p1")))
            .otherwise(_number(F.when(shape.isin("ymd", "compact", "numeric"), F.col("f_p2")))),
            "f_day": _number(
                F.when(shape.isin("ymd", "compact"), F.col("f_p3"))
                .when(shape == "month_name_day", F.col("f_p2"))
                .otherwise(F.col("f_p1"))
            ),
        }
    )
    split = _settled(split)
    hour = F.when(half == "", F.when(hour <= 23, hour)).when(
        hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)
    )
    clock = F.when(
        (F.col("f_minute") < 60) & (F.col("f_second") < 60),
        (hour * 3600 + F.col("f_minute") * 60 + F.col("f_second")) * 1_000_000
        + F.rpad(F.substring("f_fr", 1, 6), 6, "0").cast("bigint"),
    )
    year, month, day = F.col("f_year"), F.col("f_month"), F.col("f_day")
    split = split.withColumns(
        {
            "f_clock": clock,
            "f_date": _days(year, month, day) * _DAY,
            "f_turned": F.when(shape == "numeric", _days(year, day, month) * _DAY),
        }
    )
    reading = lambda name, us: F.when(us.isNotNull(), F.struct(name.alias("format"), us.alias("us")))
    count, digits = F.col("n").cast("bigint"), F.length("n")
    readings = F.array_compact(
        F.array(
            reading(
                F.when(digits == 10, "epoch_s").when(digits == 13, "epoch_ms").otherwise("epoch_us"),
                count * F.when(digits == 10, 1_000_000).when(digits == 13, 1000).otherwise(1),
            ),
            reading(
                F.when(shape == "numeric", "dmy").otherwise(shape), F.col("f_date") + F.col("f_clock")
            ),
            reading(F.lit("mdy"), F.col("f_turned") + F.col("f_clock")),
        )
    )
    zone = F.when(F.col("n").isNotNull(), F.lit("UTC")).otherwise(F.trim("f_rest"))
    return _settled(
        split.withColumn("readings", readings).withColumn("zone_text", zone).select(*values.columns, "readings", "zone_text")
    )


def mixture_posteriors(masks: DataFrame, priors: Mapping[str, float] | None = None, tolerance: float = 1e-9, rounds: int = 500) -> DataFrame:
    """Expectation-maximisation over the format mixture of each source.

    ``masks`` has one row per (source, mask of valid formats) with ``n`` values: the sufficient statistic, whose
    size follows the number of sources and not that of values. A value contributes likelihood under each of its
    valid readings; the posteriors of the formats in a mask are the mixture weights times the priors (1 where none is
    given), restricted to it.
    Result: source, mask, format (the best), posterior (its probability).
    """

    prior = [float((priors or {}).get(f, 1.0)) for f in FORMATS]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [[f for f in range(len(FORMATS)) if m >> f & 1] for m in rows["mask"]]
        n = rows["n"].to_numpy(float)
        weights = [1.0 / len(FORMATS)] * len(FORMATS)
        for _ in range(rounds):
            mass = [SMOOTHING] * len(FORMATS)
            for formats, k in zip(sets, n, strict=True):
                total = sum(weights[f] * prior[f] for f in formats)
                for f in formats:
                    mass[f] += k * (weights[f] * prior[f] / total if total > 0 else 1 / len(formats))
            new = [m / sum(mass) for m in mass]
            done = max(abs(a - b) for a, b in zip(new, weights, strict=True)) < tolerance
            weights = new
            if done:
                break
        best, sure = [], []
        for formats in sets:
            total = math.fsum(weights[f] * prior[f] for f in formats)
            top = max(formats, key=lambda f: (weights[f] * prior[f], -f))
            best.append(FORMATS[top])
            sure.append(weights[top] * prior[top] / total if total > 0 else 1 / len(formats))
        return pd.DataFrame({"source": rows["source"], "mask": rows["mask"], "format": best, "posterior": sure})

    return masks.groupBy("source").applyInPandas(fit, "source string, mask bigint, format string, posterior double")


def normalise_timestamps(
    values: DataFrame,
    key: str,
    value: str,
    source: str,
    default_zone: str,
    utc_sources: Sequence[str] = ("embedded",),
    priors: Mapping[str, float] | None = None,
    certainty: float = 0.95,
) -> DataFrame:
    """One UTC instant per value, read in the format that its source most probably writes.

    Method: expectation-maximisation over the mixture of formats per source (``source``, in plain form). Each
    value counts for every reading that gives an existing date and time; the posterior of the fitted mixture
    chooses among them. ``priors`` make formats less likely than their share of the source says (see ``DAY_FIRST``).
    Digits alone are a count since 1970-01-01 UTC if they are 10 (seconds), 13 (milliseconds) or 16 (microseconds).

    Zone: an offset, zone name or abbreviation in the value decides; otherwise UTC if the source is one of
    ``utc_sources``, else the zone named in the column ``default_zone``, else UTC. A local time that occurs twice has
    two readings of the zone, each as likely as the other. A skipped one is read with the offset valid before the change.

    The posterior of a value is that of its best format over its readings of the zone. Where it stays under
    ``certainty`` the value is ``ambiguous``: by its ``format``, when it gets no instant, or by its ``zone``, when the
    instant is the earlier one, as declared, and ``other_us`` the later one.

    Result: key, utc_us (microseconds, finer digits cut off), other_us, format, posterior, status: ``resolved``,
    ``ambiguous`` or ``unreadable`` (null, blank, no date, no such date, no minute, unknown zone; without a format), and
    ambiguity (``format`` or ``zone``); one row per row of ``values``, repeated rows included; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = values.sparkSession
    rows = values.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{value}`").cast("string").alias("value"),
        F.coalesce(plain(F.col(f"`{source}`").cast("string")), F.lit("")).alias("source"),
        trim_blank(F.col(f"`{default_zone}`").cast("string")).alias("site"),
    )
    read = parse_readings(rows, "value")
    bits = F.create_map(*[x for i, f in enumerate(FORMATS) for x in (F.lit(f), F.lit(1 << i))])
    read = read.withColumn(
        "zone_lower", F.lower(F.regexp_replace("zone_text", r"^[\[(]|[\])]$", ""))
    ).withColumn(
        "mask", F.coalesce(F.aggregate("readings", F.lit(0), lambda m, r: m + bits[r["format"]]), F.lit(0)).cast("bigint")
    )
    read = _settled(read)
    chosen = small_side(mixture_posteriors(read.where("mask > 0").groupBy("source", "mask").agg(F.count("*").alias("n")), priors))

    zones = _known_zones(spark)
    site_zones = zones.select(F.col("zone_lower").alias("site_lower"), F.col("zone").alias("site_zone"))
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    group = lambda i: F.regexp_extract("zone_lower", _OFFSET, i)
    minutes = _number(group(2)) * 60 + F.coalesce(_number(group(3)), F.lit(0))
    offset = F.when(
        F.col("zone_lower").rlike(_OFFSET), F.when(minutes <= 18 * 60, F.when(group(1) == "-", -minutes).otherwise(minutes))
    ).otherwise(F.try_element_at(known, F.col("zone_lower")))
    chosen_reading = F.filter("readings", lambda r: r["format"] == F.col("format"))
    joined = (
        read.join(chosen, ["source", "mask"], "left")
        .withColumn("offset", offset)
        .join(F.broadcast(zones), "zone_lower", "left")
        .withColumn("site_lower", F.lower("site"))
        .join(F.broadcast(site_zones), "site_lower", "left")
        .withColumn("local", F.try_element_at(chosen_reading, F.lit(1))["us"])
        .withColumn(
            "in_zone",
            F.when(F.col("zone").isNotNull(), F.col("zone")).when(
                (F.col("zone_text") == "") & ~F.col("source").isin(list(utc_sources)), F.coalesce("site_zone", F.lit("UTC"))
            ),
        )
    )
    local = F.col("local")
    to_utc = lambda us: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), F.col("in_zone")))
    from_utc = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), F.col("in_zone")))
    by_zone = F.col("offset").isNull() & F.col("in_zone").isNotNull()
    instant = (
        F.when(F.col("offset").isNotNull(), local - F.col("offset") * 60_000_000)
        .when(F.col("in_zone").isNotNull(), to_utc(local))
        .when(F.col("zone_text") == "", local)
    )
    joined = _settled(joined.withColumn("instant", instant))
    instant = F.col("instant")
    # With the offset that is valid a day later, a local time that occurs twice gives its second instant.
    later = _settled(joined.withColumn("later", F.when(by_zone, local - (from_utc(instant + _DAY) - (instant + _DAY)))))
    twice = (F.col("later") > instant) & (from_utc(F.col("later")) == local)
    judged = _settled(later.withColumn("other", F.when(twice, F.col("later"))))
    read_at_all = F.col("posterior").isNotNull() & instant.isNotNull()
    sure, one = F.col("posterior") >= certainty, F.col("other").isNull()
    posterior = F.col("posterior") / F.when(one, 1).otherwise(2)
    return judged.select(
        F.col("key").alias(key),
        F.when(sure, instant).alias("utc_us"),
        F.when(sure, F.col("other")).alias("other_us"),
        F.when(read_at_all, F.col("format")).alias("format"),
        F.when(read_at_all, posterior).alias("posterior"),
        F.when(~read_at_all, "unreadable").when(posterior >= certainty, "resolved").otherwise("ambiguous").alias("status"),
        F.when(read_at_all & ~sure, "format").when(read_at_all & (posterior < certainty), "zone").alias("ambiguity"),
    )
