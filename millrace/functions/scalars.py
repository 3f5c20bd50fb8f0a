"""Scalar functions Spark has no single built-in for. All are expressions over Columns, so they
stay inside generated code; everything else in the function matrix is a ``pyspark.sql.functions``
call of the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ------------------------------------------------------------------ numbers


def trunc_number(x, places: int = 0) -> Column:
    """Toward zero."""
    c, scale = _c(x), F.lit(10.0 ** places)
    return F.signum(c) * F.floor(F.abs(c) * scale) / scale


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def integer_div(a, b) -> Column:
    return F.try_divide((_c(a) - F.try_mod(_c(a), _c(b))), _c(b)).cast("bigint")


def log_base(x, base: float) -> Column:
    return F.log(float(base), _c(x))


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    return F.floor(F.rand(seed) * (high - low + 1) + low).cast("int")


def hex_to_int(x) -> Column:
    return F.conv(_c(x), 16, 10).cast("bigint")


# ------------------------------------------------------------------ text


def nth_position(x, needle: str, n: int) -> Column:
    """1-based position of the n-th occurrence, 0 when there are fewer."""
    c = _c(x)
    hits = F.size(F.split(c, "\\Q" + needle + "\\E", -1)) - 1
    return F.when(hits >= n, F.length(F.substring_index(c, needle, n)) + 1).otherwise(F.when(c.isNotNull(), 0))


def soundex_difference(a, b) -> Column:
    """0 … 4: how many places of the two Soundex codes agree."""
    x, y = F.soundex(_c(a)), F.soundex(_c(b))
    return sum(((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5)), F.lit(0))


def remove_spaces(x) -> Column:
    return F.regexp_replace(_c(x), r"\s+", "")


def remove_special(x, keep: str = "") -> Column:
    return F.regexp_replace(_c(x), rf"[^\p{{L}}\p{{N}}\s{keep}]", "")


# Accented letters and their base letters (fixed values).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def remove_diacritics(x) -> Column:
    return F.translate(_c(x), ACCENTED, PLAIN)


def to_snake_case(x) -> Column:
    words = F.regexp_replace(_c(x), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.trim(words), r"[\s\-]+", "_"))


def to_camel_case(x) -> Column:
    joined = F.regexp_replace(F.initcap(F.regexp_replace(_c(x), r"[_\s\-]+", " ")), " ", "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))


# ------------------------------------------------------------------ dates


def iso_year(x) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(x))


def is_weekend(x) -> Column:
    return F.weekday(_c(x)) >= 5


def is_business_day(x) -> Column:
    return F.weekday(_c(x)) < 5


def fiscal_year(x, first_month: int = 4) -> Column:
    """The calendar year in which the fiscal year ends."""
    c = _c(x)
    later = F.lit(0) if first_month == 1 else F.when(F.month(c) >= first_month, 1).otherwise(0)
    return F.year(c) + later


def add_business_days(x, days: int) -> Column:
    """Shift by working days (Monday to Friday), ``days`` >= 0. A weekend start counts from the
    Friday before it. Closed form: no calendar table and no loop."""
    start = _c(x).cast("date")
    weekday = F.weekday(start)
    base = F.date_sub(start, F.greatest(weekday - 4, F.lit(0)))
    position = F.least(weekday, F.lit(4)) + days
    return F.date_add(base, (F.lit(days) + F.floor(position / 5) * 2).cast("int"))


def business_days_between(a, b) -> Column:
    """Working days in [a, b)."""
    def since(d):
        # Days counted from a Monday (1970-01-05).
        n = F.datediff(d.cast("date"), F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    return since(_c(b)) - since(_c(a))


def round_time(x, seconds: int) -> Column:
    """Nearest multiple of ``seconds`` since the epoch."""
    epoch = F.unix_micros(_c(x).cast("timestamp"))
    step = seconds * 1_000_000
    return F.timestamp_micros((F.floor((epoch + step // 2) / F.lit(step)) * step).cast("bigint"))


def age_parts(since, until) -> Column:
    """Struct of whole years, months and days between two dates."""
    a, b = _c(since).cast("date"), _c(until).cast("date")
    months = F.floor(F.months_between(b, a)).cast("int")
    days = F.datediff(b, F.add_months(a, months))
    return F.struct(F.floor(months / 12).cast("int").alias("years"), (months % 12).alias("months"), days.alias("days"))


def interval_seconds(x) -> Column:
    """Seconds in a day-time interval."""
    c = _c(x)
    parts = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60}
    return sum((F.extract(F.lit(p), c) * n for p, n in parts.items()), F.extract(F.lit("SECOND"), c))


# ------------------------------------------------------------------ branches


def decode(x, pairs: dict, default=None) -> Column:
    out = None
    for k, v in pairs.items():
        test = _c(x).eqNullSafe(F.lit(k))
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    return out.otherwise(F.lit(default))


def choose(index, *values) -> Column:
    """The index-th value; NULL when out of range."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), _c(index).cast("int"))
