"""Numbers as the sales data writes them, and the roundings and quantiles that facts need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Trimmed text, never null."""
    return F.trim(F.coalesce(text.cast("string"), F.lit("")))


def number(text: Column) -> Column:
    """A decimal comma or point to double; empty, malformed and non-finite values to null."""
    value = F.expr("1").cast("double") * F.nullif(F.regexp_replace(clean(text), ",", "."), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def or_missing(text: Column) -> Column:
    """'0' stands for a missing id."""
    return F.when(clean(text) == "0", "").otherwise(clean(text))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(clean(t), F.lit("")) for t in texts], F.lit(""))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 1/2) / 10^d: halves go up, negative ones too."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def round_money(x: Column, digits: int = 2) -> Column:
    """Halves up also where the double that stands for one lies just below it."""
    return F.round(x + 1e-9, digits)


def round_bankers(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.when(b != 0, a / b)


def quantiles(x: Column, *qs: float) -> Column:
    """Exact interpolated quantiles as an array."""
    return F.percentile(x, F.array(*[F.lit(q) for q in qs]))


def nth_quantile(values: Column, q: float) -> Column:
    """Element floor(n q) of the sorted values: a quantile without interpolation."""
    s = F.sort_array(values)
    return F.when(F.size(s) > 0, F.get(s, F.least(F.floor(F.size(s) * q), F.size(s) - 1).cast("int")))


def harmonic_mean(values: Column) -> Column:
    """0 where any value is zero, negative or missing, or none is there."""
    bad = F.exists(values, lambda x: x.isNull() | (x <= 0))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.lit(1.0) / x)
    return F.when(values.isNull() | (F.size(values) == 0) | bad, 0.0).otherwise(F.size(values) / total)


def thousands(x: Column) -> Column:
    """12345.6 as '12 346'."""
    return F.regexp_replace(F.format_number(x, 0), ",", " ")


def money_bucket(x: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the half-open range that x lies in; one name more than bounds."""
    out = F.when(x < bounds[0], names[0])
    for b, n in zip(bounds[1:], names[1:-1], strict=True):
        out = out.when(x < b, n)
    return out.when(x.isNotNull(), names[-1])
