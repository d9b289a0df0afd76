"""Elapsed-time and number formatting (T10-T12) as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, _c


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def format_elapsed(seconds: ColumnLike) -> Column:
    """Seconds -> ``h:mm:ss`` rounded half-to-even to the whole second.

    Hours are not padded; a day or more prints ``N day(s), h:mm:ss`` like
    Python's ``timedelta``.
    """
    s = F.bround(_c(seconds).cast("double"), 0).cast("long")
    days = _div(s, 86400)
    rem = s - days * 86400
    hms = F.format_string("%d:%02d:%02d", _div(rem, 3600), _div(rem % 3600, 60), rem % 60)
    prefix = F.concat(days.cast("string"), F.when(days == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))
    return F.when(days == 0, hms).otherwise(F.concat(prefix, hms))


def split_minutes_seconds(seconds: ColumnLike) -> tuple[Column, Column]:
    """Elapsed seconds -> (whole minutes, whole seconds), both truncated."""
    e = _c(seconds).cast("double")
    minutes = (e / 60).cast("int")
    secs = (e - minutes * 60).cast("int")
    return minutes, secs


def format_count(n: ColumnLike) -> Column:
    """Integer with thousands separators (``1,234``)."""
    return F.format_number(_c(n).cast("long"), 0)


def format_percent(num: ColumnLike, den: ColumnLike | None = None, decimals: int = 2) -> Column:
    """``100*num/den`` as text with ``decimals`` places and a ``%`` sign.

    Computed on integers (half-up on the exact ratio) so the text does not
    depend on binary rounding of a double. A zero denominator gives NULL.
    Without ``den``, ``num`` is a rate and ``100 * num`` is formatted as a double.
    """
    if den is None:
        return F.concat(format_decimal(_c(num).cast("double") * 100, decimals), F.lit("%"))
    scale = 10 ** decimals
    n = _c(num).cast("long")
    d = _c(den).cast("long")
    units = F.when(d != 0, F.floor((n * (200 * scale) + d) / (2 * d)).cast("long"))
    whole = _div(units, scale).cast("string")
    if decimals == 0:
        return F.concat(whole, F.lit("%"))
    frac = F.lpad((units % scale).cast("string"), decimals, "0")
    return F.concat(whole, F.lit("."), frac, F.lit("%"))


def format_decimal(x: ColumnLike, places: int = 3) -> Column:
    """A double as text with ``places`` decimals, as Python's ``f"{x:.3f}"``:
    the double's exact value is rounded once, an exact half to the even digit.

    ``|x| * 10^places`` and the error of that product (both halves of each
    factor multiplied apart) give the exact distance to the half.
    """
    x = _c(x).cast("double")
    a, scale = F.abs(x), float(10 ** places)

    def halves(v):
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (ah, al), (sh, sl) = halves(a), halves(F.lit(scale))
    p = a * scale
    error = ((ah * sh - p) + ah * sl + al * sh) + al * sl
    k = F.floor(p)
    beyond = (p - k - 0.5) + error
    units = F.when((beyond > 0) | ((beyond == 0) & (k % 2 == 1)), k + 1).otherwise(k).cast("long")
    whole = F.floor(units / F.lit(10 ** places)).cast("long") if places else units
    text = whole.cast("string")
    if places:
        text = F.concat(text, F.lit("."), F.lpad((units % 10 ** places).cast("string"), places, "0"))
    large = F.abs(x).cast(f"decimal(38,{places})").cast("string")  # beyond 2^53 units a double has no fraction
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.when(p < 2.0 ** 53, text).otherwise(large))
