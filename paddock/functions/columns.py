"""Column-expression helpers (JVM-side built-ins only, no Python UDFs).

Every helper returns a ``pyspark.sql.Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- division


def ieee_div(a: str | Column, b: str | Column) -> Column:
    """IEEE-754 float division that never raises under ANSI mode.

    x/0 is +inf or -inf by the sign of x, 0/0 is NaN, and a null operand gives null.
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(b == 0, F.when(a.isNaN() | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))
        .otherwise(a / b)
    )


def nan_to_null(c: str | Column) -> Column:
    """Map NaN and +/-inf to null (for result projections compared across engines)."""
    c = col(c)
    return F.when(c.isNaN() | (F.abs(c) == F.lit(INF)), F.lit(None).cast("double")).otherwise(c)


def r6(c: str | Column) -> Column:
    """Result-projection rounding: non-finite to null, then 9 decimal places (absorbs
    float summation noise) and 6 places, half-even, in plain IEEE arithmetic -- the
    same operations in any engine give the same double."""
    x = nan_to_null(col(c).cast("double"))
    return F.rint(F.rint(x * 1e9) / 1e3) / 1e6


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def logit_clipped(p: str | Column, eps: float = 1e-4) -> Column:
    """logit of a probability clipped to [eps, 1 - eps]."""
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def int8_flag(cond: Column) -> Column:
    """Boolean to 0/1 integer; a null condition stays null."""
    return cond.cast("int")


# --------------------------------------------------------------------------- ranks


def rank_min(value: str | Column, partition: str | list[str]) -> Column:
    """Rank with ties sharing the lowest rank; null in gives null out."""
    v = col(value)
    w = Window.partitionBy(*([partition] if isinstance(partition, str) else partition)).orderBy(v.asc_nulls_last())
    return F.when(v.isNotNull(), F.rank().over(w).cast("bigint"))


# --------------------------------------------------------------------------- ids and text


def make_race_id(race_date: str | Column, track: str | Column, race_number: str | Column) -> Column:
    """``{date}_{track}_R{n}``; a missing part becomes empty text."""
    return F.concat(
        F.coalesce(col(race_date).cast("string"), F.lit("")),
        F.lit("_"),
        F.coalesce(col(track).cast("string"), F.lit("")),
        F.lit("_R"),
        F.coalesce(col(race_number).cast("string"), F.lit("")),
    )


def blank_to_null(c: str | Column) -> Column:
    """trimmed text, or null when empty."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def safe_int(c: str | Column) -> Column:
    """integer text only ("1.0" is not an integer); blank or bad text is null."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def safe_float(c: str | Column) -> Column:
    """float text; blank or bad text is null."""
    return blank_to_null(c).try_cast("double")


def iso_date(c: str | Column) -> Column:
    """ISO date text, also with a time part (``T``) or a ``+00:00`` suffix."""
    t = F.substring_index(F.substring_index(F.trim(col(c)), "+", 1), "T", 1)
    return F.try_to_date(t, "yyyy-MM-dd")


def yyyymmdd_date(c: str | Column) -> Column:
    """strict YYYYMMDD text to date."""
    t = F.trim(col(c))
    return F.when((F.length(t) == 8) & t.rlike("^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd"))


def csv_int(c: str | Column) -> Column:
    """F8: integer through float, truncating toward zero ("3.7" -> 3)."""
    d = safe_float(c)
    return F.when(d.isNotNull() & ~d.isNaN() & (F.abs(d) != F.lit(INF)), d.cast("bigint"))


def csv_abs_int(c: str | Column) -> Column:
    return F.abs(csv_int(c))


# --------------------------------------------------------------------------- odds and distance


def parse_odds(c: str | Column) -> Column:
    """odds text to dollars-to-one.

    ``a/b`` is a fraction; a plain whole number above 99 is coded in hundredths;
    non-positive, blank and unparseable values are null (a zero denominator too).
    """
    t = F.trim(col(c))
    has_slash = F.instr(t, "/") > 0
    num = safe_float(F.substring_index(t, "/", 1))
    den = safe_float(F.substr(t, F.instr(t, "/") + 1))
    frac = F.when(den.isNotNull() & (den != 0), num / den)
    plain = safe_float(t)
    plain = F.when((plain == F.floor(plain)) & (plain > 99), plain / 100).otherwise(plain)
    val = F.when(t.isNull() | (t == ""), F.lit(None).cast("double")).when(has_slash, frac).otherwise(plain)
    return F.when(val > 0, val)


def parse_fractional_odds(c: str | Column) -> Column:
    """``5/2`` -> 2.5, ``9-5`` -> 1.8, EVEN/EV/EVS -> 1.0; bad text, zero denominator -> null."""
    s = F.upper(F.trim(col(c).cast("string")))
    m = F.regexp_extract(s, r"^([^/-]*)[/-](.*)$", 0)
    num = F.regexp_extract(s, r"^([^/-]*)[/-](.*)$", 1).try_cast("double")
    den = F.regexp_extract(s, r"^([^/-]*)[/-](.*)$", 2).try_cast("double")
    return (
        F.when(s.isNull() | (s == ""), F.lit(None).cast("double"))
        .when(s.isin("EVEN", "EV", "EVS"), F.lit(1.0))
        .when((m != "") & num.isNotNull() & den.isNotNull() & (den != 0), num / den)
    )


def parse_program_number(c: str | Column) -> Column:
    """F16: leading digits of a program number ("1A" -> 1)."""
    digits = F.regexp_extract(col(c).cast("string"), r"^\s*(\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def live_odds_choice(raw_number: Column, raw_text: Column, trend_numeric: Column) -> Column:
    """positive number, else parsed fraction text, else positive trend value."""
    return F.coalesce(
        F.when(raw_number > 0, raw_number.cast("double")),
        parse_fractional_odds(raw_text),
        F.when(trend_numeric > 0, trend_numeric.cast("double")),
    )


# Fixed value: track codes that the odds feed spells its own way.
FEED_TRACK_CODES = {"CD": "cd"}


def feed_track_code(track: str | Column) -> Column:
    """the odds feed's code of a track, else the code in lower case."""
    t = col(track)
    known = F.lit(None).cast("string")
    for ours, theirs in FEED_TRACK_CODES.items():
        known = F.when(F.upper(t) == ours, theirs).otherwise(known)
    return F.coalesce(known, F.lower(t))


# Distance unit conversion factors.
FURLONG_YARDS = 220
METER_YARDS = 1.09361


def to_yards(value: str | Column, unit: str | Column) -> Column:
    """F = hundredths of a furlong, Y = yards, M = metres; half-even rounding."""
    v, u = col(value).cast("double"), col(unit)
    return (
        F.when(v.isNull() | u.isNull(), F.lit(None).cast("bigint"))
        .when(u == "F", F.bround(v / 100 * FURLONG_YARDS, 0).cast("bigint"))
        .when(u == "Y", v.cast("bigint"))
        .when(u == "M", F.bround(v * METER_YARDS, 0).cast("bigint"))
    )


def sub_nonneg(a: str | Column, *bs: str | Column) -> Column:
    """``a - sum(b)`` floored at 0; null a gives null, null b counts as 0."""
    a = col(a)
    total = a
    for b in bs:
        total = total - F.coalesce(col(b), F.lit(0))
    return F.when(a.isNotNull(), F.greatest(total, F.lit(0)))


def row_mean(*cols: str | Column) -> Column:
    """Mean of the non-null values of several columns (null when all are null)."""
    arr = F.filter(F.array(*[col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr))


def row_max(*cols: str | Column) -> Column:
    """Greatest non-null value."""
    return F.greatest(*[col(c) for c in cols])
