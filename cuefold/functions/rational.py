"""Frame rates, time bases and aspect ratios as reduced fractions."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Texts that mean an unknown value.
NO_RATE = ("", "0/0", "0", "0.0", "N/A", "unknown", "none")
NO_RATIO = ("", "0:1", "0/1", "0:0", "0/0", "0", "N/A", "unknown", "none")
WHOLE = r"^\s*[+-]?\d{1,18}(?:\.0*)?\s*$"


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps (92 are enough for 64 bits)."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    # The remainder is taken of a non-zero divisor only.
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(
        F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1).cast("bigint")).otherwise(s["b"])).alias("b"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def _reduced(num: Column, den: Column, mark: str) -> Column:
    g = gcd(num, den)
    return F.concat(F.floor(num / g).cast("string"), F.lit(mark), F.floor(den / g).cast("string"))


def _nearest(values: pd.Series, limit: int, mark: str) -> pd.Series:
    def one(text: str) -> str:
        try:
            near = Fraction(text.strip()).limit_denominator(limit)
        except (ValueError, ZeroDivisionError):
            return ""
        return f"{near.numerator}{mark}{near.denominator}" if near > 0 else ""

    table = {v: one(v) for v in values.dropna().unique()}
    return pd.Series([table.get(v) for v in values], dtype=object)


@F.pandas_udf(StringType())
def _near_rate(values: pd.Series) -> pd.Series:
    return _nearest(values, 1001, "/")


@F.pandas_udf(StringType())
def _near_ratio(values: pd.Series) -> pd.Series:
    return _nearest(values, 100, ":")


def _halves(text: Column, mark: str) -> tuple[Column, Column]:
    parts = F.split(text, mark, 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))


def _integer(text: Column) -> Column:
    return F.when(text.rlike(WHOLE), F.regexp_extract(text, r"([+-]?\d+)", 1).try_cast("bigint"))


def frame_rate(raw: Column) -> Column:
    """'num/den' in lowest terms; '' for unknown. Decimals take the nearest fraction up to /1001."""
    s = F.trim(raw)
    num_t, den_t = _halves(s, "/")
    num, den = _integer(num_t), _integer(den_t)
    loose_num, loose_den = num_t.try_cast("double"), den_t.try_cast("double")
    fraction = (
        F.when((num > 0) & (den != 0), _reduced(num * F.signum(den).cast("bigint"), F.abs(den), "/"))
        .when((num.isNull() | den.isNull()) & (loose_num > 0) & (loose_den != 0),
              F.concat(F.bround(loose_num).cast("bigint").cast("string"), F.lit("/"), F.bround(loose_den).cast("bigint").cast("string")))
        .otherwise(F.lit(""))
    )
    plain = _integer(s)
    known = ~F.coalesce(s, F.lit("")).isin(*NO_RATE)
    return (
        F.when(~known, F.lit("")).when(F.contains(s, F.lit("/")), fraction)
        .when(plain > 0, F.concat(plain.cast("string"), F.lit("/1"))).otherwise(_near_rate(F.when(known & plain.isNull(), s)))
    )


def aspect_ratio(raw: Column) -> Column:
    """'num:den' in lowest terms; '' for unknown."""
    s = F.trim(raw)
    num_t, den_t = _halves(F.replace(s, F.lit("/"), F.lit(":")), ":")
    num, den = _integer(num_t), _integer(den_t)
    fraction = F.when((num > 0) & (den > 0), _reduced(num, den, ":")).otherwise(F.lit(""))
    known = ~F.coalesce(s, F.lit("")).isin(*NO_RATIO)
    return (
        F.when(~known, F.lit("")).when(s.rlike("[:/]"), fraction)
        .when(s.try_cast("double") == 1, F.lit("1:1")).otherwise(F.coalesce(_near_ratio(F.when(known & ~s.rlike("[:/]"), s)), F.lit("")))
    )


def time_base(raw: Column) -> Column:
    """'num/den' in lowest terms; other texts stay as they are; '' for unknown."""
    s = F.trim(raw)
    num_t, den_t = _halves(s, "/")
    num, den = _integer(num_t), _integer(den_t)
    fraction = F.when((num > 0) & (den > 0), _reduced(num, den, "/")).when(num.isNull() | den.isNull(), s).otherwise(F.lit(""))
    return F.when(F.coalesce(s, F.lit("")).isin(*NO_RATE), F.lit("")).when(F.contains(s, F.lit("/")), fraction).otherwise(s)
