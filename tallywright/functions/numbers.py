"""Rounding, guarded ratios and order-independent sums.

The formulas are SQL text over named columns: one expression each to build and to parse, and a
value they use often is computed once, in the projection below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 134217729 = 2**27 + 1 splits a double into two halves whose products with 100 are exact. From
# 9e13 on doubles are spaced wider than a cent, so there is nothing to round.
_HIGH = "({x} * 134217729D - ({x} * 134217729D - {x}))"
_CENTS = "({x} * 100D)"
_ERROR = f"(({_HIGH} * 100D - {_CENTS}) + ({{x}} - {_HIGH}) * 100D)"
_WHOLE = f"CAST(floor({_CENTS}) AS DOUBLE)"
_OVER = f"({_CENTS} - {_WHOLE} - 0.5D)"
_UP = (
    f"{_OVER} > 0 OR ({_OVER} = 0 AND ({_ERROR} > 0 OR"
    f" ({_ERROR} = 0 AND pmod({_WHOLE}, 2D) = 1)))"
)
_ROUND2 = (
    f"CASE WHEN abs({{x}}) >= 9e13D THEN {{x}}"
    f" ELSE ({_WHOLE} + CASE WHEN {_UP} THEN 1D ELSE 0D END) / 100D END"
)


def round2(name: str) -> Column:
    """A double column rounded to two places as Python's ``round(x, 2)`` does.

    Python rounds the exact binary value. ``x * 100`` alone loses the last bits, so its rounding
    error is computed as well and settles the cases that land on a half; a true half goes to the
    even neighbour. All steps are plain IEEE arithmetic and stay in generated code.
    """
    return F.expr(_ROUND2.format(x=f"`{name}`"))


def ratio(top: str, bottom: str, times: int = 1) -> str:
    """``top / bottom``, null unless ``bottom`` is positive; not rounded yet."""
    scaled = f" * {times}D" if times != 1 else ""
    return f"CASE WHEN {bottom} > 0 THEN {top} / {bottom}{scaled} END"


def finite(x: Column) -> Column:
    """NaN and the infinities become null, as a report cannot carry them."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


# Exact sums ---------------------------------------------------------------------------------
# A double is cut into multiples of 2**21, millionths, and what is left. Each of the first two is
# cut into runs of 21 bits and every run is summed as a BIGINT, which cannot overflow below 2**42
# rows per group and does not depend on the order of the rows. What is left, at most half a
# millionth a row, and values from 2**83 (about 9.7e24) on are summed as doubles beside them; for
# smaller values with up to six decimals that is exactly zero.
_BLOCKS = (
    "CASE WHEN abs({x}) < 4e12D OR abs({x}) >= 9671406556917033397649408D THEN 0L"
    " ELSE CAST(floor({x} / 2097152D) AS BIGINT) END"
)
_UNITS = (
    "CASE WHEN abs({x}) < 9671406556917033397649408D"
    " THEN CAST(rint(({x} - {x}__blocks * 2097152D) * 1000000D) AS BIGINT) ELSE 0L END"
)
_REST = "{x} - {x}__blocks * 2097152D - {x}__units / 1000000D"
_PARTS = {
    "top": "sum(shiftright({x}__blocks, 42))",
    "middle": "sum(shiftright({x}__blocks, 21) & 2097151L)",
    "bottom": "sum({x}__blocks & 2097151L)",
    "high": "sum(shiftright({x}__units, 42))",
    "mid": "sum(shiftright({x}__units, 21) & 2097151L)",
    "low": "sum({x}__units & 2097151L)",
    "rest": "sum({x}__rest)",
}
# Within 2**53 units one division gives the nearest double; beyond it decimals do.
_TOTAL = """coalesce(
    CASE WHEN abs({x}__high) < 1024 AND abs({x}__mid) < 2147483648L AND {x}__low < 4503599627370496L
    THEN CAST({x}__high * 4398046511104L + {x}__mid * 2097152L + {x}__low AS DOUBLE) / 1000000D
    ELSE CAST(CAST(CAST({x}__high AS DECIMAL(20,0)) * 4398046511104BD
        + CAST({x}__mid AS DECIMAL(20,0)) * 2097152BD + {x}__low AS DECIMAL(38,0)) * 0.000001BD
        AS DOUBLE)
    END + {x}__rest, 0D)"""
_LARGE = """CAST(CAST({x}__top AS DECIMAL(20,0)) * 4398046511104BD
    + CAST({x}__middle AS DECIMAL(20,0)) * 2097152BD + {x}__bottom AS DOUBLE) * 2097152D"""
_SUM = (
    "CASE WHEN {x}__top = 0 AND {x}__middle = 0 AND {x}__bottom = 0 THEN " + _TOTAL
    + " ELSE coalesce(" + _LARGE + ", 0D) + " + _TOTAL + " END"
)


def split_amounts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace double columns by what :func:`sum_parts` adds up. Do this below an ``Expand``."""
    kept = [F.col(c) for c in df.columns if c not in names]
    for step, text in (("blocks", _BLOCKS), ("units", _UNITS)):
        df = df.select("*", *[F.expr(text.format(x=n)).alias(f"{n}__{step}") for n in names])
    return df.select(
        *kept,
        *[f"{n}__blocks" for n in names],
        *[f"{n}__units" for n in names],
        *[F.expr(_REST.format(x=n)).alias(f"{n}__rest") for n in names],
    )


def sum_parts(name: str) -> list[Column]:
    """Aggregates whose total, by :func:`sum_total`, is the sum of a split column."""
    return [F.expr(text.format(x=name)).alias(f"{name}__{part}") for part, text in _PARTS.items()]


def sum_total(name: str) -> Column:
    """The sum of a split column as a double; 0.0 when there was nothing to sum, and null when it is
    beyond the largest double."""
    return finite(F.expr(_SUM.format(x=name))).alias(name)
