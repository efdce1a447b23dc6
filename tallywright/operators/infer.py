"""Types of text columns, inferred from all their cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright import schema
from tallywright.functions.numbers import finite
from tallywright.operators.coerce import (
    ISO_DATE, NUMBER, as_moment, as_number, parsed_number, without_na,
)

# What a cell can be, a bit each; a column's cells together are the OR of their bits.
INT, FLOAT, BOOL, DATE, TEXT = 1, 2, 4, 8, 16

#: A number without an exponent; without a point it is a whole number. What matched is not tried anew.
PLAIN = r"^\s*+[+-]?+(?:\d++\.?+\d*+|\.\d++)\s*+$"
#: What may stand around a number, line ends before the end of a text included.
BLANK = " \t\n\x0b\f\r\x85\u2028\u2029"
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def cell_facts(cells: DataFrame, cell: str) -> DataFrame:
    """``_kind``, the bit of a text cell, null for no cell, and ``_before`` and ``_after``, the digits
    before and after the point of a plain number, beside the other columns.

    Whole numbers beyond 64 bits are floats; numbers beyond the largest double are text. A date is
    ISO text that names a real day. What is used more than once has a projection of its own.
    """
    c, digits, point = F.col(cell), F.col("_digits"), F.col("_point")
    others = [n for n in cells.columns if n != cell]
    # White space, signs, points and digits come before the colon, an exponent needs its letter:
    # cells of other kinds are spared the patterns.
    early, plain = c < ":", F.col("_plain")
    exponent = early & (c.contains("e") | c.contains("E")) & c.rlike(NUMBER)
    # A cast that fails costs far more than the rest, so what is too long for 64 bits is not tried.
    largest = F.when(c.contains("-"), "9223372036854775808").otherwise("9223372036854775807")
    fits = (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= largest))
    bare = F.rtrim(F.ltrim(c, F.lit(BLANK + "+-0")), F.lit(BLANK))
    whole = plain & (point == 0) & fits & c.try_cast("bigint").isNotNull()
    found = cells.select("*", (early & c.rlike(PLAIN)).alias("_plain"))
    found = found.select("*", F.when(plain, bare).alias("_digits"))
    found = found.select("*", F.instr(digits, ".").alias("_point"))
    found = found.select("*", F.coalesce(whole, F.lit(False)).alias("_whole"))
    number = F.when(~F.col("_whole") & (plain | exponent), c.try_cast("double"))
    found = found.select("*", number.alias("_number"))
    return found.select(
        *others,
        F.when(F.col("_whole"), INT)
        .when(finite(F.col("_number")).isNotNull(), FLOAT)
        .when(c.isin(*TRUE, *FALSE), BOOL)
        .when(early & c.rlike(ISO_DATE) & c.try_cast("timestamp_ntz").isNotNull(), DATE)
        .when(c.isNotNull(), TEXT)
        .cast("int")
        .alias("_kind"),
        F.when(point > 0, point - 1).otherwise(F.length(digits)).alias("_before"),
        F.when(point > 0, F.length(digits) - point).when(point == 0, 0).alias("_after"),
    )


def type_of(kinds: Column) -> Column:
    """The type that holds all cells of these kinds: of no cells a double, as of numbers, of mixed
    kinds text."""
    return (
        F.when(kinds == INT, "bigint")
        .when(kinds.isin(0, FLOAT, INT | FLOAT), "double")
        .when(kinds == BOOL, "boolean")
        .when(kinds == DATE, "timestamp_ntz")
        .otherwise("string")
    )


def infer_types(
    df: DataFrame, by: Sequence[str] = (), na_tokens: Sequence[str] = schema.NA_TOKENS
) -> DataFrame:
    """``(by, position, column, type, kinds, n_rows, n_missing, whole_digits, scale)`` of every text
    column, from all its cells.

    The facts of a column (an OR of bits, two counts, two widths) merge in any order, so this is one
    scan with one partial aggregation, and a hot ``by`` group arrives as a few rows per task. Cells
    become rows of their place and text before their kind is found: what is generated for one cell
    serves all columns, and stays small enough to be compiled however many there are.
    ``whole_digits`` and ``scale`` are those of the widest plain number; ``kinds`` is the OR of 1
    whole number, 2 number, 4 truth value, 8 ISO date, 16 other text.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in by]
    cells = F.transform(F.array(*[F.col(f"`{n}`") for n in text]), lambda c: without_na(c, na_tokens))
    # An array named before would get a filter on its size, and so all cells computed twice.
    rows = df.select(*by, F.posexplode(cells).alias("_place", "_cell"))
    found = cell_facts(rows, "_cell").groupBy(*by, "_place").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_or("_kind").alias("kinds"),
        F.count("_kind").alias("n_cells"), F.max("_before").alias("whole_digits"),
        F.max("_after").alias("scale"),
    )
    if not by:  # of an empty table each column has a row too
        places = df.sparkSession.range(len(text)).select(F.col("id").cast("int").alias("_place"))
        found = places.join(found, "_place", "left").coalesce(1).sortWithinPartitions("_place")
    none = F.lit(0).cast("bigint")
    n_rows, kinds = F.coalesce("n_rows", none), F.coalesce("kinds", F.lit(0))
    return found.select(
        *by, F.col("_place").alias("position"),
        F.array(*map(F.lit, text))[F.col("_place")].alias("column"), type_of(kinds).alias("type"),
        kinds.alias("kinds"), n_rows.alias("n_rows"),
        (n_rows - F.coalesce("n_cells", none)).alias("n_missing"), "whole_digits", "scale",
    )


def as_type(c: Column, kind: str) -> Column:
    """A text cell as a value of an inferred type; null where it is not one."""
    text = T.StringType()
    if kind == "bigint":
        return F.trim(F.regexp_replace(c, r"\s", "")).try_cast("bigint")
    if kind == "double":
        return as_number(c, text)
    if kind == "boolean":
        return F.when(c.isin(*TRUE), True).when(c.isin(*FALSE), False)
    if kind == "timestamp_ntz":
        return as_moment(c, text)
    return c


#: What is done one after the other to read cells of a type.
READERS = {
    "bigint": (lambda c: as_type(c, "bigint"),),
    "double": (parsed_number, finite),
    "boolean": (lambda c: as_type(c, "boolean"),),
    "timestamp_ntz": (lambda c: as_type(c, "timestamp_ntz"),),
}


def with_types(
    df: DataFrame, types: dict[str, str] | None = None, na_tokens: Sequence[str] = schema.NA_TOKENS
) -> DataFrame:
    """The table with its text columns as the inferred types. Without ``types`` (column -> type)
    they are inferred first, in one job of which a row per column reaches the driver."""
    if types is None:
        types = {r["column"]: r["type"] for r in infer_types(df, (), na_tokens).collect()}
    # Cells of one type are read as an array, by one expression, so what is generated does not grow
    # with the number of columns.
    alike: dict[str, list[str]] = {}
    kept = {}
    for n, field in enumerate(df.schema):
        cell, is_text = F.col(f"`{field.name}`"), isinstance(field.dataType, T.StringType)
        kind = types.get(field.name, "string")
        if is_text and kind in READERS:
            alike.setdefault(kind, []).append(field.name)
        else:
            cell = without_na(cell, na_tokens) if is_text else cell
            kept[field.name] = as_type(cell, kind).alias(f"c{n}")
    arrays = []
    for kind, names in alike.items():
        cells = F.array(*[F.col(f"`{n}`") for n in names])
        cells = F.transform(cells, lambda c: without_na(c, na_tokens))
        for step in READERS[kind]:
            cells = F.transform(cells, step)
        arrays.append(cells.alias(kind))
    places = {name: (kind, n) for kind, names in alike.items() for n, name in enumerate(names)}
    return df.select(*kept.values(), *arrays).select(*[
        F.col(f"c{n}").alias(c) if c in kept else F.col(places[c][0])[places[c][1]].alias(c)
        for n, c in enumerate(df.columns)
    ])
