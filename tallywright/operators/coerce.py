"""From columns as read to typed sales and marketing facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright import schema
from tallywright.functions.numbers import finite

# Written grammars: what the casts would accept beyond them is rejected.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$"


def without_na(c: Column, tokens: Sequence[str] = schema.NA_TOKENS) -> Column:
    """A text cell, null where it holds a missing-value token."""
    return F.when(~c.isin(*tokens), c) if tokens else c


def drop_na_tokens(df: DataFrame, tokens: Sequence[str] = schema.NA_TOKENS) -> DataFrame:
    """Cells holding a missing-value token become null in every text column."""
    if not tokens:
        return df
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            without_na(F.col(f"`{c}`"), tokens).alias(c) if c in text else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def parsed_number(c: Column) -> Column:
    """The double that a text cell writes, an infinity beyond the largest one; else null."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def as_number(c: Column, kind: T.DataType) -> Column:
    """A double, or null where the cell is not a number. Typed columns skip the text grammar."""
    if isinstance(kind, T.StringType):
        return finite(parsed_number(c))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return finite(c.cast("double"))
    if isinstance(kind, T.DecimalType):  # to the nearest double of the decimal's own text
        return c.cast("string").cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def as_moment(c: Column, kind: T.DataType, formats: Sequence[str] = ()) -> Column:
    """A timestamp without zone, or null; ISO text first, then ``formats`` in their order.

    Numbers are not dates: a bare integer says nothing about its unit.
    """
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    tries = [F.when(c.rlike(ISO_DATE), c.try_cast("timestamp_ntz"))]
    tries += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


# Ways to write a date, in the order of their numbers: ISO, then year, month or day first. Any of
# / . - may stand between the numbers.
_WRITTEN = (None, "yyyy/M/d", "M/d/yyyy", "d/M/yyyy")


def date_style(cell: Column) -> Column:
    """The number of the style that a date text is written in, null if none fits. Where day and
    month could be either, the month comes first."""
    leading = F.regexp_extract(cell, r"^\s*(\d{1,2})[/.-]\d{1,2}[/.-]\d{4}", 1).try_cast("int")
    return (
        F.when(cell.rlike(ISO_DATE), 0)
        .when(cell.rlike(r"^\s*\d{4}[/.-]\d{1,2}[/.-]\d{1,2}"), 1)
        .when(leading > 12, 3)
        .when(leading.isNotNull(), 2)
    )


def with_inferred_dates(
    df: DataFrame, file: Sequence[str], order: str, column: str = "date"
) -> DataFrame:
    """Text dates of many files as timestamps, each file's by the style of its first date.

    That is the cell with the least ``order`` among the file's cells that are not null, found by
    hash aggregation and looked up. Cells of another style become null, ISO text is always read.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    cells = df.select(*file, order, column).where(F.col(column).isNotNull())
    firsts = cells.groupBy(*file).agg(F.min(order).alias(order))
    styles = cells.join(firsts, [*file, order]).groupBy(*file).agg(
        F.min(date_style(F.col(column))).alias("_style")
    )
    day = F.regexp_replace(F.regexp_extract(column, r"^\s*([\d/.-]+)", 1), "[.-]", "/")
    moment = as_moment(F.col(column), T.StringType())
    for number, written in enumerate(_WRITTEN):
        if written:
            read = F.try_to_timestamp(day, F.lit(written)).cast("timestamp_ntz")
            moment = F.coalesce(moment, F.when(F.col("_style") == number, read))
    return df.join(styles, list(file), "left").withColumn(column, moment).drop("_style").select(*df.columns)


def rename_by_mapping(df: DataFrame, mapping: Mapping[str, str | None]) -> DataFrame:
    """Give the chosen source columns their standard names.

    ``mapping`` is field -> source column; fields without a source are skipped, and so are sources
    the table does not have. A source chosen for two fields is copied. Taking a name that another
    column keeps raises ``ValueError``; a column whose name differs in case only is left out, as
    Spark could not tell the two apart.
    """
    chosen = {f: s for f, s in mapping.items() if s and s in df.columns}
    sources = set(chosen.values())
    kept = [c for c in df.columns if c not in sources]
    clash = sorted(set(kept) & set(chosen))
    if clash:
        raise ValueError(f"columns {clash} exist already and are not part of the mapping")
    taken = {f.lower() for f in chosen}
    columns = []
    for c in df.columns:
        if c in kept and c.lower() in taken:
            continue
        names = [f for f, s in chosen.items() if s == c] or [c]
        columns += [F.col(f"`{c}`").alias(name) for name in names]
    return df.select(*columns)


def require_columns(df: DataFrame, domain: str) -> None:
    """Raise ``ValueError`` for the first required field the table lacks. Reads the schema only."""
    for field in schema.REQUIRED[schema.domain_of(domain)]:
        if field not in df.columns:
            raise ValueError(f"{field} column is required for {domain} analysis")


# Names the operators give to columns of their own.
RESERVED = {"date", "month", "section", "key", "part", "orders", *schema.MEASURES}


def check_tenant_columns(by: Sequence[str]) -> None:
    clash = sorted(RESERVED & set(by))
    if clash:
        raise ValueError(f"rename the tenant columns {clash}: the reports use these names")


def _parse(
    df: DataFrame, kept: Sequence[Column], parsed: dict[str, Column], from_text: bool
) -> DataFrame:
    """Select kept and parsed columns and drop the rows where a parsed one is null.

    A filter on an expression is evaluated below the projection and so once more than needed, which
    for typed columns is free and lets ``IS NOT NULL`` reach the parquet scan. Parsing text costs
    more than the rest of the scan, so there a generator of one row keeps the filter above it.
    """
    values = [c.alias(name) for name, c in parsed.items()]
    if from_text:
        typed = df.select(*kept, F.inline(F.array(F.struct(*values))))
    else:
        typed = df.select(*kept, *values)
    complete = F.lit(True)
    for name in parsed:
        complete = complete & F.col(name).isNotNull()
    return typed.where(complete)


def sales_facts(
    df: DataFrame, by: Sequence[str] = (), formats: Sequence[str] = ()
) -> DataFrame:
    """Typed sales rows; rows without a usable date or revenue are dropped."""
    check_tenant_columns(by)
    require_columns(df, "sales")
    kinds = {f.name: f.dataType for f in df.schema}
    kept = [F.col(c) for c in by]
    for c in ("product", "region", "customer"):
        if c in df.columns and c not in by:
            kept.append(F.col(c).cast("string").alias(c))
    if "quantity" in df.columns and "quantity" not in by:
        kept.append(as_number(F.col("quantity"), kinds["quantity"]).alias("quantity"))
    parsed = {
        "date": as_moment(F.col("date"), kinds["date"], formats),
        "revenue": as_number(F.col("revenue"), kinds["revenue"]),
    }
    return _parse(df, kept, parsed, T.StringType() in (kinds["date"], kinds["revenue"]))


def marketing_facts(
    df: DataFrame, by: Sequence[str] = (), formats: Sequence[str] = (), spend_required: bool = False
) -> DataFrame:
    """Typed marketing rows; rows without a date are dropped, unusable measures count as 0."""
    check_tenant_columns(by)
    if spend_required:
        require_columns(df, "marketing")
    elif "date" not in df.columns:
        raise ValueError("date column is required for marketing analysis")
    kinds = {f.name: f.dataType for f in df.schema}
    kept = [F.col(c) for c in by]
    if "campaign" in df.columns and "campaign" not in by:
        kept.append(F.col("campaign").cast("string").alias("campaign"))
    for m in schema.MEASURES:
        if m in df.columns:
            kept.append(F.coalesce(as_number(F.col(m), kinds[m]), F.lit(0.0)).alias(m))
    parsed = {"date": as_moment(F.col("date"), kinds["date"], formats)}
    return _parse(df, kept, parsed, kinds["date"] == T.StringType())
