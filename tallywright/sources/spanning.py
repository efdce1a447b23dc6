"""CSV files whose cells span lines, read by byte ranges in many tasks.

Whether a line begins inside a quoted cell depends on all lines before it. A line is a function from
the state at its begin (outside or inside quotes) to that at its end: it keeps the state, flips it,
or sets it whatever it was. Such functions combine, so every block of a file is folded by itself,
the blocks' functions are chained over one row per block, and each line then knows its own state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.operators.settle import settle

# A cell, in the steps of the reader: a quote opens only at a cell's begin, two quotes inside are
# one, and what follows a closing quote belongs to the cell.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+'
_ENDS_OUTSIDE = rf"\A{_CELL}(?:,{_CELL})*+\z"
_CLOSES = rf'\A[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_CELL})*+\z'

_LINE = ("file", "block")


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with their file, the begin of their byte range and a number that rises within it. Only a
    line feed ends a line; a carriage return before it stays."""
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number"),
        "value",
    )


def _chained(df: DataFrame, group: Sequence[str], order: str, sets: Column, flips: Column) -> DataFrame:
    """Fold functions of a state along ``order``: ``sets`` is the state a row sets, null if it sets
    none, ``flips`` whether it flips it. Adds ``base`` and ``turned``: the state before a row is
    ``base``, or what the group begins with where that is null, flipped if ``turned`` is odd."""
    through = Window.partitionBy(*group).orderBy(order)
    before = through.rowsBetween(Window.unboundedPreceding, -1)
    flip = flips.cast("long")
    return (
        df.withColumn("_through", F.sum(flip).over(through))
        .withColumn("_set", sets.bitwiseXOR((F.col("_through") % 2).cast("int")))
        .withColumn("base", F.last("_set", ignorenulls=True).over(before))
        .withColumn("turned", F.col("_through") - flip)
        .drop("_through", "_set")
    )


def _state(base: Column, turned: Column, begin: Column) -> Column:
    return F.coalesce(base, begin).bitwiseXOR((turned % 2).cast("int"))


def _folded(lines: DataFrame) -> DataFrame:
    """Lines with ``outside`` and ``inside``, the states they end in from either, and the chain of
    their block."""
    outside = F.when(F.col("value").rlike(_ENDS_OUTSIDE), 0).otherwise(1)
    inside = F.when(F.col("value").rlike(_CLOSES), 0).otherwise(1)
    known = lines.withColumns({"outside": outside, "inside": inside})
    return _chained(
        known, _LINE, "number",
        F.when(F.col("outside") == F.col("inside"), F.col("outside")),
        F.col("outside") > F.col("inside"),
    )


def _blocks(folded: DataFrame) -> DataFrame:
    """One row per block: ``begin``, the state it begins in, and ``end``."""
    last = F.max_by(F.struct("base", "turned", "outside", "inside"), "number").alias("l")
    ends = folded.groupBy(*_LINE).agg(last)
    ends = ends.withColumns({
        f"end{s}": F.when(_state(F.col("l.base"), F.col("l.turned"), F.lit(s)) == 0, F.col("l.outside"))
        .otherwise(F.col("l.inside"))
        for s in (0, 1)
    }).drop("l")
    chained = _chained(
        ends, ("file",), "block",
        F.when(F.col("end0") == F.col("end1"), F.col("end0")),
        F.col("end0") > F.col("end1"),
    )
    begin = _state(F.col("base"), F.col("turned"), F.lit(0))
    end = F.when(F.col("begin") == 0, F.col("end0")).otherwise(F.col("end1"))
    return chained.withColumn("begin", begin).withColumn("end", end).select(*_LINE, "begin", "end")


def _starts(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Lines with ``start``, the number of the line in which their record begins, and ``complete``,
    whether the record is this line alone; and one row per block."""
    lines = _lines(spark, paths)
    blocks = settle(_blocks(_folded(lines.select(*_LINE, "number", "value"))))
    newest = Window.partitionBy("file").orderBy("block")
    open_ = blocks.withColumn("last", F.max("block").over(Window.partitionBy("file")))
    broken = open_.where((F.col("block") == F.col("last")) & (F.col("end") == 1)).select("file").limit(1).collect()
    if broken:
        raise ValueError(f"a quoted cell of {broken[0].file} never ends")
    stated = _folded(lines).join(blocks.select(*_LINE, "begin"), list(_LINE))
    before = _state(F.col("base"), F.col("turned"), F.col("begin"))
    after = F.when(F.col("before") == 0, F.col("outside")).otherwise(F.col("inside"))
    within = Window.partitionBy(*_LINE).orderBy("number")
    begun = F.when(F.col("before") == 0, F.struct("block", "number"))
    found = stated.withColumn("before", before).withColumns({
        "after": after, "start": F.last(begun, ignorenulls=True).over(within),
    })
    # The record in which a block begins: the last that began in the file's earlier blocks.
    lasts = found.groupBy(*_LINE).agg(F.max("start").alias("start"))
    carried = lasts.withColumn(
        "carried", F.last("start", ignorenulls=True).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    ).drop("start")
    found = found.join(carried, list(_LINE)).withColumn("start", F.coalesce("start", "carried"))
    alone = (F.col("before") == 0) & (F.col("after") == 0)
    return found.select(*_LINE, "number", "value", "start", alone.alias("complete")), blocks


def spanning_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, start, record, first)``: the records of files whose cells may hold line feeds, as
    text, without empty ones; ``first`` marks each file's header.

    Records within one line stay where they were read; only the lines of longer ones are gathered,
    a record at a time. A file that ends inside quotes raises ``ValueError``: its last record would
    be all that follows the quote. Lines end with a line feed, a carriage return before it does not
    count; inside a cell both are kept.
    """
    lines, _ = _starts(spark, paths)
    alone = lines.where("complete").select("file", "start", F.col("value").alias("record"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "number", "value"))), lambda p: p["value"])
    longer = lines.where("not complete").groupBy("file", "start").agg(F.array_join(parts, "\n").alias("record"))
    records = alone.unionByName(longer).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    records = records.where("record != ''")
    headers = records.groupBy("file").agg(F.min("start").alias("header"))
    return records.join(headers, "file").select("file", "start", "record", (F.col("start") == F.col("header")).alias("first"))


def parsed(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """The records' cells as text columns ``names``, after the other columns."""
    kinds = ", ".join(f"`{n}` STRING" for n in names)
    cells = F.from_csv("record", F.lit(kinds), {"escape": '"', "multiLine": "true"})
    return records.withColumn("_cells", cells).select(
        *[c for c in records.columns if c != "record"], *[F.col(f"_cells.`{n}`").alias(n) for n in names]
    )
