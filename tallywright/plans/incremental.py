"""Sales reports kept up to date: a tenant's new upload replaces its earlier one without reading
any other upload again.

A store is a log of changes. A change adds, for each tenant it replaces, the partial sums of the new
upload and takes off those of the earlier one, so what holds now is the sum over the log. All sums
are integers (see :func:`partial_states`), so taking off is exact.

The folder holds ``states`` and ``uploads``, by change and slot, a slot being the tenants of one
remainder of a hash, and ``commits``. A change counts once its commit is there, which is a single
file written last. A change that failed on its way is not seen and can be applied again; one that
counts is not applied twice. Changes must come from one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallywright.functions.numbers import sum_parts, sum_total
from tallywright.operators import coerce, sales
from tallywright.operators.settle import settle
from tallywright.plans import reports

# What millionths leave of a value is counted in multiples of 2**-72, in three runs of 21 bits. More
# than 2**-9 is left only of values from 2**83 on; those are added as doubles and counted.
_REST = "revenue__rest"
_FINE = f"CASE WHEN abs({_REST}) < 0.001953125D THEN CAST(rint({_REST} * pow(2D, 72)) AS BIGINT) ELSE 0L END"
_IS_LARGE = f"abs({_REST}) >= 0.001953125D"
_WHOLE_PARTS = [f"revenue__{part}" for part in ("top", "middle", "bottom", "high", "mid", "low")]
_FINE_PARTS = {
    "fine_high": "shiftright(revenue__fine, 42)",
    "fine_mid": "shiftright(revenue__fine, 21) & 2097151L",
    "fine_low": "revenue__fine & 2097151L",
}
_COUNTS = [*_WHOLE_PARTS, *_FINE_PARTS, "n_large", "orders"]
_FINE_TOTAL = (
    "((fine_high * 4398046511104D + fine_mid * 2097152D) + fine_low) * pow(2D, -72)"
    " + CASE WHEN n_large = 0 THEN 0D ELSE large END"
)


@dataclass(frozen=True)
class Store:
    """Where reports are kept. ``by`` names the tenant columns with their types, ``fields`` the
    fields that uploads have; ``slots`` bounds how finely the log is read and written."""

    folder: str
    by: str = "tenant STRING"
    fields: tuple[str, ...] = ("date", "revenue", "product", "region", "customer")
    slots: int = 64

    @property
    def keys(self) -> list[str]:
        return StructType.fromDDL(self.by).fieldNames()

    @property
    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.slots)).cast("int")

    def schema(self, name: str) -> str:
        counts = ", ".join(f"{c} BIGINT" for c in _COUNTS)
        columns = {
            "states": f"{self.by}, section STRING, key STRING, {counts}, large DOUBLE",
            "uploads": f"{self.by}, upload_id STRING, uploaded_at TIMESTAMP_NTZ",
        }
        return f"{columns[name]}, change INT, slot INT"


# Partial states -----------------------------------------------------------------------------


def partial_states(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """What a breakdown of ``facts`` is made of: ``(by, section, key)`` with integer sums that can
    be added to and taken from those of other facts, and the doubles of values from 2**83 on.

    A value is rounded to a multiple of 2**-72, which values of up to six decimals below 2**83 do
    not notice. Where values from 2**83 on are replaced by others, the last digits of their sum may
    differ from a new computation, as for all sums of doubles.
    """
    fine = sales.cut_amounts(facts, by).withColumn("revenue__fine", F.expr(_FINE))
    whole = sum_parts("revenue")[: len(_WHOLE_PARTS)]  # all but the rest
    return sales.sectioned(
        fine,
        by,
        *whole,
        *[F.expr(f"sum({text})").alias(part) for part, text in _FINE_PARTS.items()],
        F.count(F.when(F.expr(_IS_LARGE), 1)).alias("n_large"),
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum(F.when(F.expr(_IS_LARGE), F.col(_REST))), F.lit(0.0)).alias("large"),
    )


def negated(states: DataFrame) -> DataFrame:
    return states.withColumns({c: -F.col(c) for c in (*_COUNTS, "large")})


def merged(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sum of states for the same tenant, section and key; sums that are all zero go. Where a
    replacement leaves the number of rows as it was, the other sums still tell the change."""
    summed = states.groupBy(*by, "section", "key").agg(
        *[F.sum(c).alias(c) for c in (*_COUNTS, "large")]
    )
    return summed.where(" OR ".join(f"{c} != 0" for c in _COUNTS))


def finished(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merged states as the rows of ``sales.breakdown``."""
    rest = states.withColumn(_REST, F.expr(_FINE_TOTAL))
    return rest.select(*by, "section", "key", sum_total("revenue"), "orders")


# The log ------------------------------------------------------------------------------------


def create(spark: SparkSession, store: Store) -> None:
    """An empty store: change 0."""
    for name in ("states", "uploads"):
        empty = spark.createDataFrame([], store.schema(name))
        _write(empty, store, name, 0)
    _commit(spark, store, 0, None)


def _write(df: DataFrame, store: Store, name: str, change: int) -> None:
    kept = StructType.fromDDL(store.schema(name)).fieldNames()[:-2]
    slotted = df.withColumn("slot", store.slot).select(*kept, "slot")
    slotted.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(
        f"{store.folder}/{name}/change={change}"
    )


def _commit(spark: SparkSession, store: Store, change: int, replaces: int | None) -> None:
    row = spark.range(1).select(
        F.lit(change).alias("change"), F.lit(replaces).cast("int").alias("replaces")
    )
    row.coalesce(1).write.mode("append").parquet(f"{store.folder}/commits")


def changes(spark: SparkSession, store: Store) -> tuple[list[int], list[int]]:
    """All changes that count, and those of them that have not been compacted into a later one."""
    rows = (
        spark.read.schema("change INT, replaces INT").parquet(f"{store.folder}/commits").collect()
    )  # two numbers a change
    done = sorted({r.change for r in rows})
    replaced = max((r.replaces for r in rows if r.replaces is not None), default=-1)
    return done, [c for c in done if c > replaced]


def log(spark: SparkSession, store: Store, name: str, slots: Sequence[int] | None = None) -> DataFrame:
    """The states or uploads of all changes that hold, of some slots only if given. Both bounds are
    on partition columns, so nothing else is read."""
    _, live = changes(spark, store)
    rows = spark.read.schema(store.schema(name)).parquet(f"{store.folder}/{name}")
    rows = rows.where(F.col("change").isin(live))
    return rows if slots is None else rows.where(F.col("slot").isin(list(slots)))


def _slots(df: DataFrame, store: Store) -> list[int]:
    """The slots of the tenants of a table: as many numbers as the store has slots at most."""
    return sorted(r[0] for r in df.select(store.slot.alias("slot")).distinct().collect())


def apply_change(
    spark: SparkSession, store: Store, change: int, rows: DataFrame, uploads: DataFrame,
    formats: Sequence[str] = (),
) -> bool:
    """Let the newest of ``uploads`` replace what the store holds of their tenants.

    ``uploads`` has the tenant columns, ``upload_id`` and ``uploaded_at``; ``rows`` the tenant
    columns, ``upload_id`` and the fields. An upload that is older than what the store holds changes
    nothing; one with equal time and id replaces it. An upload without usable rows empties its
    tenant. Uploads without a tenant, time or id are left out. ``change`` is a number above all
    before; False is returned for one that counts already.

    Reads ``rows`` and ``uploads`` once each, and of the log only the slots of the tenants in question.
    """
    done, _ = changes(spark, store)
    if change in done:
        return False
    if change < max(done):
        raise ValueError(f"change {change} comes after change {max(done)}")
    by = store.keys
    sent = uploads.select(
        *by,
        F.col("upload_id").cast("string").alias("upload_id"),
        F.col("uploaded_at").cast("timestamp_ntz").alias("uploaded_at"),
    ).dropna()
    last = sent.groupBy(*by).agg(F.max(F.struct("uploaded_at", "upload_id")).alias("last"))
    sent = settle(last.select(*by, "last.upload_id", "last.uploaded_at"))  # a row per tenant
    known = log(spark, store, "uploads", _slots(sent, store)).select(*sent.columns)
    sides = sent.withColumn("new", F.lit(True)).unionByName(known.withColumn("new", F.lit(False)))
    newest = sides.groupBy(*by).agg(F.max(F.struct("uploaded_at", "upload_id", "new")).alias("last"))
    winners = settle(
        newest.where("last.new").select(*by, "last.upload_id", "last.uploaded_at")
    )
    text_id = rows.withColumn("upload_id", F.col("upload_id").cast("string"))
    mine = text_id.join(winners.select(*by, "upload_id"), [*by, "upload_id"], "left_semi")
    new = partial_states(coerce.sales_facts(mine, by, formats), by)
    held = log(spark, store, "states", _slots(winners, store)).select(*new.columns)
    old = held.join(winners.select(*by), by, "left_semi")
    _write(merged(new.unionByName(negated(old)), by), store, "states", change)
    _write(winners, store, "uploads", change)
    _commit(spark, store, change, None)
    return True


def compact(spark: SparkSession, store: Store) -> int:
    """Write what holds as a change of its own that stands for all before; returns its number. The
    files of the earlier ones are not read any more and may be removed."""
    done, _ = changes(spark, store)
    number, by = max(done) + 1, store.keys
    _write(merged(log(spark, store, "states"), by), store, "states", number)
    newest = log(spark, store, "uploads").groupBy(*by).agg(
        F.max(F.struct("uploaded_at", "upload_id")).alias("last")
    )
    _write(newest.select(*by, "last.upload_id", "last.uploaded_at"), store, "uploads", number)
    _commit(spark, store, number, number - 1)
    return number


# Reports ------------------------------------------------------------------------------------


def breakdown(
    spark: SparkSession, store: Store, by: Sequence[str] | None = None, change: int | None = None
) -> DataFrame:
    """The rows of ``sales.breakdown`` over what the store holds, from its states alone.

    ``by`` may be some of the tenant columns, or none: states add up over the others. ``change``
    keeps to the tenants that this change replaced, and to their slots of the log.
    """
    slots = touched = None
    if change is not None:
        uploads = spark.read.schema(store.schema("uploads")).parquet(f"{store.folder}/uploads")
        touched = uploads.where(F.col("change") == change).select(*store.keys)
        slots = _slots(touched, store)
    states = log(spark, store, "states", slots)
    if touched is not None:
        states = states.join(touched, store.keys, "left_semi")
    by = store.keys if by is None else list(by)
    return finished(merged(states, by), by)


def sales_report(
    spark: SparkSession, store: Store, change: int | None = None, stamp: bool = True
) -> reports.Report:
    """The reports of all tenants, or of those that a change replaced."""
    entries = sales.leading(breakdown(spark, store, change=change), store.keys)
    return reports.sales_report_of(entries, store.keys, store.fields, stamp=stamp)
