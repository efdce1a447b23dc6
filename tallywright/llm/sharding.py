"""Contiguous shards of nearly equal byte size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.positions import with_positions


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
    slack: float = 0.05,
) -> DataFrame:
    """Put every row into one of ``shards`` contiguous pieces of one global order.

    The order is that of a hash of the text, so equal texts are neighbours. Prefix sums of the
    sizes come from per-partition totals; a row goes to the shard in which its middle byte falls
    when the total is cut at equal targets. Where a cut falls into a run of equal texts, it moves
    to the nearer end of the run if that is within ``slack`` of a shard's target; a longer run is
    split there, so sizes stay nearly equal however many copies a text has.

    Returns ``id_col``, size (UTF-8 bytes + 1; a null text has none), text_crc32, law, shard, slot
    (row number in the shard), grown_shard (null: this law moves rows when shards are added).
    Repeated rows and ids are kept as they are. An empty table gives no rows; with fewer rows than
    shards some shards stay empty. Other columns are not read.
    """
    light = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = with_positions(light, ["text_key", "id"], ["size"])
    total, rows = placed.agg(F.sum("size"), F.count("*")).first()
    cuts = _cuts(placed, shards, int(total or 0), int(rows), slack)
    shard = F.lit(0)
    first = F.lit(0).cast("long")
    for at, cut in enumerate(cuts, 1):
        shard = F.when(F.col("position") >= cut, at).otherwise(shard)
        first = F.when(F.col("position") >= cut, F.lit(cut).cast("long")).otherwise(first)
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("position") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(placed: DataFrame, shards: int, total: int, rows: int, slack: float) -> list[int]:
    """The row numbers at which shards 1, 2, ... begin. Gathers a row per shard, no more."""
    if not rows:
        return [0] * (shards - 1)
    middle = (F.col("before_size") * 2 + F.col("size")) * shards
    first = (
        placed.withColumn("shard", F.floor(middle / (2 * total)))
        .groupBy("shard")
        .agg(F.min(F.struct("position", "before_size", "text_key")).alias("row"))
        .collect()
    )
    begins = {int(r["shard"]): r["row"] for r in first}
    keys = sorted({r["text_key"] for r in begins.values()})
    runs = {
        r["text_key"]: r
        for r in placed.filter(F.col("text_key").isin(keys))
        .groupBy("text_key")
        .agg(
            F.min("position").alias("first"),
            (F.max("position") + 1).alias("end"),
            F.min("before_size").alias("from"),
            F.max(F.col("before_size") + F.col("size")).alias("to"),
        )
        .collect()
    }
    cuts, following = [], rows
    for at in range(shards - 1, 0, -1):
        if at in begins:
            row = begins[at]
            run = runs[row["text_key"]]
            back, ahead = row["before_size"] - run["from"], run["to"] - row["before_size"]
            following = row["position"]
            if back and min(back, ahead) <= slack * total / shards:
                following = run["first"] if back <= ahead else run["end"]
        cuts.append(following)
    return sorted(cuts)
