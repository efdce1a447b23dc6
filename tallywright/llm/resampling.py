"""Importance resampling of documents towards a target distribution of n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.interning import Interned, grams, intern
from tallywright.llm.positions import with_positions
from tallywright.llm.text import runs

#: Bytes of text worked on at once.
RUN = 2 << 20


def _buckets(table: Interned, number: int) -> np.ndarray:
    """The bucket of each slot in use: the CRC-32 of its n-gram, once for all its occurrences."""
    bucket = np.zeros(len(table.owner), np.int64)
    for slot in table.used():
        bucket[slot] = zlib.crc32(table.grams.bytes_of(table.owner[slot])) % number
    return bucket


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of all texts (a column text) fall into each bucket. Each task sums its own;
    a number per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in runs(batches, size=RUN):
            table = intern(grams(batch.column("text"), longest))
            used = table.used()
            np.add.at(total, _buckets(table, buckets)[used], table.count[used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to that in the source, one
    added to every bucket, rounded down."""
    share = (int(source.sum()) + len(source), int(target.sum()) + len(target))
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * share[0] / ((s + 1) * share[1]))) for s, t in pairs], np.int64
    )


def noise(id_: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable that the seed and the id decide, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((drawn + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    least_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Draw ``percent`` of the documents so that they resemble the ``target`` texts.

    Features are all runs of 1 to ``longest`` words, hashed into ``buckets``. A document's weight is
    the mean gain of its features, the log ratio of its buckets' shares in the target and among all
    documents. Weight plus seeded Gumbel noise is its score; the highest scores among documents of
    ``least_words`` words or more are a sample without replacement by those weights.

    In each run of texts equal n-grams share a slot of an open-addressed table, so their bytes are
    looked at once; the slots of the occurrences gather the gains. Two passes over the texts; what
    the driver sees is a number per bucket. Ranks come from a range sort and its totals.

    Returns ``id_col``, n_features, weight, score, rank (from 1; null if not drawn). Null and empty
    texts have no words, weight 0, and are never drawn. Repeated rows count, score and are drawn
    each. A null id draws the noise of an empty id and is last of equal scores. An empty table gives
    no rows, an empty target gains that favour rare words. Other columns are not read. A text is
    worked on as a whole, at some 60 bytes for each of its bytes.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    aim = target.select(F.col(target_col).alias("text"))
    gain = gains(bucket_counts(slim, longest, buckets), bucket_counts(aim, longest, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, size=RUN):
            found = grams(batch.column("text"), longest)
            table = intern(found)
            each = gain[_buckets(table, buckets)][table.slot]
            features = np.bincount(found.document, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, found.document, each)
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found.words), pa.array(features), pa.array(weight)],
                ["id", "n_words", "n_features", "weight"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    weighed = slim.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")
    score = F.col("weight") + noise(F.col("id"), seed)
    ordered = weighed.select(
        "id", "n_features", "weight", score.alias("score"),
        (F.col("n_words") < least_words).cast("int").alias("out"),
        (-score).alias("down"),
        F.col("id").isNull().cast("int").alias("nameless"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = ["out", "down", "nameless", "id", "n_features", "weight", "row"]
    placed = with_positions(ordered, keys, [])
    drawn = placed.filter("out = 0").count() * percent // 100
    return placed.select(
        F.col("id").alias(id_col), "n_features", "weight", "score",
        F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank"),
    )
