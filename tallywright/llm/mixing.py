"""Mixtures of sources by apportioned blocks of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.positions import with_positions
from tallywright.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"

#: A target of fewer blocks is settled in words, as whole blocks would miss it by too large a share.
FEW = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Share ``share`` times all tokens among the sources by weight; no target is over ``most``
    times its source, and what exceeds that goes to the others by weight.

    ``sizes``: source, source_size; a row per source. Sources in code point order, null last, get
    the weights in turn. Adds place (number in that order), weight and target. The windows see one
    row per source. If sources are ordered by the level at which they are full, and the level is
    worked out anew with each of them taken as full, the highest level is the one that holds.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(ordered) - 1).withColumn(
        "weight", F.element_at(choice, F.col("place") % len(weights) + 1)
    )
    limit = F.col("source_size") * float(most)
    by_level = Window.orderBy(limit / F.col("weight"), "place")
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * float(share)
        - (F.sum(limit).over(by_level) - limit)
    ) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    return (
        placed.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(limit, F.col("level") * F.col("weight")))
        .drop("level")
    )


def apportion(sources: DataFrame, block: int, blocks: int, shards: int) -> DataFrame:
    """Sainte-Lague: award ``blocks`` blocks one by one to the highest quotient
    ``target / (2 * awards so far + 1)``; equal quotients go to the earlier source.

    Awards in order of their quotients fill the shards one after another, so each shard's integer
    quotas follow the targets. Returns place, award (number within the source), shard. The window
    sees as many rows as there are blocks plus three per source, whatever the size of the input.
    """
    tries = F.ceil(F.col("target") / block).cast("int") + 2
    awards = (
        sources.filter(F.col("target") > 0)
        .select("place", "target", F.explode(F.sequence(F.lit(0), tries)).alias("award"))
        .withColumn("quotient", F.col("target") / (F.col("award") * 2 + 1))
    )
    rank = F.row_number().over(Window.orderBy(F.col("quotient").desc(), "place", "award"))
    return (
        awards.withColumn("rank", rank)
        .filter(F.col("rank") <= blocks)
        .select(
            "place", "award", F.floor((F.col("rank") - 1) * shards / blocks).cast("int").alias("shard")
        )
    )


def settle_few(sources: DataFrame, block: int) -> DataFrame:
    """Awards of sources with a target of fewer than ``FEW`` blocks: as many as can be needed to
    reach it, short last blocks included. Returns place, award."""
    tries = F.ceil(F.col("target") / block).cast("int") + 2
    return sources.filter((F.col("target") > 0) & (F.col("target") < FEW * block)).select(
        "place", F.explode(F.sequence(F.lit(0), tries)).alias("award")
    )


def choose_blocks(sources: DataFrame, awards: DataFrame, block: int, seed: int) -> DataFrame:
    """Which blocks of each source's seeded order the awards take: every block once in an order
    drawn by the seed, then a second time in another. A source with a target of fewer than ``FEW``
    blocks gets words up to its target, of the last block the first ones only. Returns place,
    award, block, length and words taken."""
    count = F.ceil(F.col("source_size") / block).cast("int")
    drawn = Window.partitionBy("place", "epoch").orderBy(
        F.xxhash64(F.lit(seed), "place", "epoch", "block"), "block"
    )
    passes = (
        sources.filter((F.col("target") > 0) & (F.col("source_size") > 0))
        .withColumn("count", count)
        .select(
            "place", "target", "source_size", "count",
            F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("block"),
        )
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
        .withColumn("award", F.col("epoch") * F.col("count") + F.row_number().over(drawn) - 1)
        .withColumn("length", F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * F.lit(block).cast("long")))
    )
    reached = F.sum("length").over(Window.partitionBy("place").orderBy("award")) - F.col("length")
    left = F.greatest(F.round("target").cast("long") - reached, F.lit(0).cast("long"))
    words = F.when(F.col("target") < FEW * block, F.least("length", left)).otherwise(F.col("length"))
    return (
        awards.join(passes, ["place", "award"])
        .withColumn("words", words)
        .filter("words > 0")
        .select("place", "award", "block", "length", "words")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 16,
    blocks_per_shard: int = 512,
    seed: int = 42,
) -> DataFrame:
    """How many words the mix takes of each document.

    A source is one run of words, its documents in an order drawn by ``seed``, cut into blocks of
    equal length, ``shards * blocks_per_shard`` to the whole mix. Sources with a target of ``FEW``
    blocks or more are apportioned whole blocks; a smaller one gets its target to the word, with a
    part of its last block. A source's blocks are chosen by the seed, none more than twice, so no
    document is taken more than twice. A block may begin and end inside documents.

    Returns ``id_col``, size (words; null text: 0), source_size, target, taken, the source and
    text_key, a hash of the text that tells apart rows of one id. A
    null source is a source. Repeated rows count each. Empty texts are taken 0 times. No words at
    all: targets are 0. The same rows and seed give the same result. Other columns are not read.
    """
    light = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col)).alias("text_key"),
        )
    )
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sizes, weights, share, most))
    tokens = sources.agg(F.sum("source_size")).first()[0]
    block = max(1, int(-(-share * (tokens or 0) // (shards * blocks_per_shard))))
    many = sources.filter(F.col("target") >= FEW * block)
    wanted = many.agg(F.sum("target")).first()[0]
    awards = apportion(many, block, max(1, round((wanted or 0) / block)), shards).select("place", "award")
    full = F.col("words") == F.col("length")
    times = (
        choose_blocks(sources, awards.union(settle_few(sources, block)), block, seed)
        .groupBy("place", "block")
        .agg(
            F.count_if(full).alias("times"),
            F.sum(F.when(full, 0).otherwise(F.col("words"))).alias("part"),
        )
        .groupBy("place")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("block", F.struct("times", "part")))).alias("times")
        )
    )
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    facts = stored(
        sources.withColumn("start", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .join(times, "place", "left")
        .withColumn(
            "times",
            F.coalesce("times", F.expr("cast(map() as map<int, struct<times: bigint, part: bigint>>)")),
        )
    )
    rows = light.withColumn("order_key", F.xxhash64(F.lit(seed), "id", "text_key")).withColumn(
        "last", F.col("source").isNull()
    )
    placed = with_positions(
        rows.select("last", "source", "order_key", "id", "text_key", "size"),
        ["last", "source", "order_key", "id", "text_key"],
        ["size"],
    )
    begin = F.col("before_size") - F.col("start")
    span = F.sequence(
        F.floor(F.col("begin") / block).cast("int"),
        F.floor((F.col("begin") + F.col("size") - 1) / block).cast("int"),
    )
    end = F.col("begin") + F.col("size")

    def overlap(b: Column, length: Column) -> Column:
        first = b.cast("long") * block
        inside = F.least(end, first + length) - F.greatest(F.col("begin"), first)
        return F.greatest(inside, F.lit(0).cast("long"))

    none = F.lit(0).cast("long")
    part = F.aggregate(
        span,
        none,
        lambda total, b: total
        + F.coalesce(F.col("times")[b]["times"], none) * overlap(b, F.lit(block).cast("long"))
        + overlap(b, F.coalesce(F.col("times")[b]["part"], none)),
    )
    # A row per source, with the blocks apportioned above: bounded by those two numbers.
    facts = F.broadcast(facts.withColumnRenamed("source", "own_source"))
    return (
        placed.join(facts, F.col("source").eqNullSafe(F.col("own_source")))
        .withColumn("begin", begin)
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            F.when(F.col("size") > 0, part).otherwise(F.lit(0)).cast("long").alias("taken"),
            F.col("source").alias(source_col),
            "text_key",
        )
    )


def apply_mix(
    docs: DataFrame,
    mix: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 42,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, a text that a block's edge cuts one time
    more or less: of a source's cut texts, those with the largest share taken of their rest come
    once more, as many as hold the words that all of them are short of. So a source's words miss
    what is taken of it by half a text at most. Rows equal in id, text and source share what is
    taken of them and count as one text. Null ids and sources are matched like others."""
    shares = stored(
        mix.filter("size > 0")
        .groupBy(
            F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("text_key").alias("__key")
        )
        .agg(F.sum("size").alias("__size"), F.sum("taken").alias("__taken"))
        .withColumn("__copies", F.expr("cast(__taken div __size as int)"))
        .withColumn("__rest", F.col("__taken") % F.col("__size"))
    )
    keys = ["__last", "__source", "__share", "__order", "__id", "__key"]
    cut = with_positions(
        shares.filter("__rest > 0")
        .withColumn("__last", F.col("__source").isNull())
        .withColumn("__share", -F.col("__rest") / F.col("__size"))
        .withColumn("__order", F.xxhash64(F.lit(seed), "__id", "__key"))
        .select(*keys, "__size", "__rest", "__copies"),
        keys,
        ["__size"],
    )
    # A row per source.
    short = F.broadcast(
        cut.groupBy(F.col("__source").alias("__own_source")).agg(
            F.min("before___size").alias("__start"), F.sum("__rest").alias("__short")
        )
    )
    middle = F.col("before___size") - F.col("__start") + F.col("__size") / 2
    settled = cut.join(short, F.col("__source").eqNullSafe(F.col("__own_source"))).withColumn(
        "__copies", F.col("__copies") + (middle <= F.col("__short")).cast("int")
    )
    columns = ["__id", "__source", "__key", "__copies"]
    copies = shares.filter("__rest = 0").select(*columns).union(settled.select(*columns)).filter("__copies > 0")
    # Under numbers, no column of the table can be called like one of those above.
    number = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    same = (
        F.col(number[id_col]).eqNullSafe(F.col("__id"))
        & F.col(number[source_col]).eqNullSafe(F.col("__source"))
        & (F.xxhash64(F.col(number[text_col])) == F.col("__key"))
    )
    rows = docs.toDF(*number.values()).join(copies, same)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    return rows.select(*[F.col(n).alias(c) for c, n in number.items()])
