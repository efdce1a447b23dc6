"""Quality rules: word counts and perplexity bands by language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import kneser_ney as kn
from tallywright.llm.storage import new_folder, stored
from tallywright.llm.text import SPACE, runs, shingles, text_bytes, words

BITS, ORDER = 11, 5
START, END, FIRST = 0, 1, 2
#: Bytes of text worked on at once.
RUN = 2 << 20
#: Characters below have a symbol of their own, those above share the rest by their code.
PLAIN = 1024
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in "#*$%&|<>"]] = True


#: Models that the keys have room for, two for each language.
MODELS = 2 ** (64 - ORDER * BITS)


def _windows(text: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each character and each text's end after the four characters before, in the group of
    the text's model; and where each text's begin (one more at the end)."""
    values = text.fill_null("").to_pylist()
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, values), np.int64, len(values))
    first = np.append(0, np.cumsum(size + 1))
    symbols = np.full(first[-1], END, np.uint64)
    inner = np.ones(len(symbols), bool)
    inner[first[1:] - 1] = False
    symbols[inner] = FIRST + np.where(codes < PLAIN, codes, PLAIN + codes % (2**BITS - PLAIN - FIRST))
    keys = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.zeros(len(symbols), np.uint64)
        earlier[back:] = symbols[:-back]
        for step in range(back):  # places whose window begins before the text
            places = first[:-1] + step
            earlier[places[places < first[1:]]] = START
        keys |= earlier << np.uint64(back * BITS)
    keys |= np.repeat(model.astype(np.uint64), size + 1) << np.uint64(ORDER * BITS)
    return keys, first


def rule_counts(text: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, at = text_bytes(text)
    rows = len(text)
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[at])
    found = words(text)
    windows, document = shingles(found, 8, short=False)
    repeated = np.zeros(len(found.codes) + 1, np.int64)
    if len(windows):
        count = np.diff(found.first)
        each = np.maximum(count - 7, 0)
        start = np.arange(len(windows)) + np.repeat(found.first[:-1] - (np.cumsum(each) - each), each)
        order = np.lexsort((windows, document))
        same = (windows[order][1:] == windows[order][:-1]) & (document[order][1:] == document[order][:-1])
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeated, start[twice], 1)
        np.add.at(repeated, start[twice] + 8, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    again = np.zeros(rows, np.int64)
    raw = data.tobytes()
    for row in range(rows):
        lines = raw[at[row] : at[row + 1]].split(b"\n")
        if len(lines) > 1:
            full = [line for line in lines if line.strip(b" \t\n\x0b\x0c\r")]
            again[row] = len(full) - len(set(full))
    return {
        "n_words": np.diff(found.first),
        "word_chars": total(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": total(SIGNS[data]),
        "n_dup_lines": again,
        "n_repeat_words": np.diff(np.append(0, np.cumsum(covered))[found.first]),
    }


def _ids(trusted: DataFrame, shards: int) -> kn.Table:
    """The ids as a table of sorted hashes, so that texts need not be shuffled to be matched."""
    folder = kn.local_path(new_folder(trusted.sparkSession, "trusted"))
    layout = kn.Layout(folder, 1, 0, shards)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column("key").to_numpy().view(np.uint64)

    keys = kn.counted(trusted.select(F.xxhash64(F.col("id").cast("string")).alias("key")), layout, 0, read)
    found = kn.tables(kn.merged(keys, layout, 0).collect(), layout)
    none = np.zeros(shards, np.int64)
    return found.get(0) or kn.Table(layout, 0, none > 0, none, 0, kn.discounts(np.zeros(4)))


def judge(
    docs: DataFrame,
    trusted: DataFrame | None = None,
    width: float = 6.0,
    least: float = 0.15,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Word rules, and bands of perplexity per language that a text must lie in.

    An interpolated modified Kneser-Ney model of five characters per language is counted in Spark
    over the texts with an id in ``trusted`` (a column id), kept as sorted hash arrays, and scores
    every whole text. A language has two models of its own, each of half the texts by their hash; a
    text is scored by the model of the other half, so that none is known by heart. A language that
    has no trusted texts in one of the halves (with None: every language) is counted whole; with all
    its texts in one half it scores 0. Languages are numbered; more than the keys have room for
    (256) raise ``ValueError``. A language's bands lie around the median of log10 perplexity per
    character over all its texts that pass the base rules, ``width`` median absolute deviations to
    either side, at least ``least``; a short text's deviation is divided by sqrt(1 + 400 /
    characters), as its mean varies more.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, log_perplexity, lower, upper. A null or empty text has no words and fails. Null languages
    are a language. A language without a text that passes the base rules has no bands. Repeated
    rows count each. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    half = F.coalesce(F.xxhash64("text").bitwiseAND(F.lit(1).cast("long")), F.lit(0)).cast("int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = kn.Layout(kn.local_path(new_folder(spark, "characters")), ORDER, BITS, parts)

    chosen = spark.sparkContext.broadcast(_ids(trusted, parts)) if trusted is not None else None
    training = slim.select(
        "text", "lang", half.alias("half"), F.xxhash64(F.col("id").cast("string")).alias("key")
    )

    def known(batch: pa.RecordBatch) -> np.ndarray:
        return chosen.value.find(batch.column("key").to_numpy().view(np.uint64))[0] > 0

    def languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch.filter(pa.array(known(batch)))])
            yield from found.group_by(["lang", "half"]).aggregate([]).to_batches()

    # Rows per language go to the driver.
    places = {r["lang"]: n for n, r in enumerate(slim.select("lang").distinct().sort("lang").collect())}
    if 2 * len(places) > MODELS:
        raise ValueError(f"{len(places)} languages; the models have room for {MODELS // 2}")
    learnt = set()
    if chosen is not None:
        trusting = training.filter("text != ''").select("lang", "half", "key")
        halves = trusting.mapInArrow(languages, "lang string, half int").distinct().groupBy("lang").count()
        learnt = {r["lang"] for r in halves.filter("count = 2").collect()}

    def models(batch: pa.RecordBatch, other: int) -> np.ndarray:
        """The number of each text's model: its language and a half."""
        own = np.fromiter((places[x] for x in batch.column("lang").to_pylist()), np.int64, batch.num_rows)
        return 2 * own + (batch.column("half").to_numpy() ^ other)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in runs(batches, size=RUN):
            if chosen is not None:
                missing = ~np.fromiter((x in learnt for x in batch.column("lang").to_pylist()), bool, batch.num_rows)
                batch = batch.filter(pa.array(known(batch) | missing))
            if batch.num_rows:
                yield _windows(batch.column("text"), models(batch, 0))[0]

    counted = kn.counted(training, layout, ORDER, read)
    model = spark.sparkContext.broadcast(kn.fit(counted, layout))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, size=RUN):
            text, lang = batch.column("text"), batch.column("lang")
            windows, first = _windows(text, models(batch, 1))
            keys, back = np.unique(windows, return_inverse=True)
            logs = np.log10(kn.probabilities(model.value, layout, keys))[back]
            mean = -np.add.reduceat(logs, first[:-1]) / np.diff(first)
            counts = rule_counts(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), lang, *map(pa.array, counts.values()), pa.array(mean), pa.array(np.diff(first))],
                ["id", "lang", *counts, "log_perplexity", "symbols"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"id {kind}, lang string, {', '.join(f'{n} long' for n in numbers)}, log_perplexity double, symbols long"
    scored = stored(
        slim.withColumn("half", half).mapInArrow(score, schema)
        .withColumn(
            "base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
        )
        .withColumn("spread", F.sqrt(1 + F.lit(400) / F.col("symbols")))
    )
    passed = scored.filter("not base_failed")
    middle = passed.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"))
    away = F.abs(F.col("log_perplexity") - F.col("middle")) / F.col("spread")
    bands = (
        passed.join(middle, passed["lang"].eqNullSafe(middle["lang"]))
        .drop(middle["lang"])
        .groupBy("lang")
        .agg(F.first("middle").alias("middle"), F.percentile_approx(away, 0.5, 10000).alias("deviation"))
        .withColumn("margin", F.greatest(F.col("deviation") * width, F.lit(least)))
        .withColumnRenamed("lang", "band_lang")
    )
    reach = F.col("margin") * F.col("spread")
    inside = F.coalesce(F.abs(F.col("log_perplexity") - F.col("middle")) <= reach, F.lit(True))
    return scored.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").select(
        F.col("id").alias(id_col),
        *numbers,
        "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        "log_perplexity",
        (F.col("middle") - reach).alias("lower"),
        (F.col("middle") + reach).alias("upper"),
    )
