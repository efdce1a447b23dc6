"""Scores of whole texts by a word model of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import kneser_ney as kn
from tallywright.llm.storage import new_folder
from tallywright.llm.text import runs, words

#: No word holds a blank, so this is the hash of no word.
END = np.uint64(xxhash.xxh64_intdigest(b" "))
BITS = 32
UNKNOWN = np.uint64(2**BITS - 1)
#: Tokens of the training texts per shard of the model.
TOKENS_PER_SHARD = 2_000_000


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, which of them each token is, and where each text's begin.
    Words are lowered in A-Z; an end closes each text."""
    found = words(text, lower=True)
    distinct = np.append(found.hashes(), END)
    size = np.diff(found.first)
    first = np.append(0, np.cumsum(size + 1))
    codes = np.full(first[-1], len(distinct) - 1, np.int64)
    inner = np.ones(len(codes), bool)
    inner[first[1:] - 1] = False
    codes[inner] = found.codes
    return distinct, codes, first


def _bigrams(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of each token after the one before it; 0 stands before the first."""
    before = np.append(np.uint64(0), ids[:-1])
    before[first[:-1]] = 0
    return before << np.uint64(BITS) | ids


def _symbols(places: np.ndarray) -> np.ndarray:
    return np.where(places < 0, UNKNOWN, (places + 1).astype(np.uint64))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of each whole text under an interpolated modified Kneser-Ney model.

    The model is a bigram model of words: both the words and the pairs of all training texts are
    counted in Spark, nothing is left out, and kept as sorted hash arrays, which workers map into
    memory. Training texts are those whose crc32(id as text) mod 7 is not 2 (a null id trains).
    Tokens are the words, A-Z lowered, and an end per text. Unknown words share the mass that the
    lowest order leaves to a single unknown word.

    Returns ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams),
    score. A null or empty text is one token, the end. Without training texts all scores are 0.
    Repeated rows train and are scored each. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    training = slim.filter(~held_out(F.col("id"))).select("text")
    folder = kn.local_path(new_folder(spark, "words"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_layout = kn.Layout(f"{folder}/words", 1, 0, max(parts, 16))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in runs(batches):
            distinct, codes, _ = _tokens(batch.column("text"))
            yield distinct[codes]

    vocabulary = kn.tables(
        kn.merged(kn.counted(training, word_layout, 0, hashes), word_layout, 0).collect(), word_layout
    ).get(0)
    train_tokens = vocabulary.total if vocabulary else 0
    types = int(vocabulary.sizes.sum()) if vocabulary else 0
    shared = spark.sparkContext.broadcast(vocabulary)  # a few numbers per shard
    layout = kn.Layout(f"{folder}/pairs", 2, BITS, max(parts, -(-train_tokens // TOKENS_PER_SHARD)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in runs(batches):
            distinct, codes, first = _tokens(batch.column("text"))
            _, places = shared.value.find(distinct)
            yield _bigrams(_symbols(places)[codes], first)

    model = spark.sparkContext.broadcast(kn.fit(kn.counted(training, layout, 2, pairs), layout))
    scale = np.log10(train_tokens + types + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            distinct, codes, first = _tokens(batch.column("text"))
            if shared.value is None:
                counts, places = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1)
            else:
                counts, places = shared.value.find(distinct)
            keys, back = np.unique(_bigrams(_symbols(places)[codes], first), return_inverse=True)
            logs = np.log10(kn.probabilities(model.value, layout, keys))[back]
            base = (np.log10(counts + 1) - scale)[codes]
            columns = [
                np.diff(first),
                np.add.reduceat((counts > 0)[codes].astype(np.int64), first[:-1]),
                np.add.reduceat(base, first[:-1]),
                np.add.reduceat(logs, first[:-1]),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, columns)],
                ["id", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    scored = slim.mapInArrow(
        score, f"id {kind}, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
