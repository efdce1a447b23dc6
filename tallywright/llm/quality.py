"""Quality scores by the votes of labelled neighbours in a latent space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.text import LOWER, runs, text_bytes, words

SCORE = "quality_score"

#: Classes of bytes: small letter, capital, digit, blank, line break, full stop, comma, exclamation
#: mark, question mark, bar, sign, other ASCII, beyond ASCII.
CLASSES = 13
KIND = np.full(256, 11, np.uint8)
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A] = 0, 1, 2
KIND[[0x20, 0x09]], KIND[0x0A:0x0E] = 3, 4
KIND[[ord(c) for c in ".,!?|"]] = range(5, 10)
KIND[[ord(c) for c in "#*$%&<>"]] = 10
KIND[0x80:] = 12
LENGTHS = 12
LAYOUT = CLASSES**3 + 5 + LENGTHS
WORDS = 4096
GRAMS = 2048
TERMS = LAYOUT + WORDS + GRAMS

#: Terms of layout, words and letters: where they begin and end, and how much each kind counts.
PARTS = (
    (0, LAYOUT, 1.0),
    (LAYOUT, LAYOUT + WORDS, 0.7),
    (LAYOUT + WORDS, TERMS, 0.5),
)

#: Documents whose terms are held, and compared with the labelled rows, at once.
BLOCK = 512
#: Bytes of text whose terms are worked out at once: each byte takes some 60 in between.
RUN = 1 << 20


def term_weights(text: pa.Array) -> np.ndarray:
    """Square roots of term shares, a row per text.

    Terms are of three kinds. Of layout: triples of byte classes, words that repeat the first, second
    or third word before them, words seen before in the text, lines seen before, and the order of
    magnitude of the number of words. Words, and runs of four bytes (so scripts without blanks have
    terms too), each hashed to a fixed number of buckets; A-Z count as small letters.
    """
    data, at = text_bytes(text)
    rows = len(text)
    out = np.zeros((rows, TERMS), np.float32)
    size = np.maximum(np.diff(at), 1).astype(np.float32)[:, None]
    document = np.repeat(np.arange(rows), np.diff(at))
    kind = KIND[data].astype(np.int64)
    triple = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
    out[:, : CLASSES**3] = _counts(document, triple, rows, CLASSES**3) / size
    letter = LOWER[data].astype(np.uint32)
    gram = letter[:-3] << 24 | letter[1:-2] << 16 | letter[2:-1] << 8 | letter[3:]
    gram = (gram * np.uint32(2654435761) >> np.uint32(16)) % GRAMS
    out[:, LAYOUT + WORDS :] = _counts(document, gram.astype(np.int64), rows, GRAMS) / size
    found = words(text, lower=True)
    code, owner = found.codes.astype(np.int64), found.document()
    number = np.diff(found.first)
    some = np.maximum(number, 1)
    bucket = (found.hashes() % np.uint64(WORDS)).astype(np.int64)
    out[:, LAYOUT : LAYOUT + WORDS] = _counts(owner, bucket[code], rows, WORDS) / some[:, None]
    extra = CLASSES**3
    for gap in (1, 2, 3):
        same = owner[gap:][(code[gap:] == code[:-gap]) & (owner[gap:] == owner[:-gap])]
        out[:, extra + gap - 1] = np.bincount(same, minlength=rows) / some
    distinct = np.unique(owner << 32 | code) >> 32
    out[:, extra + 3] = 1 - np.bincount(distinct, minlength=rows) / some
    out[number == 0, extra + 3] = 0
    out[:, extra + 4] = _repeated_lines(data, at)
    magnitude = np.minimum(np.log2(some).astype(int), LENGTHS - 1)
    out[np.arange(rows), extra + 5 + magnitude] = 0.1
    return np.sqrt(out, out=out)


def terms_by_runs(batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    """The same, worked out over so few bytes at once that the places in between stay small."""
    parts = [term_weights(r.column(text_col)) for r in runs(iter([batch]), text_col, size=RUN)]
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def _counts(document: np.ndarray, term: np.ndarray, rows: int, terms: int) -> np.ndarray:
    """How often each text has each term. A term that begins so late in its text that it ends in the
    next one does not count: ``term`` is shorter than ``document`` by what a term needs after it."""
    after = len(document) - len(term)
    if len(term) == 0:
        return np.zeros((rows, terms), np.int64)
    inside = document[: len(term)] == document[after:]
    place = (document[: len(term)] * terms + term)[inside]
    return np.bincount(place, minlength=rows * terms).reshape(rows, terms)


def _repeated_lines(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of each text's bytes in lines equal to an earlier one of the text."""
    shares = np.zeros(len(at) - 1, np.float32)
    raw = data.tobytes()
    for row, (begin, end) in enumerate(zip(at[:-1], at[1:], strict=True)):
        lines = raw[begin:end].split(b"\n")
        if len(lines) > 2:
            seen: set[bytes] = set()
            again = 0
            for line in lines:
                again += len(line) if line in seen else 0
                seen.add(line)
            shares[row] = again / (end - begin)
    return shares


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def weigh(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit vectors of the weighted terms, in which each kind of term has its fixed share."""
    out = terms * weights
    for begin, end, share in PARTS:
        out[:, begin:end] = unit(out[:, begin:end]) * np.float32(share)
    return unit(out)


@dataclass
class Model:
    """Weights of the terms, axes of the latent space, unit vectors and labels of the sample."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        return unit(weigh(terms, self.weights) @ self.axes)

    def vote(self, terms: np.ndarray, neighbours: int, power: float) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, each weighted by its cosine."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        k = min(neighbours, len(self.labels))
        out = []
        for begin in range(0, len(terms), BLOCK):
            cosine = self.project(terms[begin : begin + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(float) ** power
            out.append((weight * self.labels[near]).sum(1) / weight.sum(1))
        return np.concatenate(out) if out else np.zeros(0)


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    per_label: int,
    dimensions: int,
    seed: int,
) -> Model:
    """Latent-semantic vectors of at most ``per_label`` labelled documents of each label, drawn by
    the seed among those not held out. The sample goes to the driver; its size is fixed."""
    clean = (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
        .filter("id is not null and label in (0, 1)")
        .filter(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    order = F.xxhash64(F.lit(seed), "id"), F.col("id")
    drawn = [clean.filter(F.col("label") == y).orderBy(*order).limit(per_label) for y in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # at most twice per_label rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, most=BLOCK):
            rows = [(np.flatnonzero(row), row) for row in terms_by_runs(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array([at.astype("<u2").tobytes() for at, _ in rows], pa.binary()),
                    pa.array([row[at].astype("<f4").tobytes() for at, row in rows], pa.binary()),
                ],
                ["id", "label", "at", "value"],
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    # Of rows with the same id the text with the smallest hash (then smallest) counts, in any order.
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("row")
    texts = texts.groupBy("id").agg(first).select("id", "row.text", "row.label")
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(count, f"id {kind}, label int, at binary, value binary").collect()
    rows.sort(key=lambda r: (str(r["id"]), r["label"]))
    terms = np.zeros((len(rows), TERMS), np.float32)
    for row, r in enumerate(rows):
        terms[row, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    held = np.count_nonzero(terms, axis=0)
    weights = (np.log((1 + len(rows)) / (1 + held)) + 1).astype(np.float32)
    weighed = weigh(terms, weights)
    axes = _axes(weighed, dimensions, seed)
    return Model(weights, axes, unit(weighed @ axes), np.array([r["label"] for r in rows]))


def _axes(rows: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The leading right singular vectors, by randomised subspace iteration."""
    start = np.random.default_rng(seed).standard_normal((rows.shape[1], dimensions + 16))
    basis = start.astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, axes = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ axes.T)[:, :dimensions].astype(np.float32)


def with_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = 2048,
    dimensions: int = 64,
    neighbours: int = 31,
    power: float = 8.0,
    seed: int = 42,
) -> DataFrame:
    """All columns of ``docs`` and quality_score, 0 to 1: how the nearest labelled rows vote.

    ``labels``: doc_id, quality (1 good, 0 bad; others ignored). Only rows whose crc32(doc_id as
    text) mod 3 is not 1 are learnt from, at most ``per_label`` of each label. Every document is
    compared with all of them by exact cosines, in blocks; the sample is broadcast, its size is
    bounded by the parameters. Only the text counts for a score, so repeated rows get equal ones.
    A null text or one without words scores 0; without any labelled row the others score 0.5. An
    input column of the name quality_score is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        fit(docs, labels, id_col, text_col, per_label, dimensions, seed)
    )
    kept = docs.drop(SCORE)
    names = kept.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, text_col, BLOCK):
            text = batch.column(text_col)
            votes = model.value.vote(terms_by_runs(batch, text_col), neighbours, power)
            votes[np.diff(words(text).first) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes)], [*names, SCORE])

    return kept.mapInArrow(score, T.StructType([*kept.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.select(
        F.col(id_col),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= 0.5).cast("int").alias("predicted"),
    )
