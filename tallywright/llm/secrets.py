"""Secrets in texts, in DataFrame functions only: patterns, and random strings by Markov models."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.text import free_name

# Kinds in the order of the result, pattern, group whose length counts, least length.
BASE = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
# End of the fixed values.

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 12  # characters of a candidate
DIFFERENT = 6  # different characters of a candidate: runs of few characters are no keys
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside refer to it."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern with their places in code points.

    What lies between the matches comes from ``split``; a match begins after all earlier gaps and
    matches. The lengths are first added up in groups of 64, so a text with very many matches does
    not take quadratic time.
    """
    # Only a run of at least so many characters can pass, so most texts need one test.
    quick = {"hex": f"[0-9a-f]{{{least}}}"}.get(kind, pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def build(found: Column) -> Column:
        steps = F.transform(found["whole"], lambda m, i: F.length(m) + found["gaps"][i])
        return let(steps, lambda s: with_sums(found, s))

    def with_sums(found: Column, steps: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(steps) / 64).cast("int")),
            lambda g: total(F.slice(steps, g * 64 + 1, F.lit(64))),
        )
        return let(groups, lambda sums: struct(found, steps, sums))

    def struct(found: Column, steps: Column, sums: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            group_ = F.floor(i / 64).cast("int")
            start = (
                total(F.slice(sums, F.lit(1), group_))
                + total(F.slice(steps, group_ * 64 + 1, i % 64))
                + found["gaps"][i]
            )
            return F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                (start + F.length(match)).alias("end"),
                F.lit(kind).alias("kind"),
                found["value"][i].alias("value"),
            )

        return F.filter(F.transform(found["whole"], one), lambda s: F.length(s["value"]) >= least)

    found = F.struct(gaps.alias("gaps"), whole.alias("whole"), value.alias("value"))
    return F.when(text.rlike(quick), let(found, build)).otherwise(F.array()).cast(SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and kind; leftmost and not overlapping per kind."""
    kinds = [
        _spans(text, kind, rank, pattern, group, least)
        for rank, (kind, pattern, group, least) in enumerate(BASE)
    ]
    return F.array_sort(F.concat(*kinds))


def labelled_samples(
    spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, documents: int, strings: int, seed: int
) -> DataFrame:
    """Labelled strings (value, is_random): ``strings`` digests of numbers in hexadecimal and in
    base 64 as random ones, and as ordinary identifiers the words of four letters or more of
    ``documents`` documents drawn by the seed and of the names of SQL functions: alone, in capitals, in pairs as names are written in
    programs, paths and addresses, and with years, versions, dates and numbers."""
    numbers = spark.range(strings).select(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256).alias("h"))
    random_ = numbers.select(
        F.explode(
            F.array(
                F.substring("h", 1, 40),
                F.upper(F.substring("h", 1, 32)),
                F.base64(F.unhex("h")),
                F.regexp_replace(F.base64(F.unhex("h")), "[+/=]", ""),
            )
        ).alias("value"),
        F.lit(True).alias("is_random"),
    )
    chosen = (
        docs.select(F.col(id_col).alias("id"))
        .distinct()
        .orderBy(F.xxhash64(F.lit(seed), "id"), "id")
        .limit(documents)
    )
    found = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{4,}"), F.lit(0))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def ordinary_forms(words: Column) -> Column:
        def forms(w: Column, i: Column) -> Column:
            after = F.get(words, i + 1)
            digits = F.conv(F.substring(F.sha2(F.concat_ws(":", w, i), 256), 1, 12), 16, 10)
            year = F.concat(F.lit("20"), F.substring(digits, -2, 2))
            return F.array(
                w, F.upper(w), F.concat_ws("_", w, after), F.concat_ws("-", w, after),
                F.concat_ws("/", w, after), F.concat(w, F.initcap(after)),
                F.concat_ws("_", F.upper(w), F.upper(after)),
                F.concat_ws("_", w, year, after, F.concat(F.lit("v"), F.substring(digits, -1, 1))),
                F.concat_ws("-", w, F.substring(digits, -3, 2), after, year),
                F.concat(w, F.substring(digits, -4, 3)),
                F.concat_ws("-", year, F.substring(digits, -5, 2), F.substring(digits, -6, 2)),
                F.concat_ws(
                    "-", F.substring(digits, -3, 3), F.substring(digits, -4, 1),
                    F.substring(digits, -6, 2), F.substring(digits, 1, 6), F.substring(digits, 7, 1),
                ),
                digits, F.concat(F.lit("+"), digits),
            )

        return F.flatten(F.transform(words, forms))

    drawn = texts.join(F.broadcast(chosen), "id", "left_semi")  # a row per drawn document: bounded
    named = spark.sql("SHOW FUNCTIONS").select(F.col("function").alias("text"))
    ordinary = (
        drawn.select("text")
        .union(named)
        .select(found.alias("words"))
        .select(F.explode(ordinary_forms(F.col("words"))).alias("value"), F.lit(False).alias("is_random"))
        .filter("value is not null")
    )
    return random_.unionByName(ordinary)


def fit(samples: DataFrame, smoothing: float = 1.0, weight: float = 20.0) -> list[float]:
    """Log-likelihood ratios of each character after each, random over ordinary.

    First-order Markov models counted by Spark; each row of pairs is smoothed by ``weight``
    occurrences shared out as the model's single characters are, those by ``smoothing`` each. So a
    pair that neither has seen is judged by its second character. The result has one value per pair
    of characters of ``ALPHABET`` (and the start), so its size is fixed.
    """
    n = len(ALPHABET)
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    letters = F.split("value", "")
    pairs = F.transform(
        letters,
        lambda c, i: F.when(i == 0, 0).otherwise(F.instr(F.lit(ALPHABET), F.get(letters, i - 1)))
        * (n + 1)
        + code(c),
    )
    counted = (
        samples.filter(F.length("value") > 0)
        .select("is_random", F.explode(pairs).alias("pair"))
        .groupBy("is_random", "pair")
        .count()
        .collect()
    )
    pairs_of = {True: [0] * (n + 1) ** 2, False: [0] * (n + 1) ** 2}
    for row in counted:
        pairs_of[row["is_random"]][row["pair"]] += row["count"]
    logs = {}
    for kind, seen in pairs_of.items():
        single = [sum(seen[c :: n + 1]) + smoothing for c in range(n + 1)]
        share = [x / sum(single) for x in single]
        logs[kind] = [
            math.log((seen[i] + weight * share[i % (n + 1)]) / (sum(seen[i - i % (n + 1) :][: n + 1]) + weight))
            for i in range((n + 1) ** 2)
        ]
    return [a - b for a, b in zip(logs[True], logs[False], strict=True)]


def log_likelihood_ratio(value: Column, ratios: Sequence[float]) -> Column:
    """Sum over the characters of ``value``; above 0 a random string is likelier."""
    n = len(ALPHABET) + 1
    table = F.lit(list(ratios))

    def total(codes: Column) -> Column:
        return F.aggregate(
            codes,
            F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
            lambda a, c: F.struct(c.alias("last"), (a["sum"] + table[a["last"] * n + c]).alias("sum")),
            lambda a: a["sum"],
        )

    return total(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 12.0,
    per_character: float = 0.75,
    sample_documents: int = 2000,
    sample_strings: int = 1000,
    seed: int = 42,
    ratios: Sequence[float] | None = None,
) -> DataFrame:
    """All columns of ``docs`` and secret_base, secret_spans: arrays of (start, rank, end, kind,
    value), places in code points, end exclusive, by start and then kind.

    To the spans of the fixed patterns come strings of 12 or more characters of ``ALPHABET``, at
    least six of them different, whose log-likelihood ratio reaches ``threshold`` and
    ``per_character`` times their length; their kind is ``random``. Of a string that touches spans
    of the fixed patterns, each part between them is judged so by itself. ``ratios`` may hold models
    fitted before (``fit``); else they are fitted on a bounded labelled sample. Null and empty texts
    have no spans. Each row is judged alone, so repeated rows get equal results. Input columns of
    the two names are replaced; all others are kept.
    """
    if ratios is None:
        ratios = fit(
            labelled_samples(
                docs.sparkSession, docs, id_col, text_col, sample_documents, sample_strings, seed
            )
        )
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = _spans(text, "random", len(BASE), CANDIDATE, 0, LEAST)

    def part(whole: Column, start: Column, end: Column) -> Column:
        value = F.substring(whole["value"], start - whole["start"] + 1, end - start)
        return F.struct(
            start.alias("start"), whole["rank"].alias("rank"), end.alias("end"),
            whole["kind"].alias("kind"), value.alias("value"),
        )

    def uncovered(whole: Column, base: Column) -> Column:
        """The parts of a candidate between the spans that it touches."""
        touched = F.filter(base, lambda b: (whole["start"] < b["end"]) & (b["start"] < whole["end"]))
        first = F.struct(whole["start"].alias("at"), F.array().cast(SPAN).alias("out"))

        def step(done: Column, b: Column) -> Column:
            before = F.when(
                b["start"] > done["at"], F.array(part(whole, done["at"], b["start"]))
            ).otherwise(F.array().cast(SPAN))
            return F.struct(
                F.greatest(done["at"], b["end"]).alias("at"),
                F.concat(done["out"], before).alias("out"),
            )

        def last(done: Column) -> Column:
            after = F.when(
                done["at"] < whole["end"], F.array(part(whole, done["at"], whole["end"]))
            ).otherwise(F.array().cast(SPAN))
            return F.concat(done["out"], after)

        return let(
            touched,
            lambda t: F.when(F.size(t) == 0, F.array(whole)).otherwise(F.aggregate(t, first, step, last)),
        )

    def random_ones(base: Column) -> Column:
        length = lambda c: F.length(c["value"])
        return F.filter(
            F.flatten(F.transform(more, lambda c: uncovered(c, base))),
            lambda c: (length(c) >= LEAST)
            & (F.size(F.array_distinct(F.split(c["value"], ""))) >= DIFFERENT)
            & (
                log_likelihood_ratio(c["value"], ratios)
                >= F.greatest(F.lit(threshold), length(c) * per_character)
            ),
        )

    both = let(
        base_spans(text),
        lambda base: F.struct(
            base.alias("base"), F.array_sort(F.concat(base, random_ones(base))).alias("all")
        ),
    )
    # The generator keeps the optimizer from writing the whole expression twice.
    kept = [c for c in docs.columns if c not in ("secret_base", "secret_spans")]
    own = free_name("found", docs.columns)
    found = docs.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(both)).alias(own))
    return found.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(own)["base"].alias("secret_base"),
        F.col(own)["all"].alias("secret_spans"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per fixed kind, the hash of their spans and all spans as text."""

    def number(kind: str) -> Column:
        return F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(kind).alias(f"n_{kind}") for kind, *_ in BASE]
    return scanned.select(
        F.col(id_col),
        *counts,
        F.sha2(listed(F.col("secret_base")), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"),
    )


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in place of each run of spans; the columns of the scan go."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        apart = span["start"] >= done["at"]
        between = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(apart, F.concat(done["out"], between, F.lit(mark)))
            .otherwise(done["out"])
            .alias("out"),
        )

    clean = F.aggregate(
        "secret_spans", start, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))
    )
    return scanned.withColumn(
        text_col, F.when(F.size("secret_spans") > 0, clean).otherwise(text)
    ).drop("secret_base", "secret_spans")
