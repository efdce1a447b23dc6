"""Ratcliff-Obershelp similarity of headers to aliases."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

MATCH_TYPE = "array<struct<field:string,score:double,alias_pos:int>>"


def matchers(aliases: dict[str, list[str]]) -> dict[str, list[SequenceMatcher]]:
    """One matcher per alias; the alias is the second text, whose index is built only once."""
    return {
        field: [SequenceMatcher(None, "", name.lower().strip()) for name in names]
        for field, names in aliases.items()
    }


def best_aliases(
    header: str, prepared: dict[str, list[SequenceMatcher]]
) -> list[tuple[str, float, int]]:
    """For each field the score and place of the alias closest to a normalised header.

    The header is the first text: the ratio is not symmetric. The first of equal aliases wins. The
    quick ratios are upper bounds, so an alias that cannot beat the best so far is not matched.
    """
    found = []
    for field, candidates in prepared.items():
        best, place = 0.0, 0
        for i, matcher in enumerate(candidates):
            matcher.set_seq1(header)
            if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                score = matcher.ratio()
                if score > best:
                    best, place = score, i
        found.append((field, best, place))
    return found


def alias_matcher(aliases: dict[str, list[str]]):
    """A pandas UDF giving :func:`best_aliases` of a column of normalised headers."""

    @F.pandas_udf(MATCH_TYPE)
    def match(headers: pd.Series) -> pd.Series:
        prepared = matchers(aliases)
        return headers.map(
            lambda h: [
                {"field": f, "score": s, "alias_pos": p} for f, s, p in best_aliases(h, prepared)
            ],
            na_action="ignore",
        )

    return match
