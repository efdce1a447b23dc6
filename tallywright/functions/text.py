"""Text helpers for headers and stored model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Drop white space of any kind on both ends (SQL ``trim`` drops blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_header(header: Column) -> Column:
    """A header as it is compared: lower case, no outer white space."""
    return F.lower(strip(header))


def clean_reply(raw: Column) -> Column:
    """A model reply without the code fence it may be wrapped in."""
    opened = F.regexp_replace(F.regexp_replace(strip(raw), r"^```json", ""), r"^```", "")
    return strip(F.regexp_replace(opened, r"```$", ""))
