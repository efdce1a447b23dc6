"""HMAC-SHA256 in built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256_hex(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text column.

    The key's two pads become literals of the plan, so read the key from a secret at run time and
    set ``spark.sql.redaction.string.regex`` where plans or event logs are kept.
    """
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def signed_pair(first: Column, second: Column) -> Column:
    """The signed text of a payment: two ids with a bar between them."""
    return F.concat(first.cast("string"), F.lit("|"), second.cast("string"))
