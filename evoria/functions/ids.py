"""Deterministic ids as SQL expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The engine's own name space for version-5 UUIDs; callers may give another.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "evoria")
SEPARATOR = "\x1f"


def uuid5(*parts: Column | str, namespace: uuid.UUID = NAMESPACE) -> Column:
    """RFC 4122 version 5 of the parts joined by U+001F; null parts are left out. No UDF."""
    name = F.concat_ws(SEPARATOR, *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def short_hash(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, length)


def table_fingerprint(columns: list[str]) -> list[Column]:
    """Order-insensitive content hash: row count, and two sums over row hashes (aggregate them over a table)."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    row = F.sha2(F.concat_ws(SEPARATOR, *shown).cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("long"))
    return [F.count(F.lit(1)).alias("n"), part(1).alias("low"), part(9).alias("high")]
