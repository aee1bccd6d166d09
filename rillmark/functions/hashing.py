"""Hashes and identifiers as Catalyst expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_index(token: Column) -> Column:
    """The first four bytes of a token's SHA-256, as an unsigned number."""
    return F.conv(F.substring(F.sha2(token.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID of RFC 4122, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(fragment_id: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat(fragment_id, F.lit(":"), chunk_index.cast("string")))


def embedding_parts(token: Column, dimension: int) -> tuple[Column, Column]:
    """Bucket and signed weight of a token in the hash embedding."""
    h = F.sha2(token.cast("binary"), 256)
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % max(32, dimension)
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return bucket, sign * (1 + F.conv(F.substring(h, 11, 2), 16, 10).cast("double") / 255.0)


def fingerprint12(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 12)


def canonical_key(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON, sorted by name, nulls kept."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(body.cast("binary"), 256)
