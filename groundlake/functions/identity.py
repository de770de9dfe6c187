"""Anonymous identities and fingerprints of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Lower-case hex of HMAC-SHA-256, from two native hashes."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def _opaque(prefix: str, secret: bytes, identifier: Column, alias: Column) -> Column:
    clean = F.trim(identifier)
    digest = F.concat(F.lit(prefix), F.upper(F.substring(hmac_sha256(secret, clean), 1, 8)))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(None)).when(alias, clean).otherwise(digest)


def anonymous_user_id(secret: bytes, identifier: Column) -> Column:
    """ID1: USER- and 8 hex digits; short USER-n aliases stay; blank is null."""
    return _opaque("USER-", secret, identifier, F.trim(identifier).rlike(r"^USER-[0-9]{1,3}$"))


def anonymous_session_id(secret: bytes, identifier: Column) -> Column:
    """ID2: SES- and 8 hex digits; short SES-... aliases stay; blank is null."""
    clean = F.trim(identifier)
    return _opaque("SES-", secret, identifier, clean.startswith("SES-") & (F.length(clean) <= 12))


def content_hash(content: Column) -> Column:
    """ID3."""
    return F.sha2(content, 256)


def collection_fingerprint(ids: Column) -> list[Column]:
    """ID4 for tables of any size: a count and an order-free sum of 60 bits of each id's SHA-256 (as text), both by partial aggregation."""
    bits = F.conv(F.substring(F.sha2(ids.cast("string"), 256), 1, 15), 16, 10)
    return [F.count(ids).alias("n"), F.sum(bits.cast("decimal(20,0)")).cast("string").alias("hash_sum")]
