"""Row keys and the seeded hashes that order samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Significant bits of each hash kind; bucket numbers are taken from the top of them.
HASH_BITS = {"xxhash64": 64, "md5": 60}


def stable_key(key_cols: Sequence[str], fallback_cols: Sequence[str] | None = None) -> Column:
    """Text key of a row.

    One column is used as it is, several are joined with ``|``. ``fallback_cols`` stand in
    where a single key is null. Naming the columns keeps the scan pruned to them.
    """
    if len(key_cols) > 1:
        return F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    key = F.col(key_cols[0]).cast("string")
    if fallback_cols:
        key = F.coalesce(key, F.concat_ws("|", *[F.col(c).cast("string") for c in fallback_cols]))
    return key


def seeded_hash(key: Column, seed: int = 42, kind: str = "xxhash64") -> Column:
    """Signed 64-bit hash of ``key`` under ``seed``; never null, a null key counts as empty text.

    ``xxhash64`` hashes the key and an INT seed. ``md5`` keeps the top 60 bits of the digest
    of ``key|seed``, which other SQL engines can compute too.
    """
    if kind == "xxhash64":
        return F.xxhash64(key, F.lit(seed))
    if kind == "md5":
        digest = F.md5(F.concat(F.coalesce(key, F.lit("")), F.lit(f"|{seed}")))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    raise ValueError(f"unknown hash kind {kind!r}")


def hash_bucket(value: Column, bits: int, kind: str = "xxhash64") -> Column:
    """Top ``bits`` bits of a hash; the order of buckets follows the order of hashes."""
    return F.shiftright(value, HASH_BITS[kind] - bits)
