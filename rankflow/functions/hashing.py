"""Digests as numbers: bytes of SHA-1 or MD5 read in little-endian order, as column expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BUCKETS = 1_000_003
_PRIME = 16_777_619


def little_endian(hex_digest: Column, n_bytes: int) -> Column:
    """The first bytes of a hex digest as an unsigned number, ``decimal(20,0)``."""
    turned = F.concat(*(F.substring(hex_digest, 2 * k + 1, 2) for k in range(n_bytes - 1, -1, -1)))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def sha1_64(value: Column) -> Column:
    return little_endian(F.sha1(value.cast("binary")), 8)


def md5_64(value: Column) -> Column:
    return little_endian(F.md5(value.cast("binary")), 8)


def _mod(number: Column, n: int) -> Column:
    return (number % F.lit(n).cast("decimal(20,0)")).cast("long")


def partition(value: Column, n: int = 32) -> Column:
    return _mod(sha1_64(value), n)


def bucket(value: Column, n: int = BUCKETS) -> Column:
    """1 to ``n``; 0 for null or empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(0).cast("long")).otherwise(_mod(sha1_64(value), n) + 1)


def md5_16(value: Column) -> Column:
    return little_endian(F.md5(value.cast("binary")), 2).cast("long")


def md5_32(value: Column) -> Column:
    return little_endian(F.md5(value.cast("binary")), 4).cast("long")


def namespaced(namespace: str, value: Column, n: int) -> Column:
    """1 to ``n - 1`` by MD5 of ``namespace:value``; 0 is kept for missing values."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(_mod(md5_64(F.concat(F.lit(namespace + ":"), text)), n - 1) + 1)


def query_key(normalized: Column) -> Column:
    """The first 20 hex digits of SHA-1."""
    return F.substring(F.sha1(normalized.cast("binary")), 1, 20)


def crossed(token: Column, region: Column, n: int) -> Column:
    """A token's number times a prime, exclusive-or a region, modulo ``n``."""
    return F.pmod((token * _PRIME).bitwiseXOR(region), F.lit(n))


def request_priority(*parts: Column) -> Column:
    """Order key of a request among its week's: SHA-1 of its parts between unit separators."""
    return F.sha1(F.concat_ws("\x1f", *(p.cast("string") for p in parts)).cast("binary"))


@F.pandas_udf(LongType())
def blake2b_64(values: pd.Series) -> pd.Series:
    """BLAKE2b with an 8-byte digest, little-endian, as a signed number; there is no built-in."""
    return values.map(lambda v: None if v is None else int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=8).digest(), "little", signed=True))


def sampled(value: Column, salt: str, share: float) -> Column:
    """Whether a row is in a deterministic sample of about ``share``, by a keyed 64-bit hash."""
    top = blake2b_64(F.concat(F.lit(salt + ":"), value.cast("string")))
    return F.shiftrightunsigned(top, 11) < F.lit(int(share * (1 << 53)))


def categorical(value: Column, n: int) -> Column:
    """1 to ``n`` by BLAKE2b; 0 for null or empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.pmod(F.shiftrightunsigned(blake2b_64(text), 1), F.lit(n)) + 1)


@F.pandas_udf(LongType())
def cross_64(a: pd.Series, b: pd.Series) -> pd.Series:
    """A 64-bit product of two numbers with odd constants, exclusive-or'd, wrapping around."""
    x, y = a.to_numpy(dtype=np.int64).view(np.uint64), b.to_numpy(dtype=np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F))
    return pd.Series(mixed.view(np.int64))
