"""Hashes of the canonical text form of a value, as native expressions.

The canonical form is ``cast(value as string)`` in UTC.  Null gives null throughout."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = {"sha256": 64, "sha1": 64, "md5": 64, "sha512": 128}


def canonical(c: Column) -> Column:
    return c.cast("string")


def digest(data: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hex of a string or binary column."""
    if algorithm == "sha256":
        return F.sha2(data, 256)
    if algorithm == "sha512":
        return F.sha2(data, 512)
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm == "md5":
        return F.md5(data)
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def seeded(c: Column, seed: object, algorithm: str = "sha256") -> Column:
    """The digest of ``seed:value``."""
    return digest(F.concat(F.lit(f"{seed}:"), canonical(c)), algorithm)


def number(hexa: Column, start: int = 1, digits: int = 8) -> Column:
    """``digits`` hex digits, 15 at most, as a bigint."""
    return F.conv(F.substring(hexa, start, digits), 16, 10).cast("bigint")


def pick(c: Column, seed: object, values: list[str], salt: str = "") -> Column:
    """One of ``values``, the same for the same seed and value."""
    n = number(seeded(c, f"{seed}{salt}")) % len(values)
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def pads(key: bytes, algorithm: str = "sha256") -> tuple[bytes, bytes]:
    """The inner and the outer pad of an HMAC key."""
    size = BLOCK[algorithm]
    key = (hashlib.new(algorithm, key).digest() if len(key) > size else key).ljust(size, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac(c: Column, key: bytes, algorithm: str = "sha256") -> Column:
    """HMAC of the value in hex, from two digests: the pads are worked out once, on the driver.

    The pads are literals of the plan and show in ``explain``: whoever sees plans sees them."""
    inner, outer = pads(key, algorithm)
    first = F.unhex(digest(F.concat(F.lit(inner), canonical(c).cast("binary")), algorithm))
    return digest(F.concat(F.lit(outer), first), algorithm)
