"""Identities and hashes as Spark columns."""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of the hashing embedder.
DIMENSIONS = 256


def repo_id(url: Column, branch: Column) -> Column:
    """A readable slug of the address and eight digits of a hash of address and branch."""
    bare = F.rtrim(F.regexp_replace(url, "^https?://", ""), F.lit("/"))
    slug = F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    digest = F.sha1(F.concat(url, F.lit("|"), F.coalesce(branch, F.lit("default"))))
    return F.concat(F.lower(F.substring(slug, 1, 32)), F.lit("-"), F.substring(digest, 1, 8))


def chunk_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(repo: Column, path: Column, start: Column, end: Column, digest: Column) -> Column:
    place = F.concat_ws("-", start.cast("string"), end.cast("string"))
    return F.concat_ws(":", repo, path, place, F.substring(digest, 1, 10))


def bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """Bucket of a token: the first four bytes of its SHA-256, big-endian, modulo ``dimensions``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def sign(token: Column) -> Column:
    """1 or -1 by the parity of the fifth byte of its SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


@lru_cache(1 << 17)
def placed(token: str, dimensions: int = DIMENSIONS) -> tuple[int, int]:
    """``bucket`` and ``sign`` of one token, for work inside Arrow batches."""
    digest = sha256(token.encode()).digest()
    return int.from_bytes(digest[:4], "big") % dimensions, 1 if digest[4] % 2 == 0 else -1
