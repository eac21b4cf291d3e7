"""What the training-data operators share: scratch tables, word rules, hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six ASCII blanks.  ``bytes.split()``
#: cuts at exactly the same six, so Python code splits the UTF-8 form.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"

NULL_DOC = 2**63 - 1  # stands for a null doc_id where ids are ordered: after all others


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests on a local master) is a temporary folder made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and what was
    written outlives any executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(doc_id, n: int):
    """crc32 of the decimal text of doc_id, modulo n (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept up to a bound so that memory is, too."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(text: str | None) -> bytes:
    """UTF-8; a lone surrogate, which Parquet text cannot hold, would be replaced."""
    return b"" if text is None else text.encode("utf-8", "replace")


def scan(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(texts, most: int = 4_000_000):
    """Slices of about ``most`` characters, so that memory doesn't follow the batch."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total > most:
            yield at, texts[at : i + 1]
            at, total = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


#: Random odd numbers for bytes, so that hashes of runs of bytes don't depend on their numeric values.
BYTE_CODES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_power_tables: dict = {}


def _powers(n: int):
    if _power_tables.get("n", 0) < n:
        one = np.ones(1, np.uint64)
        inverse = np.uint64(pow(_BASE, -1, 2**64))
        _power_tables["up"] = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        _power_tables["down"] = np.cumprod(np.concatenate([one, np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        _power_tables["n"] = n
    return _power_tables["up"], _power_tables["down"]


class Prefix:
    """Hashes of any run of tokens from prefix sums modulo 2^64."""

    def __init__(self, v: np.ndarray):
        up, self.down = _powers(max(len(v), 4096))
        self.sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * up[: len(v)], out=self.sums[1:])

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of tokens a..b-1, for arrays of a and b; the length is part of the hash."""
        return mix64((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))
