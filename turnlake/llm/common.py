"""Shared helpers: word splitting, seeded mixing, scratch space and chunk sizing."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space. ``bytes.split()`` splits on exactly these bytes
#: (0x20, 0x09-0x0D) and ``bytes.lower()`` folds exactly A-Z.
WORD_RE = r"[^\x20\x09-\x0D]+"

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Splitmix64 finaliser: a seeded bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= MIX_B
        x ^= x >> np.uint64(27)
        x *= MIX_C
        x ^= x >> np.uint64(31)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and Spark runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints/turnlake"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small frame with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def text_bytes(docs: DataFrame, text: str = "text", row: int = 64) -> int:
    """UTF-8 bytes of all texts and ``row`` more for each record: one pruned scan, one row to the driver."""
    return int(docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + row)).first()[0] or 0)


class BoundedCodes(dict):
    """A word-to-code table that starts afresh beyond ``limit`` entries, so long tasks stay in memory."""

    def __init__(self, digest, limit: int = 400_000):
        super().__init__()
        self.digest, self.limit = digest, limit

    def __missing__(self, word: bytes) -> int:
        self[word] = code = self.digest(word)
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of every run of ``width`` codes, finalised by ``mix64``."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for j in range(width):
            acc *= MIX_A
            acc += codes[j : j + n]
    return mix64(acc)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
