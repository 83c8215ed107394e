"""Transcript files: listing, and lines with the byte offsets they start at.

Files are read by Spark's ``binaryFile`` source, so any file system Spark reaches will do; the listing prunes contents.
A file is one row, so it must be under 2 GB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THREAD = r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?:_[^/]*)?\.jsonl$"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content) of everything under a root; take what you need of it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def opened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, mtime, content) of these files and no others."""
    if not paths:
        return spark.createDataFrame([], "path string, size long, mtime timestamp, content binary")
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]  # names, not patterns
    found = spark.read.format("binaryFile").load(plain)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def is_claude(path: Column) -> Column:
    return F.endswith(path, F.lit(".jsonl"))


def is_codex(path: Column) -> Column:
    return F.rlike(path, F.lit(r"/rollout-[^/]*\.jsonl$"))


def is_compressed(path: Column) -> Column:
    """Counted and declared, not read."""
    return F.rlike(path, F.lit(r"/rollout-[^/]*\.jsonl\.zst$"))


def stat(found: DataFrame) -> DataFrame:
    """live_from, live_files and compressed_files of a listing."""
    return found.agg(F.min("mtime").alias("live_from"), F.count_if(is_claude(F.col("path"))).alias("live_files"), F.count_if(is_compressed(F.col("path"))).alias("compressed_files"))


def split_lines(content: bytes, start: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, line) of lines that aren't blank, ends of line taken off; the last may be unterminated."""
    at = start
    while at < len(content):
        end = content.find(b"\n", at)
        stop = len(content) if end < 0 else end
        line = content[at:stop].removesuffix(b"\r")
        if line.strip():
            yield at, stop - at, line
        at = stop + 1


def lines(found: DataFrame, start: Column | None = None) -> DataFrame:
    """(path, off, len, raw) of all lines from ``start`` (a byte offset, zero by default) on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = split_lines(content or b"", at or 0)
                while part := list(islice(rows, 5000)):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2].decode("utf-8", "replace") for r in part])], names=["path", "off", "len", "raw"])

    return found.select("path", "content", (start if start is not None else F.lit(0)).cast("long").alias("start")).mapInArrow(run, "path string, off long, len int, raw string")


def plausible(raw: Column) -> Column:
    """The lenient test of a record: an object by its braces."""
    return F.startswith(F.trim(raw), F.lit("{")) & F.endswith(F.trim(raw), F.lit("}"))


def marks(found: DataFrame, read: DataFrame) -> DataFrame:
    """(path, mark): where the next reading of a file starts: its end, or before a last line that isn't a whole record."""
    last = read.groupBy("path").agg(F.max_by(F.struct("off", plausible(F.col("raw")).alias("ok")), "off").alias("last"))
    return found.select("path", "size").join(last, "path", "left").select("path", F.when(F.col("last.ok") == F.lit(False), F.col("last.off")).otherwise(F.col("size")).alias("mark"))
