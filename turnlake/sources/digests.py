"""Digests of files that are too large for one task.

Spark's ``binaryFile`` source reads a file as one row; its text source reads splits, on any file system Spark reaches,
and hands over the bytes of a line as they are. A file is cut into *pieces* by its content alone: a piece ends with a line
whose CRC-32, end of line included, is a multiple of ``LINES``, so pieces are the same however the file was split. The
digest is the SHA-256 of the pieces' SHA-256s in order, written after ``MARK``; a last line without an end counts as one
with it (its file's size differs).

A line is one row: a file that has no line feed for 2 GB can't be read, and one without any isn't split. Nor can one that
begins with a byte order mark, which the text source takes off; Parquet files begin otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# They decide the digests that manifests hold.
MARK = "pieces:"
LINES = 256

#: Files up to this size are read as one row, and have a plain SHA-256.
WHOLE = 64 << 20
#: Bytes that a row of parts holds, give or take a batch of lines.
MOST = 1 << 20

GOES_ON, ENDS, DIGESTS = range(3)
PARTS = "at string, start long, part long, kind int, read long, data binary"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of each split, in order, of lines (at, start, ends, raw): digests of its pieces; but as they are the bytes of
    the first, which may have begun in the split before, and of the last, which may end in the next."""
    key: tuple[str, int] | None = None
    part, began, read = 0, False, 0
    piece, made = bytearray(), bytearray()

    def row(kind: int, size: int, data: bytearray) -> pa.RecordBatch:
        nonlocal part
        part += 1
        out = pa.RecordBatch.from_pydict({"at": [key[0]], "start": [key[1]], "part": [part], "kind": pa.array([kind], pa.int32()), "read": [size], "data": [bytes(data)]})
        data.clear()
        return out

    def sent(kind: int | None = None) -> Iterator[pa.RecordBatch]:
        nonlocal read
        if made:
            yield row(DIGESTS, read, made)
            read = 0
        if piece and kind is not None:
            yield row(kind, len(piece), piece)

    for batch in batches:
        if not batch.num_rows:
            continue
        at, start, ends, raw = batch.columns
        raw = raw.cast(pa.large_binary())
        edge = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = memoryview(raw.buffers()[2])
        other = (np.diff(start.to_numpy()) != 0) | pc.not_equal(at.slice(1), at.slice(0, len(at) - 1)).to_numpy(zero_copy_only=False)
        closed = np.flatnonzero(ends.to_numpy(zero_copy_only=False)) + 1
        for first, stop in pairwise([0, *(np.flatnonzero(other) + 1).tolist(), len(at)]):
            now = at[first].as_py(), start[first].as_py()
            if now != key:
                yield from sent(GOES_ON)
                key, began = now, False
            for end in closed[(closed > first) & (closed <= stop)].tolist():
                piece += data[edge[first] : edge[end]]
                first = end
                if not began:
                    yield from sent(ENDS)
                    began = True
                    continue
                made += hashlib.sha256(piece).digest()
                read += len(piece)
                piece.clear()
                if len(made) > MOST:
                    yield from sent()
            piece += data[edge[first] : edge[stop]]
            if len(piece) > MOST:
                yield from sent(GOES_ON)
                began = False
    yield from sent(GOES_ON)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, read, sha256) of each file, from its parts in order."""
    now, read, top, piece, open_ = None, 0, hashlib.sha256(), hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        if open_:
            top.update(piece.digest())
        return pa.RecordBatch.from_pydict({"at": [now], "read": [read], "sha256": [MARK + top.hexdigest()]})

    for batch in batches:
        for at, kind, size, data in zip(*[batch.column(c).to_pylist() for c in ("at", "kind", "read", "data")], strict=True):
            if at != now:
                if now is not None:
                    yield row()
                now, read, top, piece, open_ = at, 0, hashlib.sha256(), hashlib.sha256(), False
            read += size
            if kind == DIGESTS:
                top.update(data)
                continue
            piece.update(data)
            open_ = kind == GOES_ON
            if kind == ENDS:
                top.update(piece.digest())
                piece = hashlib.sha256()
    if now is not None:
        yield row()


def of_large(spark: SparkSession, folder: str, above: int, names: str) -> DataFrame:
    """(at, read, sha256) of the files in a folder with more than ``above`` bytes; ``read`` is how many could be read, or
    one more where the last line has no end."""
    lines = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(folder).where(F.col("_metadata.file_size") > above)
    raw = F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n")))
    parts = lines.select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("start"), raw.alias("raw")).select("at", "start", (F.crc32("raw") % LINES == 0).alias("ends"), "raw").mapInArrow(cut, PARTS)
    return parts.repartition("at").sortWithinPartitions("at", "start", "part").mapInArrow(joined, "at string, read long, sha256 string")
