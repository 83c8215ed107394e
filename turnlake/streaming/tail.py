"""Growing transcripts as a stream: each line once, in order of file and offset, never past an unfinished last line.

The offset of the stream is how far each file was read, and a checksum of its first bytes. The driver asks for sizes and
looks back from a file's end for its last line break; the bytes between two offsets are read on executors, a partition a
file, from where the last reading stopped. A file that shrank, or whose beginning changed, is read from its start again;
whoever writes the stream to an archive drops records it has (``into``), so reading again is harmless, after a crash too.

The folder must be one that driver and executors see under the same path.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .. import schema as S
from ..operators.archive import first_records, new_records
from ..sources import decode, transcripts
from ..sources.transcripts import split_lines

SCHEMA = "path string, off long, len int, raw string"
HEAD = 256
BLOCK = 1 << 16


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


def head_sum(path: str, size: int) -> int:
    """Checksum of the first bytes of a file, of at most ``size``."""
    with open(path, "rb") as f:
        return zlib.crc32(f.read(min(size, HEAD)))


def whole_lines(path: str, start: int, size: int) -> int:
    """Where the last whole line between two places ends; ``start`` if there is none."""
    with open(path, "rb") as f:
        stop = size
        while stop > start:
            begin = max(start, stop - BLOCK)
            f.seek(begin)
            at = f.read(stop - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            stop = begin
    return start


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root
        self.known: dict[str, list[int]] = {}  # what was last reported, to look only at what grew

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[str]:
        return sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if n.endswith(".jsonl"))

    def latestOffset(self) -> dict:
        """{path: [end of whole lines, checksum of the beginning]}"""
        out: dict[str, list[int]] = {}
        for path in self._files():
            try:
                size = os.path.getsize(path)
                had = self.known.get(path, [0, 0])
                same = had[0] <= size and head_sum(path, had[0]) == had[1]
                end = whole_lines(path, had[0] if same else 0, size)
                out[path] = [end, head_sum(path, end)]
            except OSError:  # gone since it was listed
                continue
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        ranges = []
        for path, (stop, _) in sorted(end.items()):
            at, head = start.get(path, [0, 0])
            # What was read before still begins the file: go on from there; else it is another file.
            again = at > stop or (at > 0 and head_sum(path, at) != head)
            if again or at < stop:
                ranges.append(_Range(path, 0 if again else at, stop))
        return ranges

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            content = f.read(partition.stop - partition.start)
        for o, n, raw in split_lines(content, 0):
            yield partition.path, partition.start + o, n, raw.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class TranscriptTail(DataSource):
    """``spark.readStream.format("transcript_tail").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


def tail(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TranscriptTail)
    return spark.readStream.format("transcript_tail").load(root)


def with_identity(batch: DataFrame) -> DataFrame:
    """Lines of the second provider with the identity records that stand before them in their files.

    Those are read from the files that grew; records of an earlier batch other than they are not decoded again.
    """
    first = {r["path"]: r["off"] for r in batch.groupBy("path").agg(F.min("off").alias("off")).where("off > 0").collect()}  # files that grew
    if not first:
        return batch
    spark = batch.sparkSession
    earlier = transcripts.lines(transcripts.opened(spark, sorted(first)))
    plain = F.regexp_replace("path", "^file:/*", "/")
    begin = spark.createDataFrame(sorted(first.items()), "of string, begin long")
    heads = earlier.where(decode.field(F.col("raw"), "type") == "session_meta").withColumn("path", plain).join(begin, F.col("path") == F.col("of")).where(F.col("off") < F.col("begin"))
    return batch.unionByName(heads.select(*batch.columns))


def into(lines: DataFrame, folder: str, checkpoint: str, provider: str = "claude-code"):
    """Write the turns of a stream of lines to ``folder``, partitioned by tier, each record once."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if provider == "codex":
            batch = with_identity(batch.where(transcripts.is_codex(F.col("path"))))
        turns = first_records(decode.PROVIDERS[provider](batch))
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        held = spark.read.schema(f"{S.TURN.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, batch long").parquet(folder).where(F.col("batch") != number) if there else None
        fresh = new_records(turns, held).select(*S.TURN_COLUMNS).withColumn("batch", F.lit(number).cast("long"))
        # A batch that is run again after a crash overwrites its own partition.
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "tier").parquet(folder)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
