"""Two-pass external shuffle.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded hash of id and text. Pass 2 takes each
bucket into memory, puts it in an order that doesn't depend on arrival, and Fisher-Yates shuffles it with a generator
seeded by (seed, bucket). The buckets one after another are a uniform shuffle of the whole table; position g of it goes
to shard ``g % shards`` as slot ``g // shards``, so that shard counts are at most one apart and slots have no gaps.

Bucket counts are added up in groups of 1024 buckets; only the sums of these groups (one row for each 16 GB) meet in one
place, to turn bucket positions into global ones.

Defined cases: a null text has no bytes (size 1, checksum 0); repeated rows are separate records; null ids stay null, and
ids of any size are kept as they are; a table of tiny texts still makes buckets of a bounded number of rows; an empty table gives empty shards. Further columns travel with their record; those that would clash with the
columns added here are not carried by ``shuffled`` (it takes the columns to carry by name).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, text_bytes


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n): position i swaps with a uniform one of 0..i, from the end."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    picks = rng.integers(0, np.arange(1, n + 1)) if n else np.empty(0, np.int64)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """The records (id, text and ``carry``) with bucket and pos, the place in their bucket after its shuffle."""
    n_buckets = max(1, -(-text_bytes(docs, text_col) // bucket_bytes))
    columns = [id_col, text_col, *[c for c in carry if c not in (id_col, text_col, "bucket", "pos")]]
    fields = [docs.schema[c] for c in columns]
    scattered = docs.select(*columns).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(n_buckets)).cast("int"))

    def run(key: tuple, part: pa.Table) -> pa.Table:
        # An order that depends on the records alone; equal ids are told apart by all that is carried.
        ids = part.column(id_col)
        if len(ids.unique()) < len(ids):
            rows = list(zip(*[map(str, part.column(c).to_pylist()) for c in columns], strict=True))
            order = np.array(sorted(range(len(rows)), key=rows.__getitem__), np.int64)
        else:
            order = np.asarray(pc.sort_indices(ids))
        part = part.take(pa.array(order[fisher_yates(len(part), seed, key[0].as_py())]))
        return part.append_column("pos", pa.array(np.arange(len(part), dtype=np.int64)))

    schema = T.StructType([*fields, T.StructField("bucket", T.IntegerType()), T.StructField("pos", T.LongType())])
    return scattered.groupBy("bucket").applyInArrow(run, schema)


def placed(records: DataFrame, shards: int = 8) -> DataFrame:
    """Adds shard and slot to records that have bucket and pos."""
    counts = settle(records.groupBy("bucket").agg(F.count("*").alias("held")))
    # Running sums in two steps: within groups of buckets, and over the groups.
    group = F.floor(F.col("bucket") / 1024).alias("part")
    inside = F.sum("held").over(Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    parts = counts.groupBy(group).agg(F.sum("held").alias("all"))
    before = parts.withColumn("before", F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    offsets = settle(counts.withColumn("part", group).withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "part").select("bucket", (F.col("inside") + F.col("before")).alias("base")))
    at = F.col("base") + F.col("pos")
    return records.join(offsets, "bucket").withColumn("shard", F.pmod(at, F.lit(shards)).cast("int")).withColumn("slot", F.floor(at / shards).cast("long")).drop("base")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), seed: int = 17, file_rows: int = 200_000) -> None:
    """Write the shuffled records as ``path/shard=N``: files of ``file_rows`` slots, each in slot order, a task a file."""
    records = settle(shuffled(docs, id_col, text_col, carry, seed))
    cut = placed(records, shards).drop("bucket", "pos").withColumn("__file", F.floor(F.col("slot") / file_rows))
    files = shards * max(1, -(-records.count() // (shards * file_rows)))
    cut.repartitionByRange(files, "shard", "__file").sortWithinPartitions("shard", "slot").drop("__file").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record after the shuffle of whole records."""
    bytes_of = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    records = settle(shuffled(docs, id_col, text_col, (), seed).select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(bytes_of) + 1).cast("long").alias("size"), F.crc32(bytes_of).cast("long").alias("text_crc32"), "bucket", "pos"))
    return placed(records, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
