"""The archive of turns: incremental ingest, deduplication, atomic commits, coverage and integrity.

An archive is a folder of batches, each partitioned by tier, and a pointer file that names the state in force: which
batches belong to it and how far each transcript was read. A commit writes its batch and state first and swaps the
pointer last, so a crash leaves the old state; what it had written is never read. Reading again from an earlier mark is
harmless, because records are kept once for each (session, uuid).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import parse_ts
from ..plans.errors import UsageError
from ..sources import decode, digests, repos, transcripts

STATE = "path string, size long, mtime timestamp, mark long, oldest timestamp"
POINTER = "_current.json"
FORMAT = 1


# --- pure operators


def ingest_plan(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(path, size, mtime, action, start): whole, resume or skip, by what is known of a file."""
    known = state.select("path", F.col("size").alias("size0"), F.col("mtime").alias("mtime0"), F.col("mark").alias("mark0"))
    joined = listing.select("path", "size", "mtime").join(known, "path", "left")
    action = F.when(F.col("size0").isNull(), "whole").when(F.col("size") < F.col("size0"), "whole").when(F.col("size") > F.col("size0"), "resume").when(F.col("mtime") == F.col("mtime0"), "skip").otherwise("whole")
    return joined.select("path", "size", "mtime", action.alias("action")).join(known.select("path", "mark0"), "path", "left").select("path", "size", "mtime", "action", F.when(F.col("action") == "resume", F.col("mark0")).when(F.col("action") == "skip", F.col("mark0")).otherwise(F.lit(0)).cast("long").alias("start"))


def first_records(turns: DataFrame) -> DataFrame:
    """Turns of the first record of each (session, uuid), in the order of path and offset; no uuid, no deduplication.

    The first place is an aggregate, not a ranking, so a key that is everywhere costs no task more than the others.
    """
    named, plain = turns.where("uuid <> ''"), turns.where("uuid = ''")
    first = named.groupBy("session", "uuid").agg(F.min(F.struct("path", "off")).alias("at"))
    kept = named.join(first, ["session", "uuid"]).where((F.col("path") == F.col("at.path")) & (F.col("off") == F.col("at.off"))).drop("at")
    return kept.select(*turns.columns).unionByName(plain)


def collapsed(turns: DataFrame) -> int:
    """How many records were sightings of one met before."""
    sightings = turns.where("uuid <> ''").select("session", "uuid", "path", "off").distinct().groupBy("session", "uuid").count()
    return int(sightings.agg(F.sum(F.col("count") - 1)).first()[0] or 0)


def new_records(turns: DataFrame, archived: DataFrame | None) -> DataFrame:
    """Turns that aren't archived: by session and uuid; those without a uuid by all they hold."""
    if archived is None:
        return turns
    named = turns.where("uuid <> ''").join(archived.where("uuid <> ''").select("session", "uuid"), ["session", "uuid"], "left_anti")
    held = archived.where("uuid = ''").select(*S.TURN_COLUMNS)
    plain = turns.where("uuid = ''").join(held, S.TURN_COLUMNS, "left_anti")
    return named.select(*turns.columns).unionByName(plain.select(*turns.columns))


def distinct_rows(turns: DataFrame) -> DataFrame:
    return turns.dropDuplicates(S.TURN_COLUMNS)


def total_order() -> list[str]:
    return ["ts", "session", "uuid", "seq", "tier", "author", "agent", "repo", "branch", "cwd", "text"]


def bounds(turns: DataFrame) -> DataFrame:
    """content_from, content_to, turns, sessions of what an archive holds."""
    at = parse_ts(F.col("ts"))
    return turns.agg(F.min(at).alias("content_from"), F.max(at).alias("content_to"), F.count("*").alias("turns"), F.count_distinct("session").alias("sessions"))


def skew(state: DataFrame) -> DataFrame:
    """(path, seconds) of the file whose age differs most from its content's; ties go to the first path."""
    gap = (F.unix_timestamp("mtime") - F.unix_timestamp("oldest")).alias("seconds")
    return state.where("oldest IS NOT NULL").select("path", gap).orderBy(F.desc("seconds"), "path").limit(1)


def widen(parts: DataFrame) -> DataFrame:
    """Coverage of several stores as one: outer bounds, sums, and the widest skew."""
    first, last = (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c))
    return parts.agg(first("content_from"), last("content_to"), F.sum("turns").alias("turns"), F.sum("sessions").alias("sessions"), first("live_from"), F.sum("live_files").alias("live_files"), last("skew_days"))


COVERAGE = "content_from timestamp, content_to timestamp, turns long, sessions long, live_from timestamp, live_files long, skew_days long"


def widened(stores: list[dict]) -> dict:
    """``widen`` of the coverage of a few stores."""
    if len(stores) == 1:
        return stores[0]
    spark = SparkSession.active()
    names = [c.split()[0] for c in COVERAGE.split(", ")]
    return widen(spark.createDataFrame([tuple(s[n] for n in names) for s in stores], COVERAGE)).first().asDict()


def manifest(spark: SparkSession, folder: str, whole: int | None = None) -> DataFrame:
    """(path, size, sha256) of the data files in a folder that can be read.

    Those of more than ``whole`` bytes are read in splits by many tasks, and have a digest of pieces.
    """
    whole = digests.WHOLE if whole is None else whole
    found = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    size = F.col("length").alias("size")
    small = found.where(F.col("length") <= whole).select("path", size, F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > whole).select("path", size, F.col("_metadata.file_path").alias("at"))
    held = large.join(digests.of_large(spark, folder, whole, "*.parquet"), "at").where("read BETWEEN size AND size + 1")
    return small.unionByName(held.select("path", "size", "sha256"))


def read_whole(expected: DataFrame) -> int:
    """Up to which size a manifest's files were read whole; those made before there were digests of pieces have no others."""
    plain = expected.where(~F.startswith("sha256", F.lit(digests.MARK))).agg(F.max("size")).first()[0]
    return max(plain or 0, digests.WHOLE)


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, turns) of the data files in a folder that can be read."""
    held = spark.read.option("ignoreCorruptFiles", "true").schema(S.TURN).parquet(folder)
    return held.groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("turns"))


def problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem) where files are missing, unknown, or not as they were written."""
    joined = expected.alias("e").join(actual.alias("a"), F.col("e.path") == F.col("a.path"), "full_outer")
    what = F.when(F.col("a.path").isNull(), "missing").when(F.col("e.path").isNull(), "unknown").when(F.col("a.size") != F.col("e.size"), "size").when(F.col("a.sha256") != F.col("e.sha256"), "checksum")
    if "turns" in expected.columns and "turns" in actual.columns:
        what = what.when(~F.col("a.turns").eqNullSafe(F.col("e.turns")), "turns")
    return joined.select(F.coalesce("e.path", "a.path").alias("path"), what.alias("problem")).where("problem IS NOT NULL")


# --- the store


@dataclass
class Update:
    """What an ingest did."""

    wrote: bool
    files: int = 0
    records_collapsed: int = 0
    turns: int = 0
    notes: list[str] = field(default_factory=list)


class Archive:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # The pointer is the one small file read and written on the driver, through Hadoop's file systems.
    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        path, fs = self._fs(POINTER)
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return {}
        return found if found.get("format") == FORMAT else {}  # any doubt: read all again

    def _swap(self, content: dict) -> None:
        fresh, fs = self._fs(f".{POINTER}.{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        old, _ = self._fs(POINTER)
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(options, 1)
        rename[0] = options.OVERWRITE
        context.rename(fresh, old, rename)

    def turns(self, *tiers: str, lenient: bool = False) -> DataFrame | None:
        """The archived turns; with tiers named only their partitions are read. ``lenient``: what is left of damaged files."""
        batches = self.pointer().get("batches", [])
        if not batches:
            return None
        reader = self.spark.read.option("basePath", f"{self.folder}/turns").schema(S.TURN)
        if lenient:
            reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        found = reader.parquet(*[f"{self.folder}/turns/batch={b}" for b in batches]).select(*S.TURN_COLUMNS)
        return found.where(F.col("tier").isin(*tiers)) if tiers else found

    def state(self) -> DataFrame:
        now = self.pointer().get("state")
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/state/{now}") if now else self.spark.createDataFrame([], STATE)

    def _write(self, turns: DataFrame, batch: str) -> int:
        """Write a batch and its manifest; how many turns it holds."""
        path = f"{self.folder}/turns/batch={batch}"
        # Rebalanced by tier: large tiers are split over tasks, small ones merged into one file.
        turns.hint("rebalance", "tier").sortWithinPartitions("tier", *[c for c in total_order() if c != "tier"]).write.partitionBy("tier").parquet(path)
        counts = row_counts(self.spark, path)
        files = manifest(self.spark, path)
        name = lambda c: F.substring_index(c, "/turns/", -1)  # noqa: E731  the two readers spell a path's scheme differently
        held = files.join(counts.select(name(F.col("path")).alias("of"), "turns"), name(F.col("path")) == F.col("of"), "left")
        held.select("path", "size", "sha256", F.coalesce("turns", F.lit(0)).alias("turns")).write.parquet(f"{self.folder}/manifest/{batch}")
        return int(self.spark.read.parquet(f"{self.folder}/manifest/{batch}").agg(F.sum("turns")).first()[0] or 0)

    def update(self, root: str, provider: str = "claude-code", resolver: Callable[[str], str] | None = repos.resolve, force: bool = False) -> Update:
        """Read what is new under a root; nothing new: nothing is written.

        With ``force`` every transcript is read again. What is archived stays, also of transcripts that are gone; it is
        written anew with what was found, as one batch, so that damaged files are left behind.
        """
        if provider not in decode.PROVIDERS:
            raise UsageError(f"unknown agent {provider!r}")
        fits: Callable[[Column], Column] = transcripts.is_codex if provider == "codex" else transcripts.is_claude
        found = transcripts.files(self.spark, root).where(fits(F.col("path"))).drop("content")
        state = self.state()
        plan = ingest_plan(found, self.spark.createDataFrame([], STATE) if force else state).persist()
        todo = plan.where("action <> 'skip'")
        # The names of changed files come to the driver, which has listed all of them to plan the scan.
        changed = {r["path"]: r["start"] for r in todo.select("path", "start").collect()}
        gone = state.join(plan, "path", "left_anti").count()
        if not changed and not gone and not force:
            plan.unpersist()
            return Update(False)
        # A resumed file of the second provider starts over, so that its identity is known; deduplication absorbs it.
        opened = transcripts.opened(self.spark, sorted(changed)).join(todo.select("path", "start"), "path")
        read = transcripts.lines(opened, F.col("start") if provider != "codex" else F.lit(0)).persist()
        turns = decode.PROVIDERS[provider](read)
        turns = (repos.with_repos(turns, resolver) if resolver else turns).persist()
        twice = collapsed(turns)
        archived = self.turns(lenient=force)
        fresh = distinct_rows(new_records(first_records(turns), archived).select(*S.TURN_COLUMNS))
        batch = uuid.uuid4().hex
        if force and archived is not None:
            fresh = archived.unionByName(fresh)
        written = self._write(fresh, batch)
        marks = transcripts.marks(todo.select("path", "size"), read)
        oldest = turns.groupBy("path").agg(F.min(parse_ts(F.col("ts"))).alias("oldest"))
        before = state.select("path", F.col("mark").alias("mark0"), F.col("oldest").alias("oldest0"))
        after = plan.select("path", "size", "mtime").join(marks, "path", "left").join(oldest, "path", "left").join(before, "path", "left")
        after.select("path", "size", "mtime", F.coalesce("mark", "mark0").alias("mark"), F.least("oldest", "oldest0").alias("oldest")).write.parquet(f"{self.folder}/state/{batch}")
        batches = ([] if force else self.pointer().get("batches", [])) + [batch]
        self._swap({"format": FORMAT, "state": batch, "batches": batches})
        for df in (plan, read, turns):
            df.unpersist()
        return Update(True, len(changed), twice, written)

    def compact(self, most: int = 8) -> bool:
        """Write the batches as one where there are more than ``most``; readers of the old ones aren't disturbed."""
        now = self.pointer()
        if len(now.get("batches", [])) <= most:
            return False
        batch = uuid.uuid4().hex
        self._write(self.turns(), batch)
        self._swap({**now, "batches": [batch]})
        return True

    def verify(self) -> list[tuple[str, str]]:
        """(path, problem) of all data files that aren't as they were committed, and of a state or manifest that is gone."""
        out: list[tuple[str, str]] = []
        now = self.pointer()
        if now:
            out += self._unreadable(f"state/{now['state']}", STATE)
        for batch in now.get("batches", []):
            folder = f"{self.folder}/turns/batch={batch}"
            if bad := self._unreadable(f"manifest/{batch}", "path string, size long, sha256 string, turns long"):
                out += bad
                continue
            expected = self.spark.read.parquet(f"{self.folder}/manifest/{batch}")
            name = F.substring_index("path", "/turns/", -1)
            counts = row_counts(self.spark, folder).select(name.alias("of"), "turns")
            actual = manifest(self.spark, folder, read_whole(expected))
            actual = actual.join(counts, F.substring_index(actual["path"], "/turns/", -1) == F.col("of"), "left").select("path", "size", "sha256", F.coalesce("turns", F.lit(0)).alias("turns"))
            out += [(r[0], r[1]) for r in problems(expected, actual).orderBy("path").collect()]
        return out

    def _unreadable(self, name: str, schema: str) -> list[tuple[str, str]]:
        path, fs = self._fs(name)
        if not fs.exists(path):
            return [(f"{self.folder}/{name}", "missing")]
        try:
            self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").count()
        except Exception as e:  # noqa: BLE001  whatever makes it unreadable is the finding
            return [(f"{self.folder}/{name}", f"unreadable: {type(e).__name__}")]
        return []

    def coverage(self) -> dict:
        held = self.turns()
        row = bounds(held).first().asDict() if held is not None else {"content_from": None, "content_to": None, "turns": 0, "sessions": 0}
        live = self.state().agg(F.min("mtime").alias("live_from"), F.count("*").alias("live_files")).first().asDict()
        widest = skew(self.state()).first()
        return row | live | {"skew_path": widest["path"] if widest else None, "skew_days": widest["seconds"] // 86400 if widest else None}
