"""Queries of the decoding and archive operators, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalogue import CONV, query, search
from .functions import render
from .operators import archive, matching
from .sources import decode, transcripts
from .sources.tables import table, turns3

RECORD = "struct<type:string,uuid:string,sessionId:string,timestamp:string,cwd:string,promptSource:string,message:struct<role:string,content:string>>"


def _claude_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    block = lambda t, k, v: F.struct(F.lit(t).alias("type"), v.alias(k))
    record = F.struct(
        kind.alias("type"),
        F.concat_ws("-", "conv_id", "turn").alias("uuid"),
        F.col("conv_id").cast("string").alias("sessionId"),
        F.lit("2026-01-01T09:00:00Z").alias("timestamp"),
        F.when(F.col("role") == "user", "typed").alias("promptSource"),
        (F.col("conv_id") % 7 == 3).alias("isSidechain"),
        F.struct(F.col("role"), F.array(block("text", "text", F.col("text"))).alias("content")).alias("message"),
    )
    return c.select(F.concat(F.lit("/p/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.col("turn").alias("off"), F.to_json(record).alias("raw"))


@query("""SELECT conv_id::VARCHAR AS session, conv_id || '-' || turn AS uuid, 'conversation' AS tier, CASE WHEN conv_id % 7 = 3 THEN 'agent' WHEN role = 'assistant' THEN 'assistant' WHEN role = 'user' THEN 'human' ELSE 'system' END AS author, text FROM conversations""")
def decode_claude_roundtrip(spark, sf_dir):
    return decode.claude_turns(_claude_lines(spark, sf_dir)).select("session", "uuid", "tier", "author", "text")


def _codex_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("/x/rollout-2026-01-01T00-00-00-"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("-0000-0000-0000-000000000000.jsonl")).alias("path")
    said = F.struct(F.lit("2026-01-01T09:00:00Z").alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.col("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.col("text"))).alias("content")).alias("payload"))
    who = F.struct(F.lit("2026-01-01T08:59:59Z").alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), F.lit("/w").alias("cwd")).alias("payload"))
    meta = c.where("conv_id % 2 = 0").select("conv_id").distinct().select(path, F.lit(-1).cast("long").alias("off"), F.to_json(who).alias("raw"))
    return c.select(path, F.col("turn").alias("off"), F.to_json(said).alias("raw")).unionByName(meta)


@query("""SELECT CASE WHEN conv_id % 2 = 0 THEN 's' || conv_id ELSE lpad(conv_id::VARCHAR, 8, '0') || '-0000-0000-0000-000000000000' END AS session, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS author, CASE WHEN conv_id % 2 = 0 THEN '/w' ELSE '' END AS cwd, text FROM conversations WHERE text <> ''""")
def decode_codex_roundtrip(spark, sf_dir):
    return decode.codex_turns(_codex_lines(spark, sf_dir)).select("session", "author", "cwd", "text")


@query("""SELECT conv_id::VARCHAR AS session, turn::VARCHAR AS uuid, 'Run ' || CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'f' || turn ELSE 'a=' || conv_id || ' b=' || turn END AS text FROM conversations WHERE text <> ''""")
def decode_invocation_args(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    given = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("command"), F.lit("/x").alias("path")))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.lit("").alias("command"), F.concat(F.lit("f"), F.col("turn")).alias("file_path")))).otherwise(F.to_json(F.struct(F.col("turn").alias("b"), F.col("conv_id").alias("a"), F.array(F.lit(1)).alias("c"))))
    raw = F.concat(F.lit('{"type":"assistant","uuid":"'), F.col("turn"), F.lit('","sessionId":"'), F.col("conv_id"), F.lit('","message":{"content":[{"type":"tool_use","name":"Run","input":'), given, F.lit("}]}}"))
    return decode.claude_turns(c.select(F.lit("/p/a.jsonl").alias("path"), F.col("turn").alias("off"), raw.alias("raw"))).select("session", "uuid", "text")


@query("""SELECT conv_id::VARCHAR AS session, turn::VARCHAR AS uuid, CASE WHEN turn % 2 = 0 THEN 'human' ELSE 'system' END AS author, CASE WHEN turn % 2 = 0 THEN '/go ' || conv_id ELSE text END AS text FROM conversations WHERE text <> '' AND NOT contains(text, '<')""")
def decode_command_line(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text <> '' AND NOT contains(text, '<')")
    typed = F.concat(F.lit("<command-name>/go</command-name><command-args> "), F.col("conv_id"), F.lit(" </command-args>"))
    content = F.when(F.col("turn") % 2 == 0, typed).otherwise(F.col("text"))
    record = F.to_json(F.struct(F.lit("user").alias("type"), F.col("turn").cast("string").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.struct(content.alias("content")).alias("message")))
    return decode.claude_turns(c.select(F.lit("/p/a.jsonl").alias("path"), F.col("turn").alias("off"), record.alias("raw"))).select("session", "uuid", "author", "text")


@query("""SELECT conv_id * 1000 + turn AS off, 's' || conv_id AS session, CASE WHEN conv_id % 2 = 0 THEN '/w' || conv_id ELSE coalesce('/w' || lag_even, '') END AS cwd FROM (SELECT *, max(CASE WHEN conv_id % 2 = 0 THEN conv_id END) OVER (PARTITION BY conv_id % 7 ORDER BY conv_id RANGE UNBOUNDED PRECEDING) AS lag_even FROM conversations) WHERE turn > 0 AND text <> ''""")
def forward_fill_identity(spark, sf_dir):
    """Many identity records in a file; an empty working directory doesn't replace the one before."""
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    meta = F.to_json(F.struct(F.lit("t").alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("s"), F.col("conv_id")).alias("id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("/w"), F.col("conv_id"))).otherwise("").alias("cwd")).alias("payload")))
    said = F.to_json(F.struct(F.lit("t").alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.col("text"))).alias("content")).alias("payload")))
    path = F.concat(F.lit("/x/rollout-"), F.col("conv_id") % 7, F.lit(".jsonl")).alias("path")
    off = (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("off")
    heads = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(path, (F.col("conv_id") * 1000).cast("long").alias("off"), meta.alias("raw"))
    lines = c.where("turn > 0").select(path, off, said.alias("raw")).unionByName(heads)
    return decode.codex_turns(lines).select(F.split_part("uuid", F.lit("-"), F.lit(1)).cast("long").alias("off"), "session", "cwd")


KINDS = "CASE turn % 6 WHEN 0 THEN 'response_item' WHEN 1 THEN 'event_msg' WHEN 2 THEN 'turn_context' WHEN 3 THEN 'response_item' WHEN 4 THEN 'brand_new' ELSE 'response_item' END"
PAYLOADS = "CASE turn % 6 WHEN 0 THEN 'message' WHEN 3 THEN 'reasoning' WHEN 5 THEN 'hologram' ELSE '' END"


@query(f"""SELECT type, payload, count(*)::BIGINT AS n, CASE WHEN type = 'event_msg' THEN 'telemetry' WHEN payload = 'message' THEN 'turn' WHEN type = 'turn_context' OR payload = 'reasoning' THEN 'silent' ELSE 'unknown' END AS fate FROM (SELECT {KINDS} AS type, {PAYLOADS} AS payload FROM conversations) GROUP BY ALL""")
def codex_record_kinds(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct(F.expr(KINDS).alias("type"), F.struct(F.expr(PAYLOADS).alias("type"), F.col("text").alias("message")).alias("payload")))
    return decode.codex_kinds(c.select(record.alias("raw")))


@query("""SELECT doc_id::VARCHAR AS path, CASE doc_id % 5 WHEN 1 THEN 'skip' WHEN 2 THEN 'resume' ELSE 'whole' END AS action, CASE WHEN doc_id % 5 IN (1, 2) THEN doc_id + 4 ELSE 0 END AS "start" FROM documents""")
def ingest_plan(spark, sf_dir):
    """New files, and those that are the same, grew, shrank, or were written anew."""
    docs = table(spark, sf_dir, "documents")
    k, name = F.col("doc_id") % 5, F.col("doc_id").cast("string").alias("path")
    listing = docs.select(name, F.when(k == 2, 9).when(k == 3, 3).otherwise(5).cast("long").alias("size"), F.timestamp_seconds(F.when(k < 2, 1).otherwise(2)).alias("mtime"))
    state = docs.where(k > 0).select(name, F.lit(5).cast("long").alias("size"), F.timestamp_seconds(F.lit(1)).alias("mtime"), (F.col("doc_id") + 4).cast("long").alias("mark"))
    return archive.ingest_plan(listing, state).select("path", "action", "start")


@query("""SELECT session, uuid, min(off)::BIGINT AS off FROM (SELECT (conv_id % 10)::VARCHAR AS session, (turn % 3)::VARCHAR AS uuid, conv_id * 1000 + turn AS off FROM conversations) WHERE uuid <> '' GROUP BY session, uuid""")
def ingest_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") % 10).cast("string").alias("session"), (F.col("turn") % 3).cast("string").alias("uuid"), F.lit("p").alias("path"), (F.col("conv_id") * 1000 + F.col("turn")).alias("off"))
    return archive.first_records(rows).select("session", "uuid", "off")


@query("""SELECT doc_id::VARCHAR AS path, (n_chars * 100 - doc_id % 50)::BIGINT AS seconds FROM documents WHERE doc_id % 3 > 0 ORDER BY seconds DESC, path LIMIT 1""")
def ingest_skew(spark, sf_dir):
    at = lambda c: F.timestamp_seconds(c)
    docs = table(spark, sf_dir, "documents")
    state = docs.select(F.col("doc_id").cast("string").alias("path"), at(F.col("n_chars") * 100).alias("mtime"), F.when(F.col("doc_id") % 3 > 0, at(F.col("doc_id") % 50)).alias("oldest"))
    return archive.skew(state).select("path", "seconds")


def _folder(spark) -> str:
    """A folder for an archive that a query makes: in the shared one, or a temporary one where Spark runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or 'file:///tmp/checkpoints/turnlake').rstrip('/')}/archive-{uuid.uuid4().hex}"


def _archived(spark, sf_dir, *cuts) -> archive.Archive:
    """An archive of the conversations as transcripts that were written, and taken in, in steps."""
    root = _folder(spark)
    held = archive.Archive(spark, f"{root}/archive")
    c = table(spark, sf_dir, "conversations")
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("").alias("text"), F.lit("Run").alias("name"), F.struct(F.concat(F.lit("c"), F.col("turn")).alias("command")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit("").alias("name"), F.struct(F.lit("").alias("command")).alias("input"))
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    record = F.struct(kind.alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.lit("2026-01-01T09:00:00Z").alias("timestamp"), F.when(F.col("role") == "user", "typed").alias("promptSource"), F.struct(F.array(said, call).alias("content")).alias("message"))
    for i, cut in enumerate(cuts):  # each step's files hold some of what came before too, as resumed sessions do
        c.where(cut).select(F.to_json(record).alias("value")).coalesce(3).write.option("lineSep", "\n").text(f"{root}/live/{i}")
        for part in transcripts.files(spark, f"{root}/live/{i}").where(F.endswith("path", F.lit(".txt"))).select("path").collect():
            old, fs = held._fs("x")
            made = spark._jvm.org.apache.hadoop.fs.Path
            fs.rename(made(part["path"]), made(part["path"].removesuffix(".txt") + ".jsonl"))
        held.update(f"{root}/live", resolver=None)
    return held


ARCHIVED_SQL = """SELECT conv_id::VARCHAR AS session, conv_id || '-' || turn AS uuid, CASE WHEN role = 'assistant' THEN 'assistant' WHEN role = 'user' THEN 'human' ELSE 'system' END AS author, tier, CASE tier WHEN 'conversation' THEN text ELSE 'Run c' || turn END AS text FROM conversations, (VALUES ('conversation'), ('invocation')) t(tier) WHERE (tier <> 'conversation' OR text <> '')"""


@query(ARCHIVED_SQL)
def ingest_incremental(spark, sf_dir):
    """What is archived after three steps, each with some of the lines of the one before, and a last one with nothing new."""
    held = _archived(spark, sf_dir, "conv_id % 3 = 0", "conv_id % 3 < 2", "conv_id % 3 > 0")
    assert not held.update(f"{held.folder}/../live", resolver=None).wrote
    return held.turns().select("session", "uuid", "author", "tier", "text")


@query(ARCHIVED_SQL + " AND tier = 'invocation'")
def archive_tiers(spark, sf_dir):
    return _archived(spark, sf_dir, "true").turns("invocation").select("session", "uuid", "author", "tier", "text")


@query(ARCHIVED_SQL)
def archive_force_and_compact(spark, sf_dir):
    """Reading all transcripts again, some of which are gone, loses nothing; nor does writing the batches as one."""
    held = _archived(spark, sf_dir, "conv_id % 2 = 0", "conv_id % 2 = 1")
    path, fs = held._fs("../live/0")
    fs.delete(path, True)
    held.update(f"{held.folder}/../live", resolver=None, force=True)
    held.compact(0)
    return held.turns().select("session", "uuid", "author", "tier", "text")


@query("""SELECT min(nullif(ts, '')) AS content_from, max(nullif(ts, '')) AS content_to, count(*)::BIGINT AS turns, count(DISTINCT session)::BIGINT AS sessions FROM turns""")
def coverage_bounds(spark, sf_dir):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return archive.bounds(turns3(spark, sf_dir)).select(shown("content_from"), shown("content_to"), "turns", "sessions")


@query("""SELECT * FROM (VALUES ('nation.parquet', 'missing'), ('orders.parquet', 'size'), ('part.parquet', 'checksum'), ('region.parquet', 'unknown')) v(name, problem)""")
def verify_manifest(spark, sf_dir):
    """The test tables' own files, as they are, against a manifest that says otherwise of four."""
    held = archive.manifest(spark, sf_dir)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    said = held.where(name != "region.parquet").withColumn("size", F.when(name == "orders.parquet", F.lit(1)).otherwise(F.col("size"))).withColumn("sha256", F.when(name == "part.parquet", F.lit("0")).otherwise(F.col("sha256")))
    return archive.problems(said, held.where(name != "nation.parquet")).select(name.alias("name"), "problem")


@query()
def snippet(spark, sf_dir):
    found, _ = search(spark, sf_dir, "ershe", CONV)
    make = F.pandas_udf(lambda t, o, n: t.combine(o, lambda a, b: (a, b)).combine(n, lambda p, c: render.snippet(p[0], int(p[1]), int(c))), "string")
    shown = matching.texts(found, turns3(spark, sf_dir, CONV))
    return shown.select("session", "uuid", "offset", make("text", "offset", "length").alias("snippet"))
