"""Turns from the test tables: conversations, events and documents as the three tiers."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

SESSIONS = 120
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _cid(k: Column) -> Column:
    return F.concat(F.lit("c"), F.lpad(k.cast("string"), 6, "0"))


def _iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _repo(k: Column) -> Column:
    return F.when(k % 4 == 0, "github.com/acme/payments").when(k % 4 == 1, "github.com/acme/infra").when(k % 4 == 2, "/home/u/scratch").otherwise("")


def _branch(k: Column) -> Column:
    return F.when(k % 3 == 0, "main").when(k % 3 == 1, "Hotfix/Dedupe").otherwise("")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id")
    author = F.when(F.col("role") == "user", "human").when((F.col("role") == "assistant") & (k % 5 == 0), "agent").when(F.col("role") == "assistant", "assistant").otherwise("system")
    return c.select(
        _cid(k).alias("session"),
        F.concat_ws("-", _cid(k), F.col("turn").cast("string")).alias("uuid"),
        F.when(k % 17 == 16, "").otherwise(_iso(EPOCH + k * 86400 + F.col("turn") * 60)).alias("ts"),
        F.lit("conversation").alias("tier"),
        author.alias("author"),
        F.when(author == "agent", "Explorer").otherwise("").alias("agent"),
        F.lit("tables").alias("origin"),
        _repo(k).alias("repo"),
        _branch(k).alias("branch"),
        F.lit("").alias("cwd"),
        "text",
        F.lit(0).alias("seq"),
    )


def result_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % SESSIONS
    return _wide(d, k, F.concat(F.lit("d"), F.col("doc_id").cast("string")), _iso(EPOCH + k * 86400 + 3600 + F.col("doc_id") % 60), "result", "system", F.col("text"))


def invocation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % SESSIONS
    at = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _wide(e, k, F.concat(F.lit("e"), F.col("event_id").cast("string")), at, "invocation", "assistant", F.concat_ws(" ", "event_type", "props"))


def _wide(df: DataFrame, k: Column, uuid: Column, ts: Column, tier: str, author: str, text: Column) -> DataFrame:
    return df.select(_cid(k).alias("session"), uuid.alias("uuid"), ts.alias("ts"), F.lit(tier).alias("tier"), F.lit(author).alias("author"), F.lit("").alias("agent"), F.lit("tables").alias("origin"), _repo(k).alias("repo"), _branch(k).alias("branch"), F.lit("").alias("cwd"), text.alias("text"), F.lit(0).alias("seq"))


def turns3(spark: SparkSession, sf_dir: str, tiers: tuple[str, ...] = S.TIERS) -> DataFrame:
    """The union of the wanted tiers; the tables of others aren't read."""
    makers = {"conversation": conversation_turns, "invocation": invocation_turns, "result": result_turns}
    return reduce(DataFrame.unionByName, [makers[t](spark, sf_dir) for t in S.TIERS if t in tiers])


#: The same turns in DuckDB's SQL.
TURNS3_SQL = r"""
t_conv AS (
  SELECT 'c' || lpad(conv_id::VARCHAR, 6, '0') AS session, 'c' || lpad(conv_id::VARCHAR, 6, '0') || '-' || turn AS uuid,
    CASE WHEN conv_id % 17 = 16 THEN '' ELSE strftime(to_timestamp(1704067200 + conv_id * 86400 + turn * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS ts,
    'conversation' AS tier,
    CASE WHEN role = 'user' THEN 'human' WHEN role = 'assistant' AND conv_id % 5 = 0 THEN 'agent' WHEN role = 'assistant' THEN 'assistant' ELSE 'system' END AS author,
    CASE WHEN role = 'assistant' AND conv_id % 5 = 0 THEN 'Explorer' ELSE '' END AS agent, conv_id AS k, text
  FROM conversations
), t_doc AS (
  SELECT 'c' || lpad((doc_id % 120)::VARCHAR, 6, '0') AS session, 'd' || doc_id AS uuid,
    strftime(to_timestamp(1704067200 + (doc_id % 120) * 86400 + 3600 + doc_id % 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts,
    'result' AS tier, 'system' AS author, '' AS agent, doc_id % 120 AS k, text
  FROM documents
), t_event AS (
  SELECT 'c' || lpad((event_id % 120)::VARCHAR, 6, '0') AS session, 'e' || event_id AS uuid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts,
    'invocation' AS tier, 'assistant' AS author, '' AS agent, event_id % 120 AS k, event_type || ' ' || props AS text
  FROM events
), turns AS (
  SELECT session, uuid, ts, tier, author, agent,
    CASE k % 4 WHEN 0 THEN 'github.com/acme/payments' WHEN 1 THEN 'github.com/acme/infra' WHEN 2 THEN '/home/u/scratch' ELSE '' END AS repo,
    CASE k % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'Hotfix/Dedupe' ELSE '' END AS branch, text, lower(text) AS folded
  FROM (SELECT * FROM t_conv UNION ALL SELECT * FROM t_doc UNION ALL SELECT * FROM t_event)
)
"""
