"""Ranking: matched turns, sessions and their scores, facets, passages and timelines over deduplicated hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

TURN_KEY = ["session", "uuid", "tier"]


def kind_rank(match: Column) -> Column:
    return F.when(match == "word", 2).when(match == "prefix", 1).otherwise(0)


def collapse(hits: DataFrame) -> DataFrame:
    """One row for each matched turn: how often it matched, its best hit, and that hit's signal."""
    order = F.struct(kind_rank(F.col("match")), -F.col("offset"), -F.col("length"), F.col("author"), F.col("ts"))
    best = F.max(F.struct(order.alias("o"), F.struct("offset", "length", "match", "terms", "author", "agent", "ts", "repo", "branch", "nbytes", "digest").alias("h")))
    out = hits.groupBy(*TURN_KEY).agg(F.count("*").alias("occurrences"), best.alias("b")).select(*TURN_KEY, "occurrences", "b.h.*")
    return out.withColumn("signal", X.signal(F.col("terms"), F.col("author"), F.col("match"), F.col("nbytes"))).drop("nbytes")


def dominant(hits: DataFrame, column: str) -> DataFrame:
    """(session, column): the value with most hits; ties go to a value over none, then to the first in order."""
    counts = hits.groupBy("session", column).agg(F.count("*").alias("n"))
    # A maximum of (count, has a value) and then the least value, so that no session is gathered in one window.
    top = counts.groupBy("session").agg(F.max(F.struct("n", (F.col(column) != "").alias("some"))).alias("top"))
    return counts.join(top, "session").where((F.col("n") == F.col("top.n")) & ((F.col(column) != "") == F.col("top.some"))).groupBy("session").agg(F.min(column).alias(column))


def sessions(hits: DataFrame, turn_counts: DataFrame) -> DataFrame:
    """A row for each session of deduplicated hits: counts, first and last time, main repo and branch, score."""
    at = X.parse_ts(F.col("ts"))
    base = hits.groupBy("session").agg(
        F.count("*").alias("hits"),
        F.count_if(F.col("author") == "agent").alias("agent_hits"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.count_distinct(F.when(F.col("tier") == "conversation", F.col("uuid"))).alias("hit_turns"),
    )
    total = collapse(hits).groupBy("session").agg(F.sum("signal").alias("signal"))
    known = F.coalesce(F.col("turns"), F.lit(0)) > 0
    return (
        base.join(total, "session")
        .join(dominant(hits, "repo"), "session")
        .join(dominant(hits, "branch"), "session")
        .join(turn_counts, "session", "left")
        .withColumn("turns_known", known)
        .withColumn("turns", F.when(known, F.greatest("turns", "hit_turns")).otherwise(F.col("hit_turns")).cast("long"))
        .withColumn("dated", F.col("first").isNotNull())
        .withColumn("score", X.score(F.col("signal"), F.col("turns")))
    )


def session_order(mode: str = "concentration") -> list[Column]:
    dated, last = F.desc("dated"), F.desc_nulls_last("last")
    if mode == "chronological":
        return [dated, F.asc_nulls_last("first"), F.asc("session")]
    if mode == "recent":
        return [dated, last, F.asc("session")]
    return [dated, F.desc("turns_known"), F.desc("score"), F.desc("hits"), last, F.asc("session")]


def hit_order() -> list[Column]:
    """Hits of a session in time."""
    at = X.parse_ts(F.col("ts"))
    return [F.asc(at.isNull()), F.asc_nulls_last(at), F.asc("uuid"), F.asc("offset"), F.asc("tier")]


def best_per_session(matched: DataFrame, n: int) -> DataFrame:
    """The n worthiest matched turns of each session, with ``pos``, their place in time among its matched turns.

    Both windows share one shuffle by session; the second is a rank with a limit, which Spark cuts before it sorts.
    """
    in_time = Window.partitionBy("session").orderBy(*hit_order())
    worth = Window.partitionBy("session").orderBy(F.desc("signal"), F.desc("occurrences"), F.asc("pos"))
    return matched.withColumn("pos", F.row_number().over(in_time)).withColumn("worth", F.row_number().over(worth)).where(F.col("worth") <= n).drop("worth")


def facets(hits: DataFrame) -> DataFrame:
    """(field, value, hits, sessions) of repo, author, tier and branch, from one pass over hits."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("repo", "author", "tier", "branch")]))
    return hits.select("session", pairs.alias("p")).select("session", "p.*").groupBy("field", "value").agg(F.count("*").alias("hits"), F.count_distinct("session").alias("sessions"))


def passages(matched: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """The k best matched turns of all sessions."""
    joined = matched.join(ranked.select("session", F.col("score").alias("session_score")), "session")
    return joined.orderBy(*passage_order()).limit(k)


def passage_order() -> list[Column]:
    return [F.desc("signal"), F.desc("occurrences"), F.desc("session_score"), F.desc("ts"), F.asc("session"), F.asc("uuid"), F.asc("tier")]


def months(hits: DataFrame) -> DataFrame:
    """(month, hits, sessions) in UTC; undated hits are left out."""
    return hits.withColumn("month", X.month(X.parse_ts(F.col("ts")))).where("month IS NOT NULL").groupBy("month").agg(F.count("*").alias("hits"), F.count_distinct("session").alias("sessions"))


def span(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.min("first").alias("first"), F.max("last").alias("last"))


def elsewhere(hits: DataFrame, scope: Column) -> DataFrame:
    """(repo, hits, sessions) outside a scope."""
    shown = F.when(F.col("repo") == "", "(no repo recorded)").otherwise(F.col("repo"))
    return hits.where(~scope).groupBy(shown.alias("repo")).agg(F.count("*").alias("hits"), F.count_distinct("session").alias("sessions"))
