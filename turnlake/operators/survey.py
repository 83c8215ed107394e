"""What a search that found too little can say: how many turns carry each term, and which corpus words are near it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..plans.compile import CompiledQuery, Term
from .matching import counted_alone


def term_turns(turns: DataFrame, q: CompiledQuery) -> list[int]:
    """Searched turns that carry each term by itself: one pass, one row."""
    folded = turns.where(F.col("tier").isin(*q.tiers)).select(X.fold(F.col("text")).alias("folded"))
    row = folded.agg(*[F.count_if(counted_alone(F.col("folded"), t)).alias(f"t{i}") for i, t in enumerate(q.terms)]).first()
    return list(row)


def near(token: Column, term: str) -> Column:
    """Whether a corpus word is near a term: a long common beginning, or few edits, in a window of lengths."""
    size = len(term.encode())
    edits = 1 if size < 5 else 2
    prefix = max(size - 3, S.MIN_STEM)
    low, high = max(min(size - edits, prefix), S.MIN_TOKEN), size + 4
    starts = F.startswith(token, F.lit(term[:prefix])) if len(term) >= prefix else F.lit(False)
    # With a threshold levenshtein gives -1 beyond it, at the cost of a band.
    close = (F.abs(F.octet_length(token) - size) <= edits) & (F.levenshtein(token, F.lit(term), edits) >= 0)
    return F.octet_length(token).between(low, high) & (starts | close)


def corpus_tokens(turns: DataFrame, tiers: tuple[str, ...], terms: list[str]) -> DataFrame:
    """(token, n) of corpus words near one of the terms; the filter goes before the shuffle."""
    words = turns.where(F.col("tier").isin(*tiers)).select(F.explode(X.tokens(X.fold(F.col("text")))).alias("token"))
    return words.where(reduce(lambda a, b: a | b, [near(F.col("token"), t) for t in terms])).groupBy("token").agg(F.count("*").alias("n"))


def near_terms(turns: DataFrame, q: CompiledQuery, missing: list[Term], most: int = S.NEARBY_MAX) -> DataFrame:
    """(term, token, n, distance, place): for each missing term its nearest corpus words, at most ``most``."""
    texts = [t.text for t in missing]
    counts = corpus_tokens(turns, q.tiers, texts)
    # Terms are those of one query, so each token is tested against few.
    offers = F.explode(F.filter(F.array(*[F.when(near(F.col("token"), t), F.struct(F.lit(t).alias("term"), F.levenshtein(F.col("token"), F.lit(t)).alias("distance"))) for t in texts]), lambda x: x.isNotNull()))
    ranked = counts.select("token", "n", offers.alias("o")).select("o.term", "token", "n", "o.distance")
    place = F.row_number().over(Window.partitionBy("term").orderBy("distance", F.desc("n"), "token"))
    return ranked.withColumn("place", place).where(F.col("place") <= most)


def substitutes(nearby: DataFrame) -> dict[str, list[str]]:
    """Words one edit away, at most four a term, to search in its stead."""
    rows = nearby.where(F.col("distance") <= S.SUBSTITUTE_DISTANCE).where(F.col("place") <= S.VARIANTS_PER_TERM).orderBy("term", "place").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["term"], []).append(r["token"])
    return out
