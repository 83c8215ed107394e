"""Matching: which turns carry which terms, relaxation to the best partial matches, and occurrences as hits.

A search reads the corpus once. Turns that carry a term are few, so they are kept (persisted) for the second step, which
needs the largest number of terms any turn carries; the corpus isn't read again for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..plans.compile import CompiledQuery, Term


def satisfied(folded: Column, term: Term) -> Column:
    tests = [X.carries(folded, term.needle), *[X.carries_word(folded, s) for s in term.synonyms], *[X.carries(folded, s) for s in term.substitutes]]
    return reduce(lambda a, b: a | b, tests)


def counted_alone(folded: Column, term: Term) -> Column:
    """The survey's test of a term: all its needles as substrings."""
    return reduce(lambda a, b: a | b, [X.carries(folded, n) for n in (term.needle, *term.synonyms, *term.substitutes)])


def matched(turns: DataFrame, q: CompiledQuery) -> DataFrame:
    """Turns that carry a term, with ``folded``, ``carried`` (a boolean for each term) and ``found`` (how many)."""
    out = turns.where(F.col("tier").isin(*q.tiers)).withColumn("folded", X.fold(F.col("text")))
    for term in q.exclude:
        out = out.where(~satisfied(F.col("folded"), term))
    if not q.terms:
        return out.withColumn("carried", F.array().cast("array<boolean>")).withColumn("found", F.lit(0)).where(F.lit(False))
    carried = [satisfied(F.col("folded"), t) for t in q.terms]
    found = reduce(lambda a, b: a + b, [c.cast("int") for c in carried])
    return out.withColumn("carried", F.array(*carried)).withColumn("found", found).where("found >= 1")


class Relaxed:
    """The turns of a search: those with the most terms, and one fewer if none has all."""

    def __init__(self, turns: DataFrame, q: CompiledQuery):
        self.query = q
        self.all = matched(turns, q).persist(StorageLevel.MEMORY_AND_DISK)
        n = len(q.terms)
        flags = [F.max(F.when(F.col("found") == k, True)).alias(f"n{k}") for k in range(1, n + 1)]
        row = self.all.agg(F.max("found"), *flags).first() if n else (None,)
        self.best = row[0] or 0
        below = self.best - 1
        if q.strict:
            self.best = n if self.best == n else 0
            levels = [n]
        else:
            levels = [self.best] + ([below] if 1 <= below and self.best < n else [])
        self.required = min([k for k in levels if k == self.best or (k >= 1 and row[k])], default=0) if self.best else 0
        self.turns = self.all.where(F.col("found").isin(*levels)) if self.best else self.all.where(F.lit(False))

    def carried(self) -> list[str]:
        """Terms that a returned turn carries, in the order of the query."""
        if not self.query.terms:
            return []
        row = self.turns.agg(*[F.bool_or(F.col("carried")[i]).alias(f"c{i}") for i in range(len(self.query.terms))]).first()
        return [t.text for t, c in zip(self.query.terms, row, strict=True) if c]

    def close(self) -> None:
        self.all.unpersist()


def hits(found: DataFrame, q: CompiledQuery) -> DataFrame:
    """One row for each occurrence of each needle of the terms a turn carries; equal spans count once.

    A hit doesn't carry its turn's text but the text's digest and size; ``texts`` puts it back beside the few rows shown.
    """
    empty = F.array().cast("array<struct<offset:int,length:int,match:string>>")
    lists = []
    for i, t in enumerate(q.terms):
        own = [(t.needle, False), *[(s, True) for s in t.synonyms], *[(s, False) for s in t.substitutes]]
        lists.append(F.when(F.col("carried")[i], F.concat(*[X.spans(F.col("text"), F.col("folded"), n, w) for n, w in own])).otherwise(empty))
    if not lists:
        lists = [empty]
    once = lists[0] if len(q.terms) == 1 and not q.terms[0].synonyms and not q.terms[0].substitutes else F.array_sort(F.array_distinct(F.concat(*lists)))
    thin = found.select("session", "uuid", "ts", "tier", "author", "agent", "repo", "branch", "found", digest().alias("digest"), F.octet_length("text").alias("nbytes"), once.alias("spans"))
    return thin.withColumn("span", F.explode("spans")).select("session", "uuid", "ts", "tier", "author", "agent", "repo", "branch", "span.offset", "span.length", "span.match", F.col("found").alias("terms"), "digest", "nbytes")


def digest() -> Column:
    return F.md5(F.col("text"))


def dedup(found: DataFrame) -> DataFrame:
    """One hit for each (session, uuid, tier, offset, length, text), the text by its digest."""
    return found.dropDuplicates(["session", "uuid", "tier", "offset", "length", "digest"])


def texts(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """``rows`` (few: those an answer shows) with the text of their turns."""
    of = turns.select("session", "uuid", "tier", digest().alias("digest"), "text").dropDuplicates(["session", "uuid", "tier", "digest"])
    return rows.join(of, ["session", "uuid", "tier", "digest"])


def work(turns: DataFrame, q: CompiledQuery) -> DataFrame:
    """bytes, turns, lines and words of the searched turns."""
    t = F.col("text")
    return turns.where(F.col("tier").isin(*q.tiers)).agg(F.coalesce(F.sum(F.octet_length(t)), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("turns"), F.coalesce(F.sum(X.line_count(t)), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.sum(X.word_count(t)), F.lit(0)).cast("long").alias("words"))


def coverage(turns: DataFrame, q: CompiledQuery) -> DataFrame:
    """turns and sessions there are, and of them searched; reads no text."""
    inside = F.col("tier").isin(*q.tiers)
    return turns.agg(F.count("*").alias("turns"), F.count_distinct("session").alias("sessions"), F.count_if(inside).alias("turns_searched"), F.count_distinct(F.when(inside, F.col("session"))).alias("sessions_searched"))


def turn_counts(turns: DataFrame) -> DataFrame:
    """(session, turns): conversation turns of each session that has any, whatever filters say."""
    return turns.where("tier = 'conversation'").groupBy("session").agg(F.count("*").alias("turns"))


def unsearched(q: CompiledQuery) -> list[str]:
    return [t for t in S.TIERS if t not in q.tiers]
