"""Scope and attribute filters over turns."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import OWN_MARK
from ..functions.text import parse_ts
from ..plans.errors import ArchiveError
from ..sources import repos

#: The command word under which this engine's own calls are recorded as tool invocations.
COMMAND = "turnlake"
VERBS = ("find ", "show ", "when ", "doctor", "guide", "turns ")


@dataclass(frozen=True)
class TurnFilter:
    author: str = ""
    branch: str = ""
    agent: str = ""
    session: str = ""
    self_session: str = ""
    drop_own_output: bool = True
    since: datetime.datetime | None = None
    until: datetime.datetime | None = None


def tiers(turns: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """A partition filter on an archive, a pushed one elsewhere."""
    return turns.where(F.col("tier").isin(*wanted))


def scope_of(scope: str, cwd: str = "") -> str:
    """The repo a scope means: ``here`` is that of a working directory, or everything where that is outside any."""
    if scope != "here":
        return scope or "all"
    found = repos.resolve(cwd) if cwd else repos.OUTSIDE
    return "all" if found in ("", repos.OUTSIDE) else found


def in_scope(repo: str) -> Column:
    """Equal to a repo, or any repo it is part of, whatever the case; ``all`` (or none) is everything."""
    if repo in ("", "all"):
        return F.lit(True)
    return (F.col("repo") == repo) | F.contains(F.lower("repo"), F.lit(repo.lower()))


def own_output(command: str = COMMAND) -> Column:
    """This engine's own answers, which begin with ``OWN_MARK``, and calls of it, recorded in a transcript."""
    text = F.col("text")
    answer = (F.col("tier") == "result") & F.contains(text, F.lit(OWN_MARK))
    at = F.instr(text, f"{command} ")
    before = F.substring(text, F.greatest(at - 1, F.lit(1)), F.lit(1))
    rest = F.substring(text, at + len(command) + 1, F.lit(12))
    verb = F.lit(False)
    for v in (*VERBS, "--"):
        verb = verb | F.startswith(rest, F.lit(v))
    call = (F.col("tier") == "invocation") & (at > 0) & ((at == 1) | ~F.rlike(before, F.lit(r"[A-Za-z0-9/._-]"))) & verb
    return answer | call


def drop_reason(f: TurnFilter) -> Column:
    """Why a turn is left out, the first reason that holds; null for one that stays."""
    reason = F.when(F.lit(False), F.lit(""))
    if f.author:
        reason = reason.when(F.col("author") != f.author, "author")
    if f.branch:
        reason = reason.when(F.lower("branch") != f.branch.lower(), "branch")
    if f.agent:
        reason = reason.when(~F.contains(F.lower("agent"), F.lit(f.agent.lower())), "agent")
    if f.session:
        reason = reason.when(~F.startswith("session", F.lit(f.session)), "session")
    if f.self_session and not (f.session and f.self_session.startswith(f.session)):  # unless it is asked for
        reason = reason.when(F.col("session") == f.self_session, "self")
    if f.drop_own_output:
        reason = reason.when(own_output(), "own output")
    at = parse_ts(F.col("ts"))
    if f.since:
        reason = reason.when(at < F.lit(f.since), "since")
    if f.until:
        reason = reason.when(at > F.lit(f.until), "until")
    return reason


def keep(turns: DataFrame, f: TurnFilter) -> DataFrame:
    return turns.where(drop_reason(f).isNull())


def dropped(turns: DataFrame, f: TurnFilter) -> DataFrame:
    """(reason, turns) for every reason that left turns out."""
    return turns.select(drop_reason(f).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("turns"))


def resolve_session(turns: DataFrame, prefix: str) -> str:
    """The session of that id, or the only one that starts so."""
    found = sorted(r[0] for r in turns.where(F.startswith("session", F.lit(prefix))).select("session").distinct().orderBy("session").limit(6).collect())
    if prefix in found or len(found) == 1:
        return prefix if prefix in found else found[0]
    if not turns.where(F.col("session") == prefix).isEmpty():
        return prefix
    raise ArchiveError(f"no session starts with {prefix!r}" if not found else f"{prefix!r} starts several sessions: {', '.join(found[:5])}")
