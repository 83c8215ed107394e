"""The verbs: find, turns, when, show, resume and doctor over a DataFrame of turns or an archive.

Each answer has DataFrames (lazy, over hits kept for them) and a coverage record of what was and wasn't searched.
"""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render
from ..operators import context, filters, matching, ranking, survey
from ..operators.archive import Archive, widened
from ..operators.filters import TurnFilter
from . import compile as C
from .answers import Answer, Coverage, fit_windows
from .errors import ArchiveError


@dataclass
class _Found:
    hits: DataFrame
    turns: DataFrame
    found: DataFrame
    query: C.CompiledQuery
    coverage: Coverage
    held: list[DataFrame] = field(default_factory=list)


class Engine:
    def __init__(self, turns: DataFrame, stores: tuple[Archive, ...] = ()):
        self.turns_of_all, self.stores = turns, stores

    @classmethod
    def over(cls, *archives: Archive) -> Engine:
        """Several stores as one."""
        held = [t for a in archives if (t := a.turns()) is not None]
        if not held:
            raise ArchiveError("nothing is archived yet")
        out = held[0]
        for t in held[1:]:
            out = out.unionByName(t)
        return cls(out, archives)

    def boundaries(self) -> dict:
        """From when to when the stores hold content and live files, as one."""
        return widened([a.coverage() for a in self.stores]) if self.stores else {}

    @staticmethod
    def _filter(where: TurnFilter | None, since: str, until: str, mine: bool, author: str, branch: str, agent: str, session: str, self_session: str) -> TurnFilter:
        """The filter of a question's options; times are ages or dates."""
        f = where or TurnFilter()
        at = {k: C.parse_when(v) for k, v in (("since", since), ("until", until)) if v}
        C.check_options(since=at.get("since", f.since), until=at.get("until", f.until), mine=mine, author=author)
        given = {"author": "human" if mine else author, "branch": branch, "agent": agent, "session": session, "self_session": self_session}
        return replace(f, **{k: v for k, v in given.items() if v}, **at)

    def _search(self, text: str, scope: str = "all", tools: bool = False, results: bool = False, exclude: tuple[str, ...] = (), all_terms: bool = False, exact: bool = False, near: bool = True, where: TurnFilter | None = None, elsewhere: bool = True, since: str = "", until: str = "", mine: bool = False, author: str = "", branch: str = "", agent: str = "", session: str = "", self_session: str = "", cwd: str = "") -> _Found:
        began, passes = time.time(), 1
        f = self._filter(where, since, until, mine, author, branch, agent, session, self_session)
        scope = filters.scope_of(scope, cwd)
        q = C.compile_query(text, tuple(exclude), all_terms, exact, C.tiers_of(tools, results))
        scoped = self.turns_of_all.where(filters.in_scope(scope))
        kept = filters.keep(scoped, f)
        found = matching.Relaxed(kept, q)
        carried = found.carried() if found.best else []
        reports, words = [], {}
        if q.terms and near and not all_terms and not exact and found.best < len(q.terms):
            passes += 1
            counts = [0] if len(q.terms) == 1 else survey.term_turns(kept, q)
            missing = [t for t, n in zip(q.terms, counts, strict=True) if not n]
            if missing:
                passes += 1
                nearby = survey.near_terms(kept, q, missing).persist()
                near_rows = [r.asDict() for r in nearby.orderBy("term", "place").collect()]
                words = survey.substitutes(nearby)
                nearby.unpersist()
            else:
                near_rows = []
            reports = [{"term": t.text, "turns": n, "nearby": [r for r in near_rows if r["term"] == t.text]} for t, n in zip(q.terms, counts, strict=True)]
            if words:
                passes += 1
                again = matching.Relaxed(kept, q.widened(words))
                now = again.carried()
                if len(now) > len(carried):
                    found.close()
                    found, q, carried = again, q.widened(words), now
                else:
                    again.close()
                    words = {}
        hits = matching.dedup(matching.hits(found.turns, q)).persist()
        searched = scoped.where(F.col("tier").isin(*q.tiers))
        counted = f if len(q.tiers) > 1 else replace(f, drop_own_output=False)  # only other tiers hold calls and answers
        drops = {r["reason"]: r["turns"] for r in filters.dropped(searched, counted).collect()} if counted != TurnFilter(drop_own_output=False) else {}
        cover = Coverage(q.tiers, matching.unsearched(q), [t.text for t in q.terms], list(q.dropped), found.required, carried, [t.text for t in q.terms if t.text not in carried], matching.coverage(scoped, q).first().asDict(), drops, scope, reports=reports, substitutes=words, synonyms={t.text: list(t.synonyms) for t in q.terms if t.synonyms and t.text in carried})
        cover.boundaries, cover.work = self.boundaries, lambda: matching.work(kept, q).first().asDict()
        if q.terms and found.best < len(q.terms) and carried:
            cover.notes.append(f"no turn carries all terms; the best carry {found.best} of {len(q.terms)}")
        if elsewhere and scope not in ("", "all") and found.best < len(q.terms):
            passes += 1
            wide = matching.Relaxed(filters.keep(self.turns_of_all, f), q)
            if wide.best > found.best:
                cover.notes.append(f"turns outside {scope} carry {wide.best} of {len(q.terms)} terms")
            wide.close()
        cover.passes, cover.seconds = passes, time.time() - began
        return _Found(hits, scoped, found.turns, q, cover, [hits, found.all])

    def _sessions(self, found: _Found) -> DataFrame:
        return ranking.sessions(found.hits, matching.turn_counts(found.turns))

    def find(self, text: str, limit: int = 10, hits: int = 3, sort: str = "concentration", **how) -> Answer:
        """The sessions that discussed something, with their best matched turns."""
        C.check_options(limit, hits, sort)
        found = self._search(text, **how)
        ranked = self._sessions(found).persist()
        best = ranking.best_per_session(ranking.collapse(found.hits), hits)
        extra = {"matched": best, "facets": ranking.facets(found.hits), "hits": found.hits}
        scope, held = found.coverage.scope, [*found.held, ranked]
        if not found.coverage.carried and scope != "all":
            wide = self._search(text, **{**how, "scope": "all", "near": False}, elsewhere=False)
            extra["elsewhere"] = ranking.elsewhere(wide.hits, filters.in_scope(scope))
            held += wide.held
        total = ranked.count()
        if total > limit:
            found.coverage.limits.append(f"{limit} of {render.plural(total, 'session')} shown")
        return Answer(ranked.orderBy(*ranking.session_order(sort)).limit(limit), found.coverage, total, extra, text, held)

    def turns(self, text: str, limit: int = 5, width: int = 600, **how) -> Answer:
        """The passages that say it."""
        C.check_options(limit)
        found = self._search(text, **how)
        matched = ranking.collapse(found.hits)
        quote = F.pandas_udf(lambda t, o: t.combine(o, lambda a, b: render.excerpt(a, int(b), width)), "string")
        top = matching.texts(ranking.passages(matched, self._sessions(found), limit), found.found)
        rows = top.withColumn("quote", quote("text", "offset")).drop("text", "digest", "nbytes").orderBy(*ranking.passage_order())
        total = matched.count()
        if total > limit:
            found.coverage.limits.append(f"{limit} of {render.plural(total, 'matched turn')} shown")
        return Answer(rows, found.coverage, total, query=text, held=found.held)

    def when(self, text: str, sort: str = "chronological", limit: int = 10, **how) -> Answer:
        """When it was discussed: sessions in time, hits by month, first and last."""
        C.check_options(limit, 3, sort)
        found = self._search(text, **how)
        ranked = self._sessions(found).persist()
        order = ranking.session_order("recent" if sort == "recent" else "chronological")
        return Answer(ranked.orderBy(*order).limit(limit), found.coverage, ranked.count(), {"hits": found.hits, "months": ranking.months(found.hits).orderBy("month"), "span": ranking.span(ranked)}, text, [*found.held, ranked])

    def show(self, session: str, text: str = "", around: int = 3, uuid: str = "", full: bool = False, **how) -> Answer:
        """What surrounds the matches in a session, or its end; scope and filters don't apply."""
        name = filters.resolve_session(self.turns_of_all, session)
        inside = Engine(self.turns_of_all.where(F.col("session") == name))
        placed = context.positions(inside.turns_of_all)
        found = inside._search(text, near=False, **how)
        if full:
            anchors = placed.select("session", "pos")
        elif uuid:
            anchors = context.anchors_of_turn(placed, uuid)
        elif found.query.terms:
            anchors = context.anchors_of_hits(placed, found.hits)
        else:
            anchors = context.anchor_of_tail(placed, around)
        merged = context.windows(placed, anchors, around)
        rows = context.window_turns(placed, merged, anchors)
        return Answer(rows.orderBy("pos"), found.coverage, merged.count(), {"windows": merged}, text, found.held)

    def show_text(self, session: str, text: str = "", limit_bytes: int = render.MAX_BYTES, **how) -> str:
        """As many of the windows of ``show``, the first ones, as a limit of bytes allows."""
        shown = self.show(session, text, **how)
        # Sizes first, so that no more is collected than the limit can hold; the first window is shown or refused.
        of = shown.rows.groupBy("window_id").agg(F.sum(F.octet_length("text") + 1).alias("size")).orderBy("window_id").limit(limit_bytes).collect()
        fits, size = 0, 0
        for r in of:
            size += r["size"]
            if size > limit_bytes and fits:
                break
            fits += 1
        if of and of[0]["size"] > limit_bytes:
            raise render.OutputTooLarge(f"{render.byte_size(of[0]['size'])} is over {render.byte_size(limit_bytes)}; show less around a match")
        ids = [r["window_id"] for r in of[:fits]]
        rows = shown.rows.where(F.col("window_id").isin(ids)).orderBy("pos").collect() if ids else []

        def made(n: int) -> str:
            some = set(ids[:n])
            lines = [f"{'>' if r['is_match'] else ' '} {render.stamp(r['ts'])} {r['author']} {r['tier']}: {r['text']}" for r in rows if r["window_id"] in some]
            left = [f"{n} of {render.plural(shown.total, 'window')} shown"] if n < shown.total else []
            return render.with_size("\n".join([render.OWN_MARK, *(lines or ["nothing found"]), *left, *shown.coverage.lines()]))

        out = fit_windows(len(ids), made, limit_bytes)[1] if ids else made(0)
        shown.close()
        return out

    def resume(self, session: str, commands: dict[str, str] | None = None) -> str:
        """One line for a shell that goes to a session's folder and resumes it; it isn't run."""
        name = filters.resolve_session(self.turns_of_all, session)
        placed = context.positions(self.turns_of_all.where(F.col("session") == name))
        first = lambda c: (context.first_value(placed, c).first() or {c: ""})[c]
        origin, cwd = first("origin"), first("cwd")
        command = (commands or {"claude-code": "claude --resume", "codex": "codex resume"}).get(origin)
        if command is None:
            raise ArchiveError(f"no way to resume sessions of {origin!r}")
        return (f"cd {render.shell_word(cwd)} && " if cwd else "") + f"{command} {render.shell_word(name)}"


def doctor(archive: Archive, root: str, provider: str = "claude-code", **how) -> dict:
    """Health of an archive: as found, after reading everything again, and what the transcripts hold that isn't known."""
    from ..sources import decode, transcripts

    before = archive.verify()
    update = archive.update(root, provider, force=True, **how)
    found = transcripts.files(archive.spark, root)
    fits = transcripts.is_codex if provider == "codex" else transcripts.is_claude
    read = transcripts.lines(found.where(fits(F.col("path")))).persist()
    seen = decode.OBSERVERS[provider](read)
    unknown = {r["type"]: r["n"] for r in seen["unknown"].orderBy(F.desc("n"), "type").collect()}  # as many as kinds of record
    out = {"found": before, "after": archive.verify(), "update": update, "observed": seen["counts"].first().asDict(), "unknown_types": unknown, **transcripts.stat(found).first().asDict(), **archive.coverage()}
    read.unpersist()
    seen = out["observed"]
    out["warnings"] = [f"{len(before)} files weren't as written"] * bool(before) + [f"unknown record types: {', '.join(unknown)}"] * bool(unknown) + ["files are much younger than what they hold"] * bool((out["skew_days"] or 0) > 30)
    out["warnings"] += ["no record says what was typed, though people wrote"] * bool(seen.get("human_shaped") and not seen.get("typed"))
    out["warnings"] += [f"{out['compressed_files']} compressed transcripts are not read"] * bool(out["compressed_files"])
    out["at"] = datetime.datetime.now(datetime.UTC)
    return out


GUIDE = """find TEXT: which sessions; turns TEXT: which passages; when TEXT: in which months; show SESSION [TEXT]: the context.
Terms are substrings, case aside; "quotes" make a phrase; a turn needs the most terms any turn has, or one fewer.
Tool calls and their results are searched only when asked for, and every answer says what it left out."""
