"""Answers: the rows of a verb, what was and wasn't searched, and their text in several forms.

Everything here works on rows that an answer shows, which its limits bound; nothing reads the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import render


@dataclass
class Coverage:
    """What an answer did and didn't read."""

    tiers: tuple[str, ...]
    unsearched: list[str]
    terms: list[str]
    dropped: list[str]
    required: int
    carried: list[str]
    missing: list[str]
    counts: dict
    dropped_turns: dict
    scope: str
    notes: list[str] = field(default_factory=list)
    reports: list[dict] = field(default_factory=list)
    substitutes: dict = field(default_factory=dict)
    synonyms: dict = field(default_factory=dict)
    limits: list[str] = field(default_factory=list)
    boundaries: Callable[[], dict] = dict
    work: Callable[[], dict] = dict
    passes: int = 1
    seconds: float = 0.0

    def lines(self) -> list[str]:
        """Tiers, turns, boundaries, how the query was read, filters, limits, notes and work."""
        c, out = self.counts, []
        out.append(f"searched: {', '.join(self.tiers)}; not searched: {', '.join(self.unsearched) or 'nothing'}")
        out.append(f"{c.get('turns_searched', 0):,} of {render.plural(c.get('turns', 0), 'turn')} in {c.get('sessions_searched', 0):,} of {render.plural(c.get('sessions', 0), 'session')}, scope {self.scope or 'all'}")
        if at := self.boundaries():
            out.append(f"content {render.date_range(at.get('content_from'), at.get('content_to'))}; {render.plural(at.get('live_files') or 0, 'live file')} since {render.day(at.get('live_from'))}" + (f"; {render.plural(at['compressed_files'], 'compressed file')} not read" if at.get("compressed_files") else "") + (f"; a file is {at['skew_days']} days younger than what it holds" if (at.get("skew_days") or 0) > 30 else ""))
        if self.dropped:
            out.append(f"words left out of the query: {', '.join(self.dropped)}")
        if self.terms and self.required < len(self.terms) and self.carried:
            out.append(f"at least {self.required} of {len(self.terms)} terms in a turn" + (f"; none carries {', '.join(self.missing)}" if self.missing else ""))
        out += [f"{t} also as {', '.join(s)}" for t, s in self.synonyms.items()]
        out += [f"{t} read as {', '.join(s)}" for t, s in self.substitutes.items()]
        out += [f"left out: {render.plural(n, 'turn')} by {why}" for why, n in sorted(self.dropped_turns.items())]
        out += [*self.limits, *self.notes]
        work = self.work()
        done = f"{render.plural(self.passes, 'pass').replace('passs', 'passes')} in {render.duration(self.seconds)}"
        out.append(f"{render.byte_size(work['bytes'])}, {render.plural(work['words'], 'word')} read in {done}" if work else done)
        return out


@dataclass
class Answer:
    rows: DataFrame
    coverage: Coverage
    total: int = 0
    extra: dict[str, DataFrame] = field(default_factory=dict)
    query: str = ""
    held: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        """Give back the memory that frames of this answer take."""
        for df in self.held:
            df.unpersist()

    def _rows(self, limit: int | None = None) -> list[dict]:
        rows = self.rows if limit is None else self.rows.limit(limit)
        return [r.asDict(recursive=True) for r in rows.collect()]  # an answer's rows are few

    def _matched(self, sessions: list[str], hits: int) -> dict[str, list[dict]]:
        """The best matched turns of the sessions shown, in time."""
        if "matched" not in self.extra or not hits or not sessions:
            return {}
        out: dict[str, list[dict]] = {}
        for r in self.extra["matched"].where(self.extra["matched"]["session"].isin(sessions)).orderBy("session", "pos").collect():
            out.setdefault(r["session"], []).append(r.asDict())
        return {s: sorted(sorted(m, key=lambda r: (-r["signal"], -r["occurrences"], r["pos"]))[:hits], key=lambda r: r["pos"]) for s, m in out.items()}

    def miss(self) -> list[str]:
        """What a search that found nothing, or too little, can say: by term, elsewhere, and what to try."""
        c, out = self.coverage, []
        if not self.total:
            out.append(f"nothing found for {self.query!r} in {c.scope or 'all'}")
        if "elsewhere" in self.extra:
            found = self.extra["elsewhere"].orderBy(self.extra["elsewhere"]["hits"].desc(), "repo").collect()
            if found:
                out.append(f"elsewhere: {render.plural(sum(r['hits'] for r in found), 'hit')} in {render.plural(len(found), 'repo')}")
                out += [f"  {r['repo']}: {render.plural(r['hits'], 'hit')}, {render.plural(r['sessions'], 'session')}" for r in found]
                out.append(f"try: find {render.shell_word(self.query)} --all")
        for r in c.reports:
            if r["turns"]:
                out.append(f"  {r['term']}: in {render.plural(r['turns'], 'turn')}, not with the others")
            elif r["nearby"]:
                out.append(f"  {r['term']}: in no turn; near it: {', '.join(x['token'] for x in r['nearby'])}")
            else:
                out.append(f"  {r['term']}: in no turn, and nothing is near it")
        return out

    def body(self, limit: int | None = None, hits: int = 3, brief: bool = False) -> list[str]:
        rows = self._rows(limit)
        matched = {} if brief else self._matched([r["session"] for r in rows if "session" in r], hits)
        out = []
        for r in rows:
            if "score" in r and "hits" in r:
                place = " ".join(x for x in (render.date_range(r["first"], r["last"]), r["repo"], r["branch"], f"{render.plural(r['hits'], 'hit')} in {render.plural(r['hit_turns'], 'turn')} of {r['turns']}") if x)
                out.append(f"{r['session']}  {place}")
                out += [f"  {render.stamp(m['ts'])} {m['author']} {m['tier']} x{m['occurrences']}" for m in matched.get(r["session"], [])]
            else:
                out.append("  ".join(f"{k}={v}" for k, v in r.items() if k not in ("digest", "nbytes")))
        return out

    def text(self, limit_bytes: int = render.MAX_BYTES, limit: int | None = None, hits: int = 3, brief: bool = False) -> str:
        out = self.body(limit, hits, brief) + self.miss()
        return render.capped(render.with_size("\n".join([render.OWN_MARK, *(out or ["nothing found"]), *self.coverage.lines()])), limit_bytes)

    def fitted(self, tokens: int, limit: int = 10, hits: int = 3) -> str:
        """The fullest text within a budget of tokens: fewer matched turns, then none, then fewer sessions."""
        steps = [(limit, hits, False), (limit, 1, False), (limit, 0, True), (max(limit // 2, 1), 0, True), (1, 0, True)]
        for n, h, brief in steps:
            made = self.text(1 << 40, n, h, brief)
            if render.token_estimate(made) <= tokens:
                return made
        return render.capped(made, 4 * tokens)

    def json(self, lines: bool = False) -> str:
        return render.capped(render.as_json(self._rows(), lines))

    def ids(self) -> list[str]:
        return [r["session"] for r in self.rows.select("session").distinct().orderBy("session").collect()]

    def records(self, hits: int = 3) -> Iterator[str]:
        """NUL-ended records for a chooser: the session, a tab, and its block of text."""
        rows = self._rows()
        matched = self._matched([r["session"] for r in rows], hits)
        for r in rows:
            block = [f"{r['session']}\t{render.date_range(r['first'], r['last'])} {r['repo']}", *[f"  {render.stamp(m['ts'])} {m['author']} {m['tier']}" for m in matched.get(r["session"], [])]]
            yield "\n".join(block) + "\0"


def fit_windows(count: int, text_of: Callable[[int], str], limit_bytes: int = render.MAX_BYTES) -> tuple[int, str]:
    """The most windows whose text is within a limit, by bisection; one is always tried, and refused if it is too large."""
    low, high, best = 1, count, (0, "")
    while low <= high:
        middle = (low + high) // 2
        made = text_of(middle)
        if len(render.plain(made).encode()) <= limit_bytes:
            best, low = (middle, made), middle + 1
        else:
            high = middle - 1
    return best if best[0] else (1, render.capped(text_of(1), limit_bytes))
