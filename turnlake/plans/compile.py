"""From query text to terms: the only plan that is built on the driver."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field, replace

from .. import schema as S
from ..functions.text import fold_text
from .errors import UsageError


class QueryError(UsageError):
    """A query or option that can't be run."""


_SYNONYMS: dict[str, list[str]] = {}
for _a, _b in S.SYNONYM_PAIRS:
    _SYNONYMS.setdefault(_a, []).append(_b)
    _SYNONYMS.setdefault(_b, []).append(_a)


@dataclass(frozen=True)
class Term:
    """``needle`` is searched as a substring, ``synonyms`` as whole words, ``substitutes`` as substrings."""

    text: str
    needle: str
    phrase: bool = False
    synonyms: tuple[str, ...] = ()
    substitutes: tuple[str, ...] = ()


@dataclass(frozen=True)
class CompiledQuery:
    terms: tuple[Term, ...]
    exclude: tuple[Term, ...] = ()
    strict: bool = False
    dropped: tuple[str, ...] = ()
    exact: bool = False
    tiers: tuple[str, ...] = field(default=("conversation",))

    def widened(self, substitutes: dict[str, list[str]]) -> CompiledQuery:
        """The terms with corpus words in place of their synonyms."""
        return replace(self, terms=tuple(replace(t, synonyms=(), substitutes=tuple(substitutes[t.text])) if t.text in substitutes else t for t in self.terms))


def split_terms(text: str) -> list[tuple[str, bool]]:
    """(term, quoted): cut at white space but for what stands in double quotes; an open quote runs to the end."""
    out: list[tuple[str, bool]] = []
    for i, part in enumerate(text.split('"')):
        if i % 2:
            out += [(part, True)] if part else []
        else:
            out += [(w, False) for w in part.split()]
    return out


def stem(word: str) -> str:
    """The word less the first suffix that leaves enough of it."""
    for suffix in S.SUFFIXES:
        if word.endswith(suffix) and len(word.encode()) - len(suffix) >= S.MIN_STEM:
            return word[: -len(suffix)]
    return word


def _term(raw: str, quoted: bool, exact: bool) -> Term:
    text = fold_text(raw)
    if exact or quoted:
        return Term(text, text, quoted)
    return Term(text, stem(text), False, tuple(_SYNONYMS.get(text, ())))


def tiers_of(tools: bool = False, results: bool = False) -> tuple[str, ...]:
    return tuple(t for t, on in zip(S.TIERS, (True, tools, results), strict=True) if on)


def compile_query(text: str, exclude: tuple[str, ...] | list[str] = (), all_terms: bool = False, exact: bool = False, tiers: tuple[str, ...] = ("conversation",)) -> CompiledQuery:
    raw = split_terms(text)
    dropped: list[str] = []
    if len(raw) > 2:
        kept = [(w, q) for w, q in raw if q or w.lower() not in S.STOPWORDS]
        if len(kept) >= 2:
            dropped = [w for w, q in raw if not q and w.lower() in S.STOPWORDS]
            raw = kept
    terms: dict[str, Term] = {}
    for word, quoted in raw:
        term = _term(word, quoted, exact)
        terms.setdefault(term.text, term)
    out = [_term(w, q, exact) for e in exclude for w, q in split_terms(e)]
    return CompiledQuery(tuple(terms.values()), tuple(out), all_terms, tuple(dropped), exact, tuple(t for t in S.TIERS if t in tiers))


_UNITS = {"h": 1, "d": 24, "w": 24 * 7, "m": 24 * 30, "y": 24 * 365}


def parse_when(text: str, now: datetime.datetime | None = None) -> datetime.datetime:
    """A relative age (hours, days, weeks, 30-day months, 365-day years) or a date or time; a date is its midnight in UTC."""
    now = now or datetime.datetime.now(datetime.UTC)
    if m := re.fullmatch(r"(\d+)([hdwmyHDWMY])", text.strip()):
        return now - datetime.timedelta(hours=int(m[1]) * _UNITS[m[2].lower()])
    for shape in ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y-%m"):
        try:
            at = datetime.datetime.strptime(text.strip(), shape)
        except ValueError:
            continue
        return at if at.tzinfo else at.replace(tzinfo=datetime.UTC)
    raise QueryError(f"not a time: {text!r}")


def check_options(limit: int = 10, hits: int = 3, sort: str = "concentration", since: datetime.datetime | None = None, until: datetime.datetime | None = None, mine: bool = False, author: str = "") -> None:
    if limit <= 0:
        raise QueryError("limit must be positive")
    if hits < 0:
        raise QueryError("hits must not be negative")
    if sort not in ("concentration", "chronological", "recent"):
        raise QueryError(f"unknown sort {sort!r}")
    if since and until and since > until:
        raise QueryError("since is after until")
    if author not in ("", "human", "assistant", "agent", "system"):
        raise QueryError(f"unknown author {author!r}")
    if mine and author and author != "human":
        raise QueryError("mine and author exclude each other")
