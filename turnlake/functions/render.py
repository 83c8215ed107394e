"""Text of answers, over the few rows an answer shows: snippets, sizes, ages, shell words."""

from __future__ import annotations

import datetime
import json
import re

SNIPPET = 140
EDGE = 16
MAX_BYTES = 65_536
#: First line of every answer in text, by which a recorded answer is known again.
OWN_MARK = "[turnlake answer]"


class OutputTooLarge(RuntimeError):
    """An answer beyond the byte cap; it is refused, not cut."""


def collapse(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def _rune_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def located(size: int, offset: int, length: int) -> tuple[int, int]:
    """A span within a text; an impossible one is none."""
    return (offset, length) if 0 <= offset <= size and length >= 0 and offset + length <= size else (0, 0)


def snippet(text: str, offset: int, length: int, width: int = SNIPPET) -> str:
    """One line around a match, marked, its edges moved to a space near by."""
    raw = text.encode()
    offset, length = located(len(raw), offset, length)
    spare = max(width - length, 0) // 2
    lo, hi = max(offset - spare, 0), min(offset + length + spare, len(raw))
    if 0 < lo and (at := raw.find(b" ", lo, min(lo + EDGE, offset))) >= 0:
        lo = at + 1
    if hi < len(raw) and (at := raw.rfind(b" ", max(hi - EDGE, offset + length), hi)) >= 0:
        hi = at
    lo, hi = _rune_start(raw, lo), _rune_start(raw, hi)
    before, match, after = (collapse(x.decode("utf-8", "replace")) for x in (raw[lo:offset], raw[offset : offset + length], raw[offset + length : hi]))
    marked = f"{before}«{match}»{after}" if length else before + after
    return ("…" if lo else "") + marked.strip() + ("…" if hi < len(raw) else "")


def excerpt(text: str, offset: int, width: int) -> str:
    """At most ``width`` bytes around a place, line breaks kept."""
    raw = text.encode()
    if len(raw) <= width:
        return text
    lo = min(max(offset - width // 2, 0), len(raw) - width)
    lo = _rune_start(raw, lo)
    hi = _rune_start(raw, lo + width)
    return ("…" if lo else "") + raw[lo:hi].decode("utf-8", "replace") + ("…" if hi < len(raw) else "")


def byte_size(n: int) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def duration(seconds: float) -> str:
    return f"{seconds * 1000:.0f} ms" if seconds < 1 else f"{seconds:.1f} s"


def plural(n: int, word: str) -> str:
    return f"{n:,} {word}" + ("" if n == 1 else "s")


def ago(at: datetime.datetime | None, now: datetime.datetime) -> str:
    if at is None:
        return "undated"
    days = (now - at).days
    return "today" if days < 1 else "yesterday" if days == 1 else f"{days} days ago"


def stamp(ts: str | datetime.datetime | None) -> str:
    """A time in full, in UTC; what isn't one is undated."""
    if isinstance(ts, str):
        try:
            ts = datetime.datetime.fromisoformat(ts)
        except ValueError:
            return "undated"
    if ts is None:
        return "undated"
    return (ts.astimezone(datetime.UTC) if ts.tzinfo else ts).strftime("%Y-%m-%dT%H:%M:%SZ")


#: Colours by what is shown; sizes are measured without them.
PALETTE = {"handle": "36", "key": "1", "match": "33", "note": "2"}


def coloured(text: str, kind: str, on: bool = True) -> str:
    return f"\x1b[{PALETTE[kind]}m{text}\x1b[0m" if on else text


def day(at: datetime.datetime | None) -> str:
    return at.strftime("%Y-%m-%d") if at else "undated"


def date_range(first: datetime.datetime | None, last: datetime.datetime | None) -> str:
    return day(first) if day(first) == day(last) else f"{day(first)}..{day(last)}"


def token_estimate(text: str) -> int:
    return -(-len(plain(text).encode()) // 4)


def plain(text: str) -> str:
    """Without terminal colours."""
    return re.sub(r"\x1b\[[0-9;]*m", "", text)


def with_size(text: str) -> str:
    """A last line that counts itself."""
    out = text
    for _ in range(3):
        line = f"\n{byte_size(len(plain(out).encode()))}, about {token_estimate(out)} tokens"
        out = text + line
    return out


def shell_word(word: str) -> str:
    return word if word and re.fullmatch(r"[A-Za-z0-9_@%+=:,./-]+", word) else "'" + word.replace("'", "'\\''") + "'"


def capped(text: str, limit: int = MAX_BYTES) -> str:
    size = len(plain(text).encode())
    if size > limit:
        raise OutputTooLarge(f"{byte_size(size)} is over {byte_size(limit)}; narrow the query or lower the limit")
    return text


def as_json(rows: list[dict], lines: bool = False) -> str:
    dump = lambda x: json.dumps(x, ensure_ascii=False, default=str)
    return "\n".join(map(dump, rows)) if lines else dump(rows)
