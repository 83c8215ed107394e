"""Column expressions over turn texts: folding, matching, spans, time, scores. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

WORD_BYTE = r"[a-z0-9\x{80}-\x{10ffff}]"
RUN = 256
SEGMENT_EDGE = r"^([a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[0-9][A-Za-z]|[A-Za-z][0-9])"


def fold(text: Column) -> Column:
    """Lower case that keeps every byte position: a character whose lower case has another width stays."""
    guarded = F.translate(text, S.WIDTH_CHANGING + "Σ", S.SHIELDS + "σ")
    return F.translate(F.lower(guarded), S.SHIELDS, S.WIDTH_CHANGING)


def fold_text(text: str) -> str:
    """``fold`` of a Python string, for queries."""
    out = []
    for c in text:
        low = c.lower()
        out.append(low if len(low) == 1 and len(low.encode()) == len(c.encode()) else c)
    return "".join(out)


def java_quote(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def carries(folded: Column, needle: str) -> Column:
    return F.contains(folded, F.lit(needle))


def carries_word(folded: Column, needle: str) -> Column:
    """Whether a needle stands as a word of a folded text; beside a letter a digit is a boundary, and the other way round."""
    edge = lambda c: r"a-z" if c.isascii() and c.isalpha() else r"0-9" if c.isdigit() else r"a-z0-9"
    before, after = edge(needle[0]), edge(needle[-1])
    return F.rlike(folded, F.lit(rf"(?<![{before}\x{{80}}-\x{{10ffff}}]){java_quote(needle)}(?![{after}\x{{80}}-\x{{10ffff}}])"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(raw: Column, folded: Column, needle: str, word_only: bool = False) -> Column:
    """All non-overlapping occurrences of a needle, from the left: array of (offset, length in bytes, match).

    The text is split once, and offsets are a running sum over its parts. Occurrences are gathered in runs of ``RUN``,
    so that no step copies all of those before it.
    """
    width = len(needle.encode())
    none = F.array().cast("array<struct<offset:int,length:int,match:string>>")

    def body(v: Column) -> Column:
        parts, data = v["parts"], v["data"]
        last = F.size(parts) - 1

        def step(state: Column, i: Column) -> Column:
            before, after = F.element_at(parts, i), F.element_at(parts, i + 1)
            offset = state["offset"] + F.octet_length(before)
            prev = F.when(before != "", F.right(before, F.lit(1))).when(i == 1, F.lit("")).otherwise(F.lit(needle[-1]))
            follow = F.when(after != "", F.left(after, F.lit(1))).when(i == last, F.lit("")).otherwise(F.lit(needle[0]))
            # Bytes do: the edge of a segment lies between ASCII characters, and bytes are found without a scan.
            edge = lambda p: (p > 0) & F.rlike(F.substring(data, F.greatest(p, F.lit(1)), F.lit(3)).cast("string"), F.lit(SEGMENT_EDGE))
            lead = ~F.rlike(prev, F.lit(WORD_BYTE)) | edge(offset)
            trail = ~F.rlike(follow, F.lit(WORD_BYTE)) | edge(offset + width)
            kind = F.when(lead & trail, "word").when(lead, "prefix").otherwise("inside")
            one = F.array(F.struct(offset.cast("int").alias("offset"), F.lit(width).alias("length"), kind.alias("match")))
            found = F.when(kind == "word", F.concat(state["found"], one)).otherwise(state["found"]) if word_only else F.concat(state["found"], one)
            return F.struct((offset + width).alias("offset"), found.alias("found"))

        def run(state: Column, first: Column) -> Column:
            inside = F.aggregate(F.sequence(first, F.least(first + (RUN - 1), last)), F.struct(state["offset"].alias("offset"), none.alias("found")), step)
            return let(inside, lambda r: F.struct(r["offset"].alias("offset"), F.concat(state["found"], r["found"]).alias("found")))

        return F.aggregate(F.sequence(F.lit(1), last, F.lit(RUN)), F.struct(F.lit(0).alias("offset"), none.alias("found")), run, lambda s: s["found"])

    split = F.struct(F.split(folded, java_quote(needle), -1).alias("parts"), raw.cast("binary").alias("data"))
    return F.when(F.contains(folded, F.lit(needle)), let(split, body)).otherwise(none)


def parse_ts(ts: Column) -> Column:
    """An RFC 3339 time, or null: a date alone, or a time without a zone, is undated."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(F.rlike(ts, F.lit(shape)), F.try_to_timestamp(F.translate(ts, ",", ".")))


def signal(terms: Column, author: Column, match: Column, nbytes: Column) -> Column:
    who = F.when(author == "system", S.SYSTEM_WEIGHT).otherwise(1.0)
    kind = F.when(match == "inside", S.INSIDE_WEIGHT).when(match == "prefix", S.PREFIX_WEIGHT).otherwise(1.0)
    length = F.when(nbytes <= 0, 1.0).otherwise(F.lit(float(S.TURN_SCALE)) / (nbytes + S.TURN_SCALE))
    return F.greatest(terms, F.lit(1)).cast("double") * who * kind * length


def score(total: Column, turns: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(total / (F.greatest(turns, F.lit(0)) + S.SHRINKAGE))


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(f"({WORD_BYTE}+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"([^ \t\n\r]+)"), F.lit(1)))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def remote_id(raw: Column) -> Column:
    """host/path of a git remote: scheme, user, port and ``.git`` dropped, case folded."""
    u = F.regexp_replace(F.trim(raw), "/+$", "")
    schemed, scp = F.contains(u, F.lit("://")), F.rlike(u, F.lit("^[^/:]+:"))
    rest = F.regexp_replace(u, "^.*?://", "")
    host = F.when(schemed, F.regexp_replace(F.regexp_extract(rest, "^([^/]*)", 1), "^.*@", "")).when(scp, F.regexp_replace(F.regexp_extract(u, "^([^:]*)", 1), "^.*@", "")).otherwise("")
    host = F.when(schemed, F.regexp_replace(host, ":[^:]*$", "")).otherwise(host)
    path = F.when(schemed, F.regexp_replace(rest, "^[^/]*/?", "")).when(scp, F.regexp_replace(u, "^[^:]*:", "")).otherwise(u)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"\.git$", ""), "^/+|/+$", "")
    return F.lower(F.concat(host, F.when((host != "") & (path != ""), "/").otherwise(""), path))

