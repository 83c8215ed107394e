"""Removal of repeated passages with repeated-phrase automata.

A window is ``width`` consecutive words of one document. A word goes when a window that covers it also starts earlier:
in a smaller doc_id, or earlier in the same document. Documents are dealt by id into chunks of a few MB, sorted by id:

1. *Confirm recurring phrases.* Each window names one of its ``phrase``-word runs, the one of least hash (winnowing), so
   equal windows name equal phrases. A chunk sends the hash of each phrase it names once, with one position; phrases
   named in two chunks, or twice in one, are recurring, and their positions return to the chunks that sent them.
2. *Compile sharded automata.* A chunk compiles its recurring phrases, as word numbers of two letters each, into an
   Aho-Corasick automaton (pyahocorasick) and streams all its documents through it. Every window around an occurrence
   is a candidate: no other window can recur.
3. *Decide.* Of equal candidate windows in a chunk only the earliest needs a global answer; later ones go at once. The
   earliest ones meet by window hash, and all but those in the smallest doc_id go.
4. *Remove.* Positions return to their chunk, where the covered words are cut from the texts.

Hashes travel in packed arrays, sorted and deduplicated by chunk, so a phrase or window in a third of all rows is sent
once a chunk rather than once an occurrence. Window equality is that of a 64-bit hash of the 20 words' 64-bit hashes.

Defined cases: a null text has no words; texts shorter than a window lose nothing; rows that share a doc_id stand at
the same place, so a window equal at the same start in both doesn't start earlier in either; a null doc_id comes after
all others; an empty table gives an empty result; columns besides id and text aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, rolling, text_bytes

LAST = np.iinfo(np.int64).max


class Chunk:
    """The documents of a chunk in the order of their ids: one row of words, with where each document begins and ends."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        self.null = np.asarray(ids.is_null())
        keys = np.asarray(ids.fill_null(LAST), dtype=np.int64)
        texts = raw_bytes(table.column("text").combine_chunks())
        order = sorted(range(len(texts)), key=lambda i: (keys[i], texts[i] or b""))
        self.ids, self.null = keys[order], self.null[order]
        self.words = [(texts[i] or b"").split() for i in order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def number(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word in this chunk, and the 64-bit code of each number."""
        known: dict[bytes, int] = {}
        numbers = np.empty(int(self.sizes.sum()), np.int64)
        for words, a, b in zip(self.words, self.starts.tolist(), self.ends.tolist(), strict=True):
            for w in words:
                if w not in known:
                    known[w] = len(known)
            numbers[a:b] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return numbers, np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))

    def valid(self, width: int) -> np.ndarray:
        """For each position, whether a window of ``width`` words of one document starts there."""
        ok = np.zeros(len(self), bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if b - a >= width:
                ok[a : b - width + 1] = True
        return ok

    def __len__(self) -> int:
        return int(self.sizes.sum())

    def doc_at(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")


def named_phrases(codes: np.ndarray, valid: np.ndarray, width: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the phrase of least hash in each window, each position once."""
    if not valid.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = rolling(codes, phrase)
    span = width - phrase + 1
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    starts = np.flatnonzero(valid[: len(view)])
    marks = np.zeros(len(runs), bool)
    for i in range(0, len(starts), 100_000):
        at = starts[i : i + 100_000]
        marks[at + view[at].argmin(1)] = True
    positions = np.flatnonzero(marks)
    return runs[positions], positions


def occurrences(numbers: np.ndarray, patterns: np.ndarray, phrase: int) -> np.ndarray:
    """Start of every occurrence in ``numbers`` of the phrases that stand at ``patterns``, by one automaton."""
    import ahocorasick

    # A state's branches are searched in a row, and thousands of phrases begin with as many words at the root. So a word is
    # spelled with two letters, the second from an alphabet of its own: branches grow with the root of the number of words.
    base = math.isqrt(int(numbers.max(initial=0))) + 1
    text = np.stack([numbers // base, numbers % base + base], 1).astype(np.uint32).tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in (2 * patterns).tolist():
        automaton.add_word(text[p : p + 2 * phrase])
    if not len(automaton):
        return np.empty(0, np.int64)
    automaton.make_automaton()
    return np.fromiter((end for end, _ in automaton.iter(text)), np.int64) // 2 - (phrase - 1)


def _packed(buckets: np.ndarray, chunk: int, kind: int, **columns: np.ndarray) -> list[tuple]:
    """A row for each bucket: its entries of each column, packed."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    return [(int(buckets[at[0]]), chunk, kind, *[c[at].tobytes() for c in columns.values()]) for at in np.split(order, cuts) if len(at)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())])
SENT_SQL = "bucket int, chunk int, kind int, hashes binary, ids binary, places binary"
BACK = pa.schema([("chunk", pa.int32()), ("places", pa.binary())])
BACK_SQL = "chunk int, places binary"


def _places(table: pa.Table) -> np.ndarray:
    found = [np.frombuffer(x, np.uint32) for x in table.column("places").to_pylist()]
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a bucket: hash, id, place, and the row they came in."""
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    sizes = [len(h) for h in hashes]
    ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
    places = [np.frombuffer(x, np.uint32) for x in table.column("places").to_pylist()]
    return np.concatenate(hashes), np.concatenate(ids), np.concatenate(places), np.repeat(np.arange(len(sizes)), sizes)


def _answers(table: pa.Table, rows: np.ndarray, places: np.ndarray, chosen: np.ndarray) -> list[tuple]:
    chunks = table.column("chunk").to_pylist()
    at = np.flatnonzero(chosen)
    cuts = np.flatnonzero(np.diff(rows[at])) + 1
    return [(chunks[rows[part[0]]], places[part].tobytes()) for part in np.split(at, cuts) if len(part)]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, phrase: int = 8, chunk_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(documents dealt into chunks, positions in each chunk where windows start that go)."""
    size = text_bytes(docs, text_col)
    n_chunks, n_buckets = max(1, -(-size // chunk_bytes)), max(1, -(-size // bucket_bytes))
    dealt = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_chunks)).cast("int").alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def name(key: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        numbers, codes = chunk.number()
        hashes, places = named_phrases(codes[numbers], chunk.valid(width), width, phrase)
        unique, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        often = (counts > 1).astype(np.int64)
        rows = _packed((unique >> np.uint64(20)) % np.uint64(n_buckets), key[0].as_py(), 0, h=unique, i=often, p=places[first].astype(np.uint32))
        return _table(rows, SENT)

    def confirm(table: pa.Table) -> pa.Table:
        hashes, often, places, rows = _joined(table)
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        seen = counts + np.bincount(inverse, often)
        return _table(_answers(table, rows, places, seen[inverse] > 1), BACK)

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([], SENT)
        chunk, me = Chunk(left), key[0].as_py()
        numbers, codes = chunk.number()
        found = occurrences(numbers, _places(right), phrase)
        near = np.zeros(len(chunk) + 1, np.int64)
        np.add.at(near, np.maximum(found - (width - phrase), 0), 1)
        np.add.at(near, found + 1, -1)
        places = np.flatnonzero((np.cumsum(near)[:-1] > 0) & chunk.valid(width))
        if not len(places):
            return _table([], SENT)
        hashes = rolling(codes[numbers], width)[places]
        doc = chunk.doc_at(places)
        order = np.argsort(hashes, kind="stable")
        new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the earliest equal window in this chunk
        earliest = np.empty(len(places), np.int64)
        earliest[order] = head
        start = places - chunk.starts[doc]
        later = (chunk.ids[doc] > chunk.ids[doc[earliest]]) | ((chunk.ids[doc] == chunk.ids[doc[earliest]]) & (start > start[earliest]))
        ask = ~later
        rows = _packed((hashes[ask] >> np.uint64(20)) % np.uint64(n_buckets), me, 0, h=hashes[ask], i=chunk.ids[doc[ask]], p=places[ask].astype(np.uint32))
        if later.any():
            rows.append((me % n_buckets, me, 1, b"", b"", places[later].astype(np.uint32).tobytes()))
        return _table(rows, SENT)

    def decide(table: pa.Table) -> pa.Table:
        passed = table.filter(pa.compute.equal(table.column("kind"), 1))
        out = [(c, p) for c, p in zip(passed.column("chunk").to_pylist(), passed.column("places").to_pylist(), strict=True)]
        asked = table.filter(pa.compute.equal(table.column("kind"), 0))
        if len(asked):
            hashes, ids, places, rows = _joined(asked)
            order = np.argsort(hashes, kind="stable")
            heads = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
            least = np.minimum.reduceat(ids[order], heads)
            go = np.empty(len(ids), bool)
            go[order] = ids[order] > np.repeat(least, np.diff(np.r_[heads, len(order)]))
            out += _answers(asked, rows, places, go)
        return _table(out, BACK)

    sent = dealt.groupBy("chunk").applyInArrow(name, SENT_SQL)
    recurring = sent.groupBy("bucket").applyInArrow(confirm, BACK_SQL)
    asked = dealt.groupBy("chunk").cogroup(recurring.groupBy("chunk")).applyInArrow(locate, SENT_SQL)
    return dealt, asked.groupBy("bucket").applyInArrow(decide, BACK_SQL)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, **how) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    dealt, gone = removals(docs, id_col, text_col, width, **how)

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        marks = np.zeros(len(chunk) + width + 1, np.int64)
        places = _places(right)
        np.add.at(marks, places, 1)
        np.add.at(marks, places + width, -1)
        covered = np.cumsum(marks) > 0
        kept, removed = [], []
        for words, a, b in zip(chunk.words, chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            out = covered[a:b]
            n = int(out.sum())
            removed.append(n)
            kept.append(b" ".join(words if not n else [w for w, c in zip(words, out.tolist(), strict=True) if not c]))
        ids = pa.array(chunk.ids, mask=chunk.null)
        return pa.Table.from_arrays([ids, pa.array(chunk.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return dealt.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def brute_force(rows: list[tuple[int, str | None]], width: int = 20) -> dict[int, tuple[int, int, str]]:
    """The same by a table of all windows, for tests: doc_id -> (n_words, n_removed, sha256 of the kept text)."""
    first: dict[tuple, tuple] = {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(split):
        for i in range(len(split[d]) - width + 1):
            first.setdefault(tuple(split[d][i : i + width]), (d, i))
    out = {}
    for d, words in split.items():
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < (d, i):
                gone.update(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = len(words), len(gone), hashlib.sha256(kept).hexdigest()
    return out
