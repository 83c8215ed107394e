"""Benchmark decontamination: documents that hold a benchmark item up to a few edits.

Texts and items are compared as sequences of words (A-Z folded, ASCII punctuation dropped). A document is contaminated
by an item of n words if some window of it is within ``e = floor((1 - similarity) * n)`` word edits of the item.

A CGK walk drifts apart with the square of the edits, so whole items of 100 words and 20 deletions hardly ever meet. An
item is therefore cut into m segments of ``c`` words (the largest c up to ``SEGMENT`` with ``e // m <= 1``): of e edits
some segment has one at most, wherever they fall. Segments of one size c are searched together:

1. *Filter, exact.* One edit spoils at most two of a segment's c - 1 word pairs, so of the document's windows only those
   with c - 3 pairs of the benchmark's within c + 1 words are looked at.
2. *CGK embedding and bit-sampling LSH.* A random walk reads the window: at step t it emits the word it stands on, and a
   hash of (round, t, word) says whether it moves on. Walks over texts an edit apart soon fall into step again, so edit
   distance becomes Hamming distance. Each round samples ``bits`` places of a walk of its own; windows and segments that
   agree on all of them are candidates. The number of rounds follows from ``target``: walks over random segments with one
   deletion, insertion or substitution are simulated, and rounds are added until the kind that is missed most often is
   found with that probability (``rounds_for``, on the driver). Segments without edits meet in any round.
3. *Exact verification*: a candidate says in which stretch of n + 2e words its item may lie. Stretches without
   n - 1 - 2e pairs of the benchmark's, or n - e words of the item, are left out, exactly; the others are held against
   the whole item by bit-parallel edit distance.

The benchmark goes to executors whole up to ``block_bytes`` of text; a larger one is searched in blocks of that size, one
pass over the rows after the other, each adding what it found to the row itself. The rows are the same for any block size.

Defined cases: null or empty texts match nothing; items without a word, or without an id, are left out; with an empty
benchmark nothing is contaminated; repeated rows, and rows that share an id or have none, each get their own row; an
empty table gives an empty result; columns besides the id and text columns aren't read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, BoundedCodes, mix64, raw_bytes, text_bytes

PUNCTUATION = string.punctuation.encode()
FILTER_BITS = 20
SEGMENT = 8
PAD = np.uint64(0)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(None, PUNCTUATION).split()


def pairs_of(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(codes[:-1] * MIX_A + codes[1:])


def edits_within(item: list[int], text: list[int], most: int) -> int | None:
    """Least edits between an item and a text that begins with it, its end free; None beyond ``most``."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    left = min(len(text), m + most)
    for w in text[: m + most]:
        if score - left > most:  # each further word takes one edit away at most
            break
        left -= 1
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        best = min(best, score)
    return best if best <= most else None


def edits_inside(item: list[int], text: list[int], most: int) -> int | None:
    """Least edits between an item and any part of a text; None beyond ``most``."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full  # no 1 comes in: the part may begin anywhere
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        best = min(best, score)
    return best if best <= most else None


def segment_size(n: int, edits: int) -> int:
    """The largest segment of an item of n words whose number leaves one of them with an edit at most."""
    return next(c for c in range(min(n, SEGMENT), 0, -1) if edits // (n // c) <= (1 if c > 4 else 0) or c == 1)


class Walks:
    """The CGK walks over segments of one size, and the places each round samples."""

    def __init__(self, size: int, rounds: int, bits: int, seed: int, edits: int = 1):
        rng = np.random.Generator(np.random.PCG64([seed, size]))
        steps = int(1.6 * size) if edits else size  # without edits, a walk never leaves its segment
        self.salts = rng.integers(0, 1 << 63, (rounds, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = [sorted(rng.choice(steps, min(bits, steps), replace=False).tolist()) for _ in range(rounds)]

    def __len__(self) -> int:
        return len(self.places)

    def read(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, r: int) -> np.ndarray:
        """Hash of the places that round ``r`` samples of the walks from ``starts``; from ``ends`` on they read padding.

        ``codes`` are mixed already, and one more word stands behind them.
        """
        at, out = starts.copy(), np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for t in range(self.places[r][-1] + 1):
                word = np.where(at < ends, codes[at], PAD)
                if t in self.places[r]:
                    out = (out ^ word) * MIX_B
                    out ^= out >> np.uint64(29)
                if t < self.places[r][-1]:
                    at += ((word * self.salts[r, t]) >> np.uint64(63)).astype(np.int64)
                    np.minimum(at, ends, out=at)
        return out


def rounds_for(size: int, bits: int, target: float, seed: int, tries: int = 4000, most: int = 64) -> int:
    """Rounds until simulated segments with one edit at a random place, and other words behind, are found with
    probability ``target``."""
    rng = np.random.Generator(np.random.PCG64([seed, size]))
    walks = Walks(size, most, bits, seed)
    length = 3 * size
    plain = rng.integers(1, 1 << 63, (tries, length + 1), dtype=np.uint64)
    after = rng.integers(1, 1 << 63, (tries, length + 1), dtype=np.uint64)
    after[:, :size] = plain[:, :size]  # what follows the item's last segment in a document
    plain[:, size:] = PAD
    fresh = rng.integers(1, 1 << 63, tries, dtype=np.uint64)
    at, column = rng.integers(0, size, tries)[:, None], np.arange(length)
    cut = np.take_along_axis(after, column + (column >= at), 1)
    put = np.where(column == at, fresh[:, None], np.take_along_axis(after, column - (column > at), 1))
    swapped = np.where(column == at, fresh[:, None], after[:, :length])
    starts = np.arange(tries) * length
    walk = lambda x, r: walks.read(np.r_[x.ravel(), PAD], starts, starts + length, r)
    missed = np.ones((3, tries), bool)
    for r in range(most):
        base = walk(plain[:, :length], r)
        for kind, other in enumerate((cut, put, swapped)):
            missed[kind] &= base != walk(other, r)
        if missed.mean(1).max() <= 1 - target:
            return r + 1
    return most


def plan_rounds(items: list[tuple[int, bytes]], similarity: float = 0.8, bits: int = 3, target: float = 0.99, seed: int = 23) -> dict[int, int]:
    """Rounds for each size of segment that may have an edit."""
    lengths = {len(words_of(t)) for _, t in items}
    sizes = {(c := segment_size(n, e := int((1 - similarity) * n + 1e-9)), e // (n // c)) for n in lengths if n}
    return {c: rounds_for(c, bits, target, seed) for c, e in sorted(sizes) if e}


class Index:
    """Items by the walks over their segments."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = 0.8, bits: int = 3, target: float = 0.99, seed: int = 23, rounds: dict[int, int] | None = None):
        if not 0 < similarity <= 1:
            raise ValueError("at a similarity of 0 any text holds any item")
        self.ids, self.codes = [], []
        for item, text in items:
            if item is not None and (words := words_of(text)):
                self.ids.append(item)
                self.codes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        self.most = [int((1 - similarity) * len(c) + 1e-9) for c in self.codes]
        self.lists = [c.tolist() for c in self.codes]
        self.verified: dict[tuple[int, bytes], int | None] = {}
        self.has = [frozenset(x).__contains__ for x in self.lists]
        self.sizes, self.budget = np.array([len(c) for c in self.codes], np.int64), np.array(self.most, np.int64)
        planned = plan_rounds(items, similarity, bits, target, seed) if rounds is None else rounds
        cuts: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by size and edits of the segments: (item, place)
        for i, c in enumerate(self.codes):
            size = segment_size(len(c), self.most[i])
            count = len(c) // size
            found = cuts.setdefault((size, self.most[i] // count), [])
            found += [(i, size * k) for k in range(count)]
        #: By size and edits: the walks; of each round sorted hashes, where the entries of each begin, and entries; items and places of those.
        self.tables: dict[tuple[int, int], tuple[Walks, list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]] = {}
        for (size, edits), found in sorted(cuts.items()):
            walks = Walks(size, planned[size] if edits else 1, bits, seed, edits)
            items_of, places = np.array(found, np.int64).T
            offset = np.cumsum(self.sizes) - self.sizes
            codes, starts, ends = np.r_[mix64(np.concatenate(self.codes), 1), PAD], offset[items_of] + places, (offset + self.sizes)[items_of]
            tables = []
            for r in range(len(walks)):
                hashes = walks.read(codes, starts, ends, r)
                order = np.argsort(hashes, kind="stable")
                keys, first = np.unique(hashes[order], return_index=True)
                tables.append((keys, np.r_[first, len(order)], order, self._bitmap(keys)))
            self.tables[size, edits] = walks, tables, items_of, places
        self.pairs = np.unique(np.concatenate([pairs_of(c) for c in self.codes])) if self.codes else np.empty(0, np.uint64)
        self.bitmap = self._bitmap(self.pairs)

    @staticmethod
    def _bitmap(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << FILTER_BITS, bool)
        out[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return out

    @staticmethod
    def _among(hashes: np.ndarray, keys: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are among sorted keys, and the places of those keys."""
        maybe = np.flatnonzero(bitmap[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
        same = keys[at] == hashes[maybe]
        return maybe[same], at[same]

    def matches(self, texts: list[np.ndarray]) -> list[dict[int, float]]:
        """For each document's words the similarity of each item found in them."""
        found: list[dict[int, float]] = [{} for _ in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum() or not self.codes:
            return found
        codes = np.concatenate(texts)
        doc = np.repeat(np.arange(len(texts)), sizes)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        hit = np.zeros(len(codes), np.int64)  # whether a pair of the benchmark's begins here
        hit[self._among(pairs_of(codes), self.pairs, self.bitmap)[0]] = 1
        hit[ends[sizes > 0] - 1] = 0
        total = np.r_[0, np.cumsum(hit)]
        mixed = np.r_[mix64(codes, 1), PAD]
        stop = ends[doc]
        spots = []
        for (size, edits), (walks, tables, items, places) in self.tables.items():
            needed = size - 1 - 2 * edits
            starts = np.arange(len(codes))
            if needed > 0:
                starts = starts[total[np.maximum(np.minimum(starts + size + edits, stop) - 1, starts)] - total[starts] >= needed]
            for r, (keys, first, entries, bitmap) in enumerate(tables):
                at, key = self._among(walks.read(mixed, starts, stop[starts], r), keys, bitmap)
                if not len(at):
                    continue
                at = starts[at]
                many = first[key + 1] - first[key]
                entry = entries[np.repeat(first[key] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                at, i = np.repeat(at, many), items[entry]
                # The window may begin up to an edit off the segment.
                lo = np.maximum(at - places[entry] - self.budget[i], begins[doc[at]])
                hi = np.minimum(at - places[entry] + self.sizes[i] + self.budget[i], stop[at])
                pairs = total[np.maximum(hi - 1, lo)] - total[lo]
                spots.append(np.unique(np.stack([doc[at], i, lo, hi], 1)[pairs >= self.sizes[i] - 1 - 2 * self.budget[i]], axis=0))
        for d, i, lo, hi in np.unique(np.concatenate(spots), axis=0).tolist() if spots else []:
            item, most, of = self.lists[i], self.most[i], found[d]
            if of.get(self.ids[i]) == 1.0:
                continue
            stretch = codes[lo:hi]
            key = i, stretch.tobytes()  # repeated lines and copies bring the same stretches again
            if key not in self.verified:
                if len(self.verified) > 100_000:
                    self.verified.clear()
                words = stretch.tolist()
                likely = sum(map(self.has[i], words)) >= len(item) - most  # else too few of its words
                self.verified[key] = edits_inside(item, words, most) if likely else None
            if (e := self.verified[key]) is not None:
                of[self.ids[i]] = max(of.get(self.ids[i], 0.0), 1 - e / len(item))
        return found


def found_in(index: Index, codes: BoundedCodes, texts: list[bytes | None], group: int = 500) -> list[dict[int, float]]:
    out: list[dict[int, float]] = []
    for i in range(0, len(texts), group):
        out += index.matches([codes.codes(words_of(t)) for t in texts[i : i + group]])
    return out


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about ``block_bytes`` of text each."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    n_blocks = max(1, -(-text_bytes(items, "t") // block_bytes))
    for block in range(n_blocks):
        yield sorted((r[0], r[1].encode()) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block).collect())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_ids (sorted), best_similarity (null if none)."""
    none = F.array().cast("array<long>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), none.alias("item_ids"), F.lit(None).cast("double").alias("best_similarity"))
    for held in _blocks(benchmark, item_col, item_text, block_bytes):  # each pass adds to the rows what its block has; no shuffle
        shared = docs.sparkSession.sparkContext.broadcast((held, plan_rounds(held, similarity)))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            index, codes = Index(shared.value[0], similarity, rounds=shared.value[1]), BoundedCodes(xxhash.xxh64_intdigest)
            for batch in batches:
                hits = found_in(index, codes, raw_bytes(batch.column(1)))
                ids = [sorted({*had, *h}) for had, h in zip(batch.column(2).to_pylist(), hits, strict=True)]
                best = [max((x for x in (had, *h.values()) if x is not None), default=None) for had, h in zip(batch.column(3).to_pylist(), hits, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "best_similarity")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all their columns."""
    for held in _blocks(benchmark, item_col, item_text, block_bytes):  # each pass drops what its block contaminates; no shuffle
        shared = docs.sparkSession.sparkContext.broadcast((held, plan_rounds(held, similarity)))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            index, codes = Index(shared.value[0], similarity, rounds=shared.value[1]), BoundedCodes(xxhash.xxh64_intdigest)
            for batch in batches:
                yield batch.filter(pa.array([not h for h in found_in(index, codes, raw_bytes(batch.column(text_col)))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def brute_force(docs: list[tuple[int, str]], items: list[tuple[int, str]], similarity: float = 0.8) -> dict[int, list[int]]:
    """The same by edit distance from every word of every document to every item, for tests."""
    digest = xxhash.xxh64_intdigest
    out = {}
    for d, text in docs:
        words = [digest(w) for w in words_of((text or "").encode())]
        hits = set()
        for i, t in items:
            item = [digest(w) for w in words_of((t or "").encode())]
            most = int((1 - similarity) * len(item) + 1e-9)
            if item and any(edits_within(item, words[s : s + len(item) + most], most) is not None for s in range(len(words))):
                hits.add(i)
        out[d] = sorted(hits)
    return out
