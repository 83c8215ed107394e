"""Subword encoding and decoding with seeded merge-dropout.

The pieces of a merge-type (BPE) SentencePiece model are joined by an agenda: of all neighbouring pairs whose join is a
piece, the one of best score, leftmost first, is taken next. With dropout each candidate that comes up is skipped for
good with probability ``dropout``, drawn for each occurrence of a word by hashes keyed by (seed, document, the word's
place in it), so that no number of segmentations bounds a frequent word, and one text gets the same ones on every run.

For a word of up to ``SHORT`` characters the draw says how many candidates pass until the next one skipped; which
segmentation follows depends on the word and the skips so far alone, so those are kept as a tree of (word, skips), and
each of its nodes is segmented once. Longer words, whose skips hardly ever recur, are segmented for each occurrence. With
``dropout`` 0 the segmentation is the model's own.

Decoding is exact: a space is the piece mark, characters without a piece (and the mark itself, should a text have it)
are spelled in byte pieces, and the leading space that encoding adds is taken off again.

The model file's path is a parameter; the driver reads its vocabulary and sends it to executors (a size fixed by the
model), which need no file. Nothing is trained.

Defined cases: a null or empty text has no pieces; very long words take the same agenda on a heap; repeated rows with
one id get the same pieces; a null id is treated as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, MIX_C, mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(r" *[^ ]+| +")
NONE = np.iinfo(np.int32).max
MASK = (1 << 64) - 1
SHORT = 16
SLOT_BITS = 19


class Vocabulary:
    """Pieces of a model: ids of characters, of pairs, of bytes, and the order of merges."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int]):
        self.pieces, self.scores, self.bytes_at = pieces, scores, bytes_at
        special = set(bytes_at) | {i for i, p in enumerate(pieces) if not p}
        ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.chars = {p: i for p, i in ids.items() if len(p) == 1 and p != MARK}
        if MARK in ids:
            self.chars[" "] = ids[MARK]
        order = sorted(ids.values(), key=lambda i: (-scores[i], i))
        self.rank = np.full(len(pieces), NONE, np.int32)
        self.rank[order] = np.arange(len(order))
        self.pairs: dict[tuple[int, int], int] = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    self.pairs[ids[p[:k]], ids[p[k:]]] = i
        self.by_rank = np.array(order, np.int32)  # the piece of each rank
        #: Ranks of pairs: each pair at its slot, those whose slot is taken in a sorted list.
        keys, ranks = np.array([a * len(pieces) + b for a, b in self.pairs], np.int64), self.rank[list(self.pairs.values())]
        self.slots, self.slot_rank, self.full = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, NONE, np.int32), np.zeros(1 << SLOT_BITS, bool)
        at, first = np.unique(self._slot(keys), return_index=True)
        self.slots[at], self.slot_rank[at] = keys[first], ranks[first]
        late = np.setdiff1d(np.arange(len(keys)), first)
        late = late[np.argsort(keys[late])]
        self.late, self.late_rank = keys[late], ranks[late]
        self.full[self._slot(self.late)] = True
        self.char_ids = np.full(0x110000, -1, np.int32)
        for c, i in self.chars.items():
            self.char_ids[ord(c)] = i
        self.spelled: list[bytes] = [p.replace(MARK, " ").encode() for p in pieces]
        for value, i in enumerate(bytes_at):
            self.spelled[i] = bytes([value])

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        hidden = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        pieces = ["" if hidden(i) else m.id_to_piece(i) for i in range(size)]
        return cls(pieces, [m.get_score(i) for i in range(size)], [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX_A) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the join of two pieces, ``NONE`` for no such piece."""
        wanted = left.astype(np.int64) * len(self.pieces) + right
        wanted[(left < 0) | (right < 0)] = -2
        at = self._slot(wanted)
        out = np.where(self.slots[at] == wanted, self.slot_rank[at], NONE)
        if len(self.late):
            again = np.flatnonzero(self.full[at] & (out == NONE))
            spot = np.minimum(np.searchsorted(self.late, wanted[again]), len(self.late) - 1)
            out[again] = np.where(self.late[spot] == wanted[again], self.late_rank[spot], NONE)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded, without the space put before it."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _spell(vocabulary: Vocabulary, word: str, symbols: list[int], starts: list[int]) -> list[int]:
    out = []
    for s, at in zip(symbols, starts, strict=True):
        if s >= 0:
            out.append(s)
        else:
            out += [vocabulary.bytes_at[b] for b in word[at].encode("utf-8", "surrogatepass")]
    return out


def word_key(word: str, variant: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed) ^ (variant << 56)


def skipped(key: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the keyed hash of a candidate says to skip it."""
    with np.errstate(over="ignore"):
        h = mix64(key + start.astype(np.uint64) * MIX_A + end.astype(np.uint64) * MIX_B + piece.astype(np.uint64) * MIX_C)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def skips_one(key: int, start: int, end: int, piece: int, dropout: float) -> bool:
    """``skipped`` for a single candidate."""
    x = (key + start * int(MIX_A) + end * int(MIX_B) + piece * int(MIX_C) + int(MIX_A)) & MASK
    x = ((x ^ (x >> 30)) * int(MIX_B)) & MASK
    x = ((x ^ (x >> 27)) * int(MIX_C)) & MASK
    return ((x ^ (x >> 31)) >> 11) * 2.0**-53 < dropout


def segment_word(v: Vocabulary, word: str, variant: int, seed: int, dropout: float) -> list[int]:
    return segment_keyed(v, word, word_key(word, variant, seed), dropout)


def segment_keyed(v: Vocabulary, word: str, key_of: int, dropout: float) -> list[int]:
    """One word by an agenda on a heap, of any length."""
    n = len(word)
    symbols = [v.chars.get(c, -1) for c in word]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    key = int(key_of)
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (m := v.pairs.get((symbols[i], symbols[j]))) is not None:
            heapq.heappush(agenda, (int(v.rank[m]), i, end[j], end[i], m))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while agenda:
        _, i, stop, mid, m = heapq.heappop(agenda)
        j = after[i]
        if gone[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        if dropout and skips_one(key, i, stop, m, dropout):
            continue
        symbols[i], end[i], gone[j] = m, stop, True
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    left = [i for i in range(n) if not gone[i]]
    return _spell(v, word, [symbols[i] for i in left], left)


def segment_words(v: Vocabulary, words: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all words one after another, and how many each has."""
    decide = lambda rows, _, start, stop, piece: skipped(keys[rows], start, stop, piece, dropout) if dropout else np.zeros(len(rows), bool)
    return side_by_side(v, words, decide)[:2]


def segment_skipping(v: Vocabulary, words: list[str], skips: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words segmented while the candidates of these numbers are skipped, and how many candidates came up."""
    table = np.full((len(words), max(1, *map(len, skips))), -1)
    for row, x in enumerate(skips):
        table[row, : len(x)] = x
    return side_by_side(v, words, lambda rows, nth, *_: (table[rows] == nth).any(1))


def side_by_side(v: Vocabulary, words: list[str], decide: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of similar, moderate length, all agendas side by side; ``decide`` says which candidates are skipped.

    A symbol stays at the place of its first character; ``after`` and ``before`` link it to its neighbours.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n, width = len(words), int(sizes.max())
    alive = np.arange(width + 1) < sizes[:, None]
    symbols = np.full((n, width + 1), -1, np.int32)
    symbols[alive] = v.char_ids[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    # Flat places: row * span + column; the column behind a word's last stands for its end.
    span = width + 1
    after = np.arange(n * span) + 1
    before = np.arange(n * span) - 1
    before[::span] = -1
    order = np.full((n, span), NONE, np.int32)
    order[:, :-1] = v.ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
    symbols, alive, flat_order = symbols.ravel(), alive.ravel(), order.ravel()
    rows = np.flatnonzero(order.min(1) < NONE)
    drawn, nth = np.zeros(n, np.int64), 0  # each word that isn't done has one candidate come up a turn
    while len(rows):
        at = order[rows].argmin(1) + rows * span
        rank = flat_order[at]
        open_ = rank < NONE
        if not open_.all():
            rows, at, rank = rows[open_], at[open_], rank[open_]
            if not len(rows):
                break
        piece, right = v.by_rank[rank], after[at]
        stop = after[right]
        drop = decide(rows, nth, at - rows * span, stop - rows * span, piece)
        drawn[rows] += 1
        nth += 1
        flat_order[at[drop]] = NONE
        keep = ~drop
        at, right, stop, piece = at[keep], right[keep], stop[keep], piece[keep]
        symbols[at], alive[right], flat_order[right] = piece, False, NONE
        after[at] = stop
        before[stop] = at  # the end's own links are not followed
        flat_order[at] = v.ranks(piece, np.where(alive[stop], symbols[stop], -1))
        left = before[at]
        has = left >= 0
        flat_order[left[has]] = v.ranks(symbols[left[has]], piece[has])
    counts = alive.reshape(n, span).sum(1)
    flat = symbols[alive]
    spelled = np.flatnonzero((symbols.reshape(n, span) < 0).any(1) & (np.where(alive, symbols, 0).reshape(n, span).min(1) < 0))
    if len(spelled):  # characters without a piece
        grid, ends, parts, last = alive.reshape(n, span), np.cumsum(counts).tolist(), [], 0
        for i in spelled.tolist():
            begin = ends[i - 1] if i else 0
            new = _spell(v, words[i], flat[begin : ends[i]].tolist(), np.flatnonzero(grid[i]).tolist())
            parts += [flat[last:begin], np.array(new, np.int32)]
            last, counts[i] = ends[i], len(new)
        flat = np.concatenate([*parts, flat[last:]])
    return flat, counts, drawn


def by_size(words: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """Places of words to be segmented together, and whether they are too long for that."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    low = 0
    while low < len(order) and (size := int(sizes[order[low]])) <= 64:
        high = min(low + 20_000, int(np.searchsorted(sizes[order], size + max(2, size // 4), side="right")))
        high = min(high, int(np.searchsorted(sizes[order], 64, side="right")))
        yield order[low:high], False
        low = high
    if low < len(order):
        yield order[low:], True


class Numbers(dict):
    """The number of each word, in the order they came."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


class Rows:
    """Lists of pieces one after another, in arrays that grow by half."""

    def __init__(self):
        self.n = self.used = 0
        self.starts, self.lens, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        n, used = self.n + len(lens), self.used + len(flat)
        if n > len(self.lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros(n + n // 2 - len(x), np.int64)]) for x in (self.starts, self.lens))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used + used // 2 - len(self.flat), np.int32)])
        self.starts[self.n : n] = self.used + np.cumsum(lens) - lens
        self.lens[self.n : n] = lens
        self.flat[self.used : used] = flat
        self.n, self.used = n, used

    def cut(self, n: int, used: int) -> None:
        self.n, self.used = n, used


class Encoder:
    """Encodes batches of texts; each node (word, skips) is segmented once while the table lasts."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 3, dropout: float = 0.1, keep: int = 400_000):
        self.v, self.seed, self.dropout, self.keep = vocabulary, seed, dropout, keep
        self._clear()

    def _clear(self) -> None:
        self.numbers = Numbers()
        self.words = self.numbers.words
        self.long = np.zeros(0, bool)
        self.roots = np.zeros(0, np.int64)  # node of each word without skips, -1: none
        # Of each node: word, numbers of the candidates skipped, candidates still to come up, nodes by how many of those pass.
        self.of: list[int] = []
        self.skips: list[tuple[int, ...]] = []
        self.left, self.kids = np.zeros(0, np.int64), np.zeros((0, SHORT), np.int32)
        self.rows = Rows()

    def _segmented(self, words: list[str], skips: list[tuple[int, ...]] | None, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of words one after another, how many each has, and how many candidates came up; by skips, or by keys."""
        lens, left = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, order = [], []
        for part, alone in by_size(words):
            some = [words[i] for i in part.tolist()]
            if alone:
                found = [segment_keyed(self.v, w, k, 0.0 if keys is None else self.dropout) for w, k in zip(some, repeat(0) if keys is None else keys[part].tolist(), strict=keys is not None)]
                lens[part] = [len(x) for x in found]
                parts.append(np.array([x for ids in found for x in ids], np.int32))
            elif keys is None:
                flat, lens[part], left[part] = segment_skipping(self.v, some, [skips[i] for i in part.tolist()])
                parts.append(flat)
            else:
                flat, lens[part] = segment_words(self.v, some, keys[part], self.dropout)
                parts.append(flat)
            order.append(part)
        if not parts:
            return np.zeros(0, np.int32), lens, left
        # From the order of sizes back to that of the words.
        order, flat = np.concatenate(order), np.concatenate(parts)
        began = np.empty(len(words), np.int64)
        began[order] = np.cumsum(lens[order]) - lens[order]
        stop = np.cumsum(lens)
        return flat[np.repeat(began - (stop - lens), lens) + np.arange(int(stop[-1]))], lens, left

    def _grow(self, numbers: list[int], skips: list[tuple[int, ...]]) -> np.ndarray:
        """New nodes for words and their skips."""
        flat, lens, left = self._segmented([self.words[i] for i in numbers], skips, None)
        nodes = len(self.of) + np.arange(len(numbers))
        self.of += numbers
        self.skips += skips
        self.left = np.concatenate([self.left, left - np.array([x[-1] + 1 if x else 0 for x in skips], np.int64)])
        if len(self.of) > len(self.kids):
            self.kids = np.concatenate([self.kids, np.full((len(self.of) - len(self.kids) + len(self.kids) // 2, SHORT), -1, np.int32)])
        self.rows.add(flat, lens)
        return nodes

    def _descend(self, nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The node of each occurrence, from that of its word and its key."""
        nodes, depth = nodes.copy(), 0
        live = np.flatnonzero(self.left[nodes] > 0)
        while len(live):
            depth += 1
            u = ((mix64(keys[live], depth) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
            passed = np.floor(np.log(u) / np.log1p(-self.dropout)).astype(np.int64) if self.dropout < 1 else np.zeros(len(live), np.int64)
            go = passed < self.left[nodes[live]]
            live, passed = live[go], passed[go]
            at = nodes[live]
            lacking = self.kids[at, passed] < 0
            if lacking.any():
                new = np.unique(at[lacking] * SHORT + passed[lacking])
                parents, skip = new // SHORT, new % SHORT
                base = [self.skips[i] for i in parents.tolist()]
                made = self._grow([self.of[i] for i in parents.tolist()], [(*x, (x[-1] + 1 if x else 0) + k) for x, k in zip(base, skip.tolist(), strict=True)])
                self.kids[parents, skip] = made
            nodes[live] = self.kids[at, passed]
        return nodes

    def encode(self, ids: list[int | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts one after another, how many each text has)."""
        if len(self.words) > self.keep or len(self.of) > 3 * self.keep:
            self._clear()
        split = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        first = len(self.words)
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.words) > first:
            long = np.fromiter((len(w) > SHORT for w in self.words[first:]), bool) & bool(self.dropout)
            roots = np.full(len(long), -1, np.int64)
            fresh = np.flatnonzero(~long)
            roots[fresh] = self._grow((first + fresh).tolist(), [()] * len(fresh))
            self.long, self.roots = np.concatenate([self.long, long]), np.concatenate([self.roots, roots])
        doc = np.array([(i or 0) & MASK for i in ids], np.uint64)
        place = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            keys = mix64(np.repeat(mix64(doc, self.seed), counts) + place.astype(np.uint64) * MIX_A)
        at = self.roots[numbers]
        far = self.long[numbers]
        if self.dropout:
            at[~far] = self._descend(at[~far], keys[~far])
        rows = self.rows
        kept = rows.n, rows.used
        if far.any():  # put behind the table for this batch only
            where = np.flatnonzero(far)
            flat, lens, _ = self._segmented([self.words[i] for i in numbers[where].tolist()], None, keys[where])
            at[where] = rows.n + np.arange(len(where))
            rows.add(flat, lens)
        lens = rows.lens[at]
        stop = np.cumsum(lens)
        flat = rows.flat[np.repeat(rows.starts[at] - (stop - lens), lens) + np.arange(int(stop[-1]) if len(stop) else 0)]
        rows.cut(*kept)
        owner = np.repeat(np.arange(len(texts)), counts)
        return flat, np.bincount(owner, lens, minlength=len(texts)).astype(np.int64)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = 3, dropout: float = 0.1, group: int = 300) -> DataFrame:
    """Per row: doc_id, pieces (ids), n_pieces, decoded_crc32 (of the decoded text) and lossless (decoded is the text)."""
    v = Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast((v.pieces, v.scores, v.bytes_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        encoder = Encoder(vocabulary, seed, dropout)
        for batch in batches:
            for i in range(0, batch.num_rows, group):
                part = batch.slice(i, group)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                flat, counts = encoder.encode(ids, texts)
                offsets = np.r_[0, np.cumsum(counts)]
                values = flat.tolist()
                back = [vocabulary.decode(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                same = [d == (t or "") for d, t in zip(back, texts, strict=True)]
                crc = [zlib.crc32(d.encode("utf-8", "surrogatepass")) for d in back]
                pieces = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pieces, pa.array(counts), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "pieces", "n_pieces", "decoded_crc32", "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, decoded_crc32 long, lossless boolean")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of encoded rows (doc_id, pieces)."""
    v = Vocabulary.load(model)
    shared = rows.sparkSession.sparkContext.broadcast((v.pieces, v.scores, v.bytes_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        for batch in batches:
            texts = [vocabulary.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "pieces").mapInArrow(run, "doc_id long, text string")
