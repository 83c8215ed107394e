"""A hierarchical Pitman-Yor bigram model, fitted by Gibbs sampling over all training tokens.

Each training token is a customer of the restaurant of its context, the whole word before it. The context restaurants of a
bucket share a parent restaurant, whose customers are their tables; its base is the discounted unigram distribution of all
training tokens, over the known types and one more. With one bucket this is the usual two-level model.

1. Words that make up a large share of all tokens are found first (``heavy``): a word of share f or more has that share in
   some task, so each task names few, and no more than ``2 / f`` are kept, f being at least a millionth.
2. One pass counts words. Counts of other words return to the buckets that have them, those of heavy words to all.
3. One pass turns blocks of documents into an inverted file: for each (context, word) entry the documents it stands in,
   dealt into buckets by context. A heavy context is split by word over several buckets, so none is larger than others;
   its number of customers is known (it is the word's count), its tables are taken as those of a part times the parts.
4. A bucket has all its restaurants in one place. A Gibbs sweep reseats the customers of each dish one after another given
   everything else: the next one opens a table with probability a / (a + n - d t), a = (theta + d T) P_parent, n being
   seated at t tables. Then the parent's customers are reseated likewise, and the strengths theta are drawn. Customers of
   many dishes decide side by side until no decision changes (``seat_run``), which is the same sequence; for very large
   dishes the customer who opens the next table is drawn at once, by inverting the chance that none does before
   (``next_table``), which is the same law.
5. Predictive probabilities are averaged over the sweeps after ``burn``; each bucket adds up its share of the documents'
   log-probabilities and sends it to their blocks.

Random numbers are seeded by (seed, bucket), and a bucket's rows are put in order first, so a task that runs again does the
same.

Defined cases: a null or empty text is just the end token; words are numbered by 64-bit hash; an unknown word has the
probability of one further type; without training tokens every probability is 1 and the base score 0; repeated rows are
separate documents; a null doc_id counts as a training document; an empty table gives an empty result; columns besides
id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, mix64, raw_bytes, stored, text_bytes

END = 0x0E2D0F7E87A11D05  # code of the end token, which is the context of a first token too
HELD = 1 << 15
LEAST_SHARE = 1e-6

DOC = np.dtype([("id", np.int64), ("null", np.bool_), ("held", np.bool_), ("n", np.int64)])
COUNTED = pa.schema([("part", pa.int64()), ("codes", pa.binary()), ("buckets", pa.binary()), ("counts", pa.binary())])
TOTALS = pa.schema([("bucket", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary()), ("types", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("tokens", pa.int64())])
SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("contexts", pa.binary()), ("spans", pa.binary()), ("words", pa.binary()), ("dishes", pa.binary()), ("sizes", pa.binary()), ("posts", pa.binary()), ("docs", pa.binary())])
SHARES = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("docs", pa.binary()), ("at", pa.binary()), ("score", pa.binary()), ("base", pa.binary()), ("known", pa.binary())])
SQL_TYPES = {pa.int64(): "long", pa.binary(): "binary"}


def sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def pack(x: np.ndarray) -> bytes:
    """Numbers that aren't negative in as few bytes each as the largest takes; the last byte says how many."""
    most = int(x.max()) if len(x) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return x.astype(f"u{size}").tobytes() + bytes([size])


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[-1]}", (len(b) - 1) // b[-1])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class _Numbers(dict):
    """Number of each word of a block."""

    def __init__(self):
        super().__init__()
        self.codes = [END]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.codes)
        self.codes.append(xxhash.xxh64_intdigest(word))
        return number


@dataclass
class Block:
    """Documents one after another: the number of each token (0 ends a document), and the code of each number."""

    docs: np.ndarray
    numbers: np.ndarray
    codes: np.ndarray

    def __post_init__(self):
        self.contexts = np.concatenate([np.zeros(1, np.int32), self.numbers[:-1]]) if len(self.numbers) else self.numbers
        self.trained = np.repeat(~self.docs["held"], self.docs["n"])

    def buckets(self, heavy: Heavy, n_buckets: int) -> np.ndarray:
        """The bucket of each token, by its context; of heavy contexts by its own word too."""
        parts = heavy.parts_of(self.codes)
        out = (mix64(self.codes, 1) % np.uint64(n_buckets)).astype(np.int64)[self.contexts]
        split = np.flatnonzero(parts[self.contexts])
        u, w = self.contexts[split], self.numbers[split]
        piece = mix64(self.codes, 2)[w] % parts[u].astype(np.uint64)
        with np.errstate(over="ignore"):
            out[split] = (mix64(self.codes[u] + (piece + np.uint64(1)) * MIX_A, 1) % np.uint64(n_buckets)).astype(np.int64)
        return out


class Heavy:
    """Words of a large share: their codes in order, counts, and over how many parts their contexts are dealt."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, parts: np.ndarray):
        self.codes, self.counts, self.parts = codes, counts, parts

    @classmethod
    def dealt(cls, codes: np.ndarray, counts: np.ndarray, bucket_tokens: float) -> Heavy:
        """Contexts dealt over parts of about a quarter of a bucket."""
        order = np.argsort(codes)
        return cls(codes[order], counts[order], np.maximum(1, np.ceil(4 * counts[order] / max(1.0, bucket_tokens))).astype(np.int64))

    def _find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes

    def has(self, codes: np.ndarray) -> np.ndarray:
        return self._find(codes)[1]

    def parts_of(self, codes: np.ndarray) -> np.ndarray:
        at, found = self._find(codes)
        return np.where(found, self.parts[at], 0) if len(self.codes) else np.zeros(len(codes), np.int64)

    def counts_of(self, codes: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        at, found = self._find(codes)
        return np.where(found, self.counts[at], otherwise) if len(self.codes) else otherwise


def blocks(ids: list, texts: list[bytes | None], tokens: int) -> Iterator[Block]:
    """Blocks of at most about ``tokens`` tokens."""
    numbers, parts, docs, held = _Numbers(), [], [], 0

    def made() -> Block:
        return Block(np.array(docs, DOC), np.concatenate(parts), np.array(numbers.codes, np.uint64))

    for doc, text in zip(ids, texts, strict=True):
        words = (text or b"").lower().split()
        if docs and (held + len(words) > tokens or len(docs) >= HELD - 1):
            yield made()
            numbers, parts, docs, held = _Numbers(), [], [], 0
        found = np.zeros(len(words) + 1, np.int32)
        found[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        parts.append(found)
        docs.append((doc or 0, doc is None, held_out(doc), len(found)))
        held += len(found)
    if docs:
        yield made()


def slices(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of the runs of sorted keys."""
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return list(zip(keys[heads].tolist(), heads.tolist(), np.r_[heads[1:], len(keys)].tolist(), strict=True))


def count_words(block: Block, heavy: Heavy, n_buckets: int) -> list[tuple]:
    """Rows (part, codes, buckets, counts): training tokens of each word by the bucket that has it, -1 for heavy words."""
    n = len(block.codes)
    bucket = np.where(heavy.has(block.codes)[block.numbers], -1, block.buckets(heavy, n_buckets))
    keys = (bucket + 1) * n + block.numbers
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    del keys
    counts = np.add.reduceat(block.trained[order].astype(np.int64), heads)
    word, bucket = block.numbers[order[heads]], bucket[order[heads]]
    part = (block.codes[word] >> np.uint64(20)) % np.uint64(n_buckets)
    by = np.argsort(part, kind="stable")
    return [(p, block.codes[word[by[a:b]]].tobytes(), pack(bucket[by[a:b]] + 1), pack(counts[by[a:b]])) for p, a, b in slices(part[by].astype(np.int64))]


def sum_words(table: pa.Table) -> pa.Table:
    """Of a part's words the training counts: to each bucket those it has, to -1 those of heavy words; and a row of sums."""
    rows = table.to_pydict()
    codes = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["codes"]])
    buckets, counts = (np.concatenate([unpack(x).astype(np.int64) for x in rows[c]]) for c in ("buckets", "counts"))
    words, at = np.unique(codes, return_inverse=True)
    total = np.bincount(at, counts).astype(np.int64)
    out = [(None, None, None, int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()), int(total.sum()))]
    keys = np.unique(buckets * len(words) + at)  # buckets count from 1 here, 0 being that of heavy words
    for b, lo, hi in slices(keys // len(words)):
        w = keys[lo:hi] % len(words)
        out.append((b - 1, words[w].tobytes(), total[w].tobytes(), 0, 0, 0, 0))
    return pa.Table.from_batches([batch_of(out, TOTALS)])


def invert(block: Block, heavy: Heavy, n_buckets: int) -> Iterator[tuple]:
    """Rows (bucket, contexts, spans, words, dishes, sizes, posts) of a block's entries."""
    n = len(block.codes)
    keys = block.contexts.astype(np.int64) * n + block.numbers
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    del keys
    sizes = np.diff(np.r_[heads, len(order)])
    bucket = block.buckets(heavy, n_buckets)[order[heads]]
    by = np.argsort(bucket, kind="stable")
    bucket, heads, sizes = bucket[by], heads[by], sizes[by]
    stop = np.cumsum(sizes)
    tokens = order[np.repeat(heads - (stop - sizes), sizes) + np.arange(len(order))]
    posts = np.repeat(np.arange(len(block.docs)) | block.docs["held"] * HELD, block.docs["n"]).astype(np.uint16)[tokens]
    context, word = block.contexts[order[heads]], block.numbers[order[heads]]
    begin = stop - sizes
    for b, lo, hi in slices(bucket):
        runs = slices(context[lo:hi])
        words, dishes = np.unique(word[lo:hi], return_inverse=True)
        spans = np.array([z - a for _, a, z in runs])
        yield b, block.codes[[c for c, *_ in runs]].tobytes(), pack(spans), block.codes[words].tobytes(), pack(dishes), pack(sizes[lo:hi]), posts[begin[lo] : stop[hi - 1]].tobytes()


def log_rise(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """log(Gamma(x + a) / Gamma(x)) for x > 0, a >= 0."""

    def log_gamma(z: np.ndarray) -> np.ndarray:
        shift = np.log(z * (z + 1) * (z + 2) * (z + 3)) + np.log((z + 4) * (z + 5) * (z + 6) * (z + 7))
        y = z + 8
        return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift

    far = x > 1e6 * (1 + a * a)
    y = np.where(far, 1.0, x)
    return np.where(far, a * np.log(x) + a * (a - 1) / (2 * x), log_gamma(y + a) - log_gamma(y))


def next_table(n: np.ndarray, most: np.ndarray, t: np.ndarray, a: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """How many are seated when the next table has been opened, or ``most + 1`` if it isn't by then.

    After n customers at t tables, none of those up to m opens one with probability
    Gamma(m - dt) Gamma(n - dt + a) / (Gamma(n - dt) Gamma(m - dt + a)); u inverts it.
    """
    x, goal = n - discount * t, np.log(u)
    left = log_rise(x, a)
    none = lambda m: left - log_rise(m - discount * t, a)
    low, high = n.astype(np.int64), most.astype(np.int64) + 1  # opened by the customer at low + 1 .. high
    sure = none(most) > goal  # nobody does
    low[sure] = high[sure] - 1
    while (open_ := high - low > 1).any():
        middle = (low + high) // 2
        later = none(middle) > goal
        low = np.where(open_ & later, middle, low)
        high = np.where(open_ & ~later, middle, high)
    return high


def seat_run(seated: np.ndarray, more: np.ndarray, tables: np.ndarray, strength: np.ndarray, prior: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables after ``more`` further customers at each dish, one after another; ``u`` has a number for each of them.

    Whether a customer opens a table depends on how many were opened before. Starting from none, all customers decide at
    once, again and again, until no decision changes; as each depends on earlier ones only, that is the one sequence that
    seating them one by one gives.
    """
    dish = np.repeat(np.arange(len(more)), more)
    first = np.cumsum(more) - more
    n = (seated - first)[dish] + np.arange(len(dish))
    strength, prior, start = strength[dish], prior[dish], tables[dish]
    t = start
    while True:
        fresh = (strength + discount * t) * prior
        opened = u * (fresh + n - discount * t) < fresh
        before = np.cumsum(opened) - opened
        now = start + (before - before[first][dish])
        if np.array_equal(now, t):
            return tables + np.add.reduceat(opened.astype(np.int64), first)
        t = now


def seat(counts: np.ndarray, prior: np.ndarray, rest: np.ndarray, discount: float, theta: float, rng: np.random.Generator, run: int = 1 << 20) -> np.ndarray:
    """Tables of dishes with ``counts`` customers each, seated one after another; ``rest``: other tables of the restaurant.

    Dishes are taken together in runs of about ``run`` customers. What is left of a larger dish goes by further runs, or by
    the customers who open its next tables where those are few.
    """
    counts, tables = counts.astype(np.int64), np.minimum(counts, 1).astype(np.float64)
    strength = theta + discount * rest
    live = np.flatnonzero(counts > 1)
    more = np.minimum(counts[live] - 1, run)
    group = (np.cumsum(more) - 1) // run
    for _, a, z in slices(group):
        at = live[a:z]
        tables[at] = seat_run(np.ones(z - a, np.int64), more[a:z], tables[at], strength[at], prior[at], discount, rng.random(int(more[a:z].sum())))
    for i in live[counts[live] - 1 > run].tolist():
        n, one = run + 1, slice(i, i + 1)
        while n < counts[i]:
            fresh = (strength[i] + discount * tables[i]) * prior[i]
            if fresh * np.log(counts[i] / n) * 20_000 < counts[i] - n:  # a table costs as much as so many customers
                n = int(next_table(np.array([n]), counts[one], tables[one], np.array([fresh]), discount, 1 - rng.random(1))[0])
                tables[i] += n <= counts[i]
            else:
                k = int(min(run, counts[i] - n))
                tables[one] = seat_run(np.array([n]), np.array([k]), tables[one], strength[one], prior[one], discount, rng.random(k))
                n += k
    return tables


def draw_theta(theta: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> float:
    """A strength given the seating of its restaurants, by auxiliary variables; prior Gamma(1, 1)."""
    big = customers > 1
    if not big.any():
        return theta
    logs = np.log(np.maximum(rng.beta(theta + 1, customers[big] - 1), 1e-300)).sum()
    all_but_one = tables[big].astype(np.int64) - 1
    t = np.minimum(all_but_one, 100_000)
    i = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t) + 1
    ones = (rng.random(len(i)) < theta / (theta + discount * i)).sum()
    # Of tables beyond, each counts with probability theta / (theta + d i), so that their number is Poisson.
    ones += rng.poisson((theta / discount * np.log(np.maximum(all_but_one, 1) / np.maximum(t, 1))).sum())
    return float(max(1e-3, rng.gamma(1 + ones) / (1 - logs)))


def discount_of(counts: np.ndarray) -> float:
    """Discount by the numbers of dishes with one and with two customers, kept inside (0, 1)."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


class Bucket:
    """The context restaurants of a bucket and their parent."""

    def __init__(self, rows: dict, base: dict, heavy: Heavy):
        self.blocks = rows["block"]
        read = lambda c, t: [np.frombuffer(x, t) for x in rows[c]]
        context, word, self.posts = read("contexts", np.uint64), read("words", np.uint64), read("posts", np.uint16)
        spans, dish, size = ([unpack(x) for x in rows[c]] for c in ("spans", "dishes", "sizes"))
        self.sizes, self.entries = size, [len(d) for d in dish]
        self.contexts, u = np.unique(np.concatenate(context), return_inverse=True)
        self.words, w = np.unique(np.concatenate(word), return_inverse=True)
        u = np.repeat(u, np.concatenate(spans))
        starts = np.cumsum([len(x) for x in word]) - [len(x) for x in word]
        w = w[np.concatenate([d.astype(np.int64) + s for d, s in zip(dish, starts, strict=True)])]
        keys, self.use = np.unique(u * len(self.words) + w, return_inverse=True)
        self.ctx, self.dish = keys // len(self.words), keys % len(self.words)
        trained = np.concatenate([np.add.reduceat((p < HELD).astype(np.int64), np.cumsum(s, dtype=np.int64) - s) for p, s in zip(self.posts, size, strict=True)])
        self.counts = np.bincount(self.use, trained, minlength=len(keys))
        self.served = heavy.counts_of(self.contexts, np.bincount(self.ctx, self.counts, minlength=len(self.contexts)))
        self.parts = np.maximum(1, heavy.parts_of(self.contexts))
        self.totals = heavy.counts_of(self.words, self._looked_up(base["codes"], base["counts"])).astype(np.float64)

    def _looked_up(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(len(self.words), np.int64)
        at = np.minimum(np.searchsorted(codes, self.words), len(codes) - 1)
        return np.where(codes[at] == self.words, counts[at], 0)

    def start(self, m: dict) -> None:
        """A table for each dish; ``root``, the discounted unigram probability of each word."""
        d = m["discount"]
        self.root = (np.maximum(self.totals - d, 0) + d * m["types"] / (m["types"] + 1)) / m["tokens"]
        self.tables = np.minimum(self.counts, 1)
        self.parent_counts = np.bincount(self.dish, self.tables, minlength=len(self.words))
        self.parent_tables = np.minimum(self.parent_counts, 1)
        self.d, self.d0 = discount_of(self.counts), discount_of(self.parent_counts)
        self.theta, self.theta0 = 1.0, 1.0

    def laid(self) -> np.ndarray:
        """Tables of each context."""
        return np.bincount(self.ctx, self.tables, minlength=len(self.contexts)) * self.parts

    def prior(self) -> np.ndarray:
        """The parent's probability of each word."""
        back = self.theta0 + self.d0 * self.parent_tables.sum()
        return (self.parent_counts - self.d0 * self.parent_tables + back * self.root) / (self.theta0 + self.parent_counts.sum())

    def sweep(self, rng: np.random.Generator, strengths: bool = True) -> None:
        rest = np.maximum(self.laid()[self.ctx] - self.tables, 0)
        self.tables = seat(self.counts, self.prior()[self.dish], rest, self.d, self.theta, rng)
        self.parent_counts = np.bincount(self.dish, self.tables, minlength=len(self.words))
        self.parent_tables = seat(self.parent_counts, self.root, np.maximum(self.parent_tables.sum() - self.parent_tables, 0), self.d0, self.theta0, rng)
        if strengths:
            self.theta = draw_theta(self.theta, self.d, self.served, self.laid(), rng)
            self.theta0 = draw_theta(self.theta0, self.d0, self.parent_counts.sum(keepdims=True), self.parent_tables.sum(keepdims=True), rng)

    def predictive(self) -> np.ndarray:
        """Probability of each entry's word after its context."""
        back = (self.theta + self.d * self.laid())[self.ctx] * self.prior()[self.dish]
        return (self.counts - self.d * self.tables + back) / (self.theta + self.served)[self.ctx]

    def fitted(self, m: dict, rng: np.random.Generator) -> np.ndarray:
        """log10 of the predictive probabilities, averaged over the sweeps after ``burn``."""
        if not m["tokens"]:
            return np.zeros(len(self.counts))
        self.start(m)
        mean = np.zeros(len(self.counts))
        for i in range(m["sweeps"]):
            self.sweep(rng)
            if i >= m["burn"]:
                mean += self.predictive()
        return np.log10(mean / (m["sweeps"] - m["burn"]))

    def shares(self, m: dict, logs: np.ndarray) -> Iterator[tuple]:
        """Of each block the sums of its documents: (block, places, scores, base scores, known tokens)."""
        base = np.log10((self.totals + 0.1) / (m["tokens"] + 0.1 * (m["types"] + 1))) if m["tokens"] else np.zeros(len(self.words))
        base, known = base[self.dish], (self.totals > 0)[self.dish]
        first = 0
        for block, n, sizes, posts in zip(self.blocks, self.entries, self.sizes, self.posts, strict=True):
            entry = np.repeat(self.use[first : first + n], sizes)
            first += n
            at, doc = np.unique(posts & np.uint16(HELD - 1), return_inverse=True)
            steps = np.diff(at.astype(np.int64), prepend=0)  # small where most documents of the block are in the bucket
            yield block, pack(steps), np.bincount(doc, logs[entry]).tobytes(), np.bincount(doc, base[entry]).tobytes(), pack(np.bincount(doc, known[entry]).astype(np.int64))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 4, burn: int = 1, seed: int = 11, block_tokens: int = 1_000_000, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    size = text_bytes(docs, text_col)
    n_buckets = max(1, -(-size // bucket_bytes))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    share = max(LEAST_SHARE, 1 / (4 * n_buckets))

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with half the share or more of a task's training tokens; and, without a word, how many those are."""
        counts: dict[bytes, int] = {}
        total = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                if not held_out(doc):
                    words = (text or b"").lower().split()
                    for w in words:
                        counts[w] = counts.get(w, 0) + 1
                    counts[b""] = counts.get(b"", 0) + 1  # the end token
                    total += len(words) + 1
        found = [(xxhash.xxh64_intdigest(w) if w else END, c) for w, c in counts.items() if c >= share / 2 * total]
        codes = np.array([x for x, _ in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None, *codes.tolist()], pa.int64()), pa.array([total, *[c for _, c in found]], pa.int64())], names=["code", "n"])

    named = texts.mapInArrow(heaviest, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).persist()
    tokens = int((named.where("code IS NULL").first() or [0, 0])[1] or 0)
    # At most 2 / share words, so 2 million, reach the driver and are broadcast.
    found = named.where("code IS NOT NULL").where(F.col("n") >= share / 2 * tokens).collect() if tokens else []
    named.unpersist()
    roughly = Heavy.dealt(np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([r[1] for r in found], np.int64), tokens / n_buckets)
    shared = spark.sparkContext.broadcast((roughly.codes, roughly.counts, roughly.parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = Heavy(*shared.value)
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), block_tokens):
                yield batch_of(count_words(block, heavy, n_buckets), COUNTED)

    totals = stored(texts.mapInArrow(count, sql(COUNTED)).groupBy("part").applyInArrow(sum_words, sql(TOTALS)), "word-counts")
    types, n1, n2, tokens = (int(x or 0) for x in totals.agg(F.sum("types"), F.sum("n1"), F.sum("n2"), F.sum("tokens")).first())
    m = {"types": types, "tokens": tokens, "discount": min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5, "sweeps": sweeps, "burn": burn}
    exact = totals.where("bucket = -1").select("codes", "counts").collect()  # of the heavy words
    sums = dict(zip(*[np.concatenate([np.frombuffer(r[i], t) for r in exact]).tolist() for i, t in enumerate((np.uint64, np.int64))], strict=True)) if exact else {}
    served = spark.sparkContext.broadcast(np.array([sums.get(c, 0) for c in roughly.codes.tolist()], np.int64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        heavy, number = Heavy(*shared.value), TaskContext.get().partitionId() << 24
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), block_tokens):
                out = [(b, number, *x, None) for b, *x in invert(block, heavy, n_buckets)]
                out.append((number % n_buckets, number, *[None] * 6, block.docs.tobytes()))
                yield batch_of(out, SENT)
                number += 1

    def fit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        described = left.filter(left.column("docs").is_valid())
        out = [(b, None, d, None, None, None, None) for b, d in zip(described.column("block").to_pylist(), described.column("docs").to_pylist(), strict=True)]
        rows = left.filter(left.column("docs").is_null()).sort_by("block").to_pydict()
        if rows["block"]:
            given = [np.concatenate([np.frombuffer(x, t) for x in right.column(c).to_pylist()]) if len(right) else np.empty(0, t) for c, t in (("codes", np.uint64), ("counts", np.int64))]
            order = np.argsort(given[0])
            me = key[0].as_py()
            bucket = Bucket(rows, {"codes": given[0][order], "counts": given[1][order]}, Heavy(shared.value[0], served.value, shared.value[2]))
            logs = bucket.fitted(m, np.random.Generator(np.random.PCG64([seed, me])))
            out += [(block, me, None, *x) for block, *x in bucket.shares(m, logs)]
        return pa.Table.from_batches([batch_of(out, SHARES)])

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("bucket").to_pylist()
        of = np.frombuffer(next(r["docs"] for r in rows if r["docs"] is not None), DOC)
        scores, base, known = np.zeros(len(of)), np.zeros(len(of)), np.zeros(len(of), np.int64)
        for r in rows:
            if r["docs"] is None:
                at = np.cumsum(unpack(r["at"]), dtype=np.int64)
                scores[at] += np.frombuffer(r["score"], np.float64)
                base[at] += np.frombuffer(r["base"], np.float64)
                known[at] += unpack(r["known"]).astype(np.int64)
        return pa.Table.from_arrays(
            [pa.array(of["id"], mask=of["null"]), pa.array(of["held"]), pa.array(of["n"]), pa.array(known), pa.array(np.full(len(of), tokens, np.int64)), pa.array(base), pa.array(scores), pa.array(10 ** np.minimum(-scores / of["n"], 300))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )

    sent = texts.mapInArrow(send, sql(SENT))
    counts = totals.where("bucket >= 0").select("bucket", "codes", "counts")
    shares = sent.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(fit, sql(SHARES))
    return shares.groupBy("block").applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
