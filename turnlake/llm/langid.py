"""Language identification by a linear-chain conditional random field over words.

Every word gets a language. Features of a word are its affixes (one to three bytes), its byte bigrams and trigrams,
the word itself, and for each language whether its lexicon has the word; they are hashed into a table of weights.
Transition weights between the languages of neighbouring words are learned with them, on code-switched sequences
spliced from documents of different languages, by stochastic gradient (AdaGrad) on the exact log-likelihood from
forward-backward. A text's language is the one with the largest mean posterior over its words that have a letter.

The fit takes a bounded sample of labelled rows, all bounds being parameters: at most ``per_lang`` documents of each of the
at most ``max_langs`` most frequent languages, of at most ``doc_bytes`` bytes each, chosen by hashed id, and of those at
most ``words_per_lang`` words a language. Prediction takes every word of every text, in sequences of ``span`` words, with
``around`` words of the text before and behind each, whose labels are those of their own sequences.

``labelled_runs`` gives the runs of words of one language in each text; ``identify`` sums the same posteriors up by text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and has no runs; without labelled rows all
are; ties go to the language first in order; a fit on very few words still trains on those; repeated rows get the same
result each; an empty table gives an empty result; columns besides id and text aren't read for a prediction (lang only
for the fit).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOT_LETTER = re.compile(r"[\W\d_]+")
LEX_SLOTS = 1 << 18


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def letters(word: str) -> str:
    return NOT_LETTER.sub("", word).lower()


def features(words: list[str], slots: int, lexicon: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the weight table, features of each word): none for a word without letters.

    Affixes of one to three bytes are the runs of two to four bytes that begin or end with a word's marks; inside it
    runs of two and three count. The word itself is one more, and each language whose lexicon has it another.
    """
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    text = np.frombuffer(b"".join(b"\x02%b\x03" % r for r in raw), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(start + size, size) - np.arange(len(text))  # bytes from here to the end of the word
    first, real = left == size[owner], size[owner] > 2
    places, owners = [], []
    with np.errstate(over="ignore"):
        code = text.copy()
        for n in (2, 3, 4):
            code = code[:-1] * np.uint64(257) + text[n - 1 :]
            keep = (left[: len(code)] >= n) & real[: len(code)]
            if n == 4:  # affixes only
                keep &= first[: len(code)] | (left[: len(code)] == n)
            places.append((((code[keep] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(slots))
            owners.append(owner[: len(code)][keep])
    crc = np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw))
    some = np.flatnonzero(size > 2)
    places.append(crc[some] % np.uint64(slots))
    owners.append(some)
    masks = lexicon[(crc % np.uint64(LEX_SLOTS)).astype(np.int64)]
    for k in range(langs):
        has = some[((masks[some, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)]
        places.append(np.full(len(has), slots + k, np.uint64))
        owners.append(has)
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return np.concatenate(places)[order].astype(np.int64), np.bincount(at, minlength=len(raw)).astype(np.int64)


class Field:
    """Weights: (slots + languages, languages) for features, (languages, languages) for transitions."""

    def __init__(self, langs: list[str], lexicon: np.ndarray, weights: np.ndarray, moves: np.ndarray):
        self.langs, self.lexicon, self.weights, self.moves = langs, lexicon, weights, moves

    def emissions(self, words: list[str]) -> np.ndarray:
        """Mean weight of each word's features, by language; zero for none."""
        slots = len(self.weights) - len(self.langs)
        flat, sizes = features(words, slots, self.lexicon, len(self.langs))
        out = np.zeros((len(words), len(self.langs)), np.float32)
        full = np.flatnonzero(sizes)
        if len(full):
            heads = (np.cumsum(sizes) - sizes)[full]
            out[full] = np.add.reduceat(self.weights[flat], heads, axis=0) / np.sqrt(sizes[full])[:, None]
        return out


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each label at each place of padded sequences (B, T, L); also scaled alphas and betas."""
    b, t, n = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max()).astype(e.dtype)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (e[:, i + 1] * beta[:, i + 1]) @ a.T
        x /= x.sum(axis=1, keepdims=True)
        beta[:, i] = np.where((i < sizes - 1)[:, None], x, 1)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    return gamma, alpha, beta * e


def train(samples: dict[str, list[list[str]]], slots: int = 1 << 16, length: int = 64, epochs: int = 3, batch: int = 64, rate: float = 0.3, decay: float = 1e-6, words_per_lang: int = 120_000, seed: int = 5) -> Field:
    """Fit a field to documents (lists of words) by language."""
    langs = sorted(samples)
    rng = np.random.Generator(np.random.PCG64(seed))
    n = len(langs)
    lexicon = np.zeros((LEX_SLOTS, -(-n // 64)), np.uint64)
    pieces: list[tuple[int, list[str]]] = []
    for at, lang in enumerate(langs):
        taken, seen = 0, {}
        for words in samples[lang]:
            words = [w for w in map(letters, words) if w]
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            i = 0
            while i < len(words) and taken < words_per_lang:
                k = int(rng.integers(3, 40))
                pieces.append((at, words[i : i + k]))
                taken += len(words[i : i + k])
                i += k
        for w, c in seen.items():
            if c > 1:
                lexicon[zlib.crc32(w.encode("utf-8", "surrogatepass")) % LEX_SLOTS, at // 64] |= np.uint64(1 << at % 64)
    order = rng.permutation(len(pieces))
    words = [w for i in order for w in pieces[i][1]]
    labels = np.array([pieces[i][0] for i in order for _ in pieces[i][1]], np.int64)
    length = max(1, min(length, len(words)))
    count = len(words) // length
    field = Field(langs, lexicon, np.zeros((slots + n, n)), np.zeros((n, n)))
    if not count or n == 1:
        return field
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64)[: count * length].reshape(count, length)
    labels = labels[: count * length].reshape(count, length)
    flat, sizes = features(list(known), slots, lexicon, n)
    heads = np.cumsum(sizes) - sizes
    g_w, g_m = np.full(field.weights.shape, 1e-8), np.full((n, n), 1e-8)
    for _ in range(epochs):
        shuffled = rng.permutation(count)
        for i in range(0, count, batch):
            at, gold = ids[shuffled[i : i + batch]], labels[shuffled[i : i + batch]]
            distinct, inverse = np.unique(at, return_inverse=True)
            spots = np.concatenate([flat[heads[d] : heads[d] + sizes[d]] for d in distinct.tolist()])
            lens = sizes[distinct]
            scale = 1 / np.sqrt(lens)[:, None]
            scores = (np.add.reduceat(field.weights[spots], np.cumsum(lens) - lens, axis=0) * scale)[inverse].reshape(*at.shape, n)
            gamma, alpha, eb = forward_backward(scores, np.full(len(at), length), field.moves)
            wrong = gamma - np.eye(n)[gold]
            per_word = np.stack([np.bincount(inverse.ravel(), wrong[..., k].ravel(), minlength=len(distinct)) for k in range(n)], 1) * scale
            pair = alpha[:, :-1, :, None] * np.exp(field.moves) * eb[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            d_m = pair.sum(axis=(0, 1)) / len(at)
            np.subtract.at(d_m, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1 / len(at))
            rows, back = np.unique(spots, return_inverse=True)
            spread = np.repeat(per_word, lens, axis=0)
            d_w = np.stack([np.bincount(back, spread[:, k], minlength=len(rows)) for k in range(n)], 1) / len(at) + decay * field.weights[rows]
            g_w[rows] += d_w**2
            g_m += d_m**2
            field.weights[rows] -= rate * d_w / np.sqrt(g_w[rows])
            field.moves -= rate * d_m / np.sqrt(g_m)
    return field


class Tagger:
    """Posteriors of whole texts, with the emissions of words met so far kept within a bound."""

    def __init__(self, field: Field, span: int = 256, around: int = 24, keep: int = 500_000, cells: int = 400_000):
        self.field, self.span, self.around, self.keep, self.cells = field, span, around, keep, cells
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, len(self.field.langs)), np.float32)
        self.real = np.zeros(1, bool)

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if new:
            bare = [letters(w) for w in new]
            for w in new:
                self.known[w] = len(self.known)
            self.rows = np.concatenate([self.rows, self.field.emissions(bare)])
            self.real = np.concatenate([self.real, np.array([any(map(str.isalpha, b)) for b in bare])])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words with letters: text, place among the words of the text, posterior by language."""
        if len(self.known) > self.keep:
            self._clear()
        n = len(self.field.langs)
        numbers = [(t or "").split() for t in texts]
        flat = self._numbers([w for ws in numbers for w in ws])
        counts = np.array([len(ws) for ws in numbers], np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        real = self.real[flat]
        flat, owner, place = flat[real], owner[real], place[real]
        counts = np.bincount(owner, minlength=len(texts))
        stops = np.cumsum(counts)
        starts = stops - counts
        begin = np.concatenate([np.arange(s, s + c, self.span) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
        gamma = np.zeros((len(flat), n), np.float32)
        if not len(begin):
            return owner, place, gamma
        end = np.minimum(begin + self.span, stops[owner[begin]])
        low = np.maximum(begin - self.around, starts[owner[begin]])  # with some words around
        sizes = np.minimum(end + self.around, stops[owner[begin]]) - low
        order = np.argsort(sizes, kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i + 1) * sizes[order[j]] <= self.cells:
                j += 1
            part = order[i:j]
            t = int(sizes[part].max())
            grid = low[part][:, None] + np.arange(t)
            inside = np.arange(t) < sizes[part][:, None]
            scores = self.rows[flat[np.minimum(grid, len(flat) - 1)]] * inside[..., None]
            own = (grid >= begin[part][:, None]) & (grid < end[part][:, None])
            gamma[grid[own]] = forward_backward(scores, sizes[part], self.field.moves)[0][own]
            i = j
        return owner, place, gamma

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: mean posterior by language, words with letters, changes of language between such words."""
        owner, _, gamma = self.posteriors(texts)
        counts = np.bincount(owner, minlength=len(texts))
        means = np.stack([np.bincount(owner, gamma[:, k], minlength=len(texts)) for k in range(len(self.field.langs))], 1) / np.maximum(counts, 1)[:, None]
        best = gamma.argmax(1)
        turns = np.bincount(owner[1:], (best[1:] != best[:-1]) & (owner[1:] == owner[:-1]), minlength=len(texts)).astype(np.int64) if len(owner) > 1 else np.zeros(len(texts), np.int64)
        return means, counts, turns

    def runs(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """For each text its runs of one language: (language, first word, word behind the last, mean posterior)."""
        owner, place, gamma = self.posteriors(texts)
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        if len(owner):
            best = gamma.argmax(1)
            heads = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])])
            ends = np.r_[heads[1:], len(owner)]
            sums = np.add.reduceat(gamma.max(1).astype(float), heads)
            for a, z, p in zip(heads.tolist(), ends.tolist(), sums.tolist(), strict=True):
                out[owner[a]].append((self.field.langs[best[a]], int(place[a]), int(place[z - 1]) + 1, p / (z - a)))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, max_langs: int = 256, doc_bytes: int = 200_000, **how) -> Field | None:
    ident = F.col(id_col).cast("long")
    labelled = docs.where(F.col(lang_col).isNotNull() & ident.isNotNull() & (F.crc32(ident.cast("string").cast("binary")) % 4 != 2))
    usable = labelled.where(F.octet_length(text_col) <= doc_bytes).select(ident.alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    langs = [r[0] for r in usable.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_langs).collect()]
    if not langs:
        return None
    # One pass for all languages: a rank with a limit, which tasks cut before they send. At most max_langs * per_lang ids.
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    ids = [tuple(r) for r in usable.where(F.col("l").isin(langs)).select("i", "l").distinct().withColumn("n", rank).where(F.col("n") <= per_lang).select("i", "l").collect()]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(sorted(ids), "i long, l string"))
    rows = usable.join(chosen, ["i", "l"], "left_semi").groupBy("l", "i").agg(F.min("t").alias("t")).collect()  # one text for each chosen id
    samples: dict[str, list[list[str]]] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r[1], r[0])):
        samples.setdefault(lang, []).append((text or "").split())
    return train(samples, **how) if samples else None


def labelled_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", group: int = 400, **how) -> DataFrame:
    """(doc_id, run, lang, first_word, end_word, posterior): the runs of one language in each text, in order."""
    field = fit(docs, id_col, text_col, lang_col, **how)
    parts = None if field is None else (field.langs, field.lexicon, field.weights.astype(np.float32), field.moves.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Field(*shared.value)) if shared.value else None
        for batch in batches:
            for i in range(0, batch.num_rows if tagger else 0, group):
                part = batch.slice(i, group)
                found = tagger.runs(part.column(1).to_pylist())
                rows = [(doc, k, *r) for doc, rs in zip(part.column(0).to_pylist(), found, strict=True) for k, r in enumerate(rs)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["doc_id", "run", "lang", "first_word", "end_word", "posterior"])

    schema = "doc_id long, run long, lang string, first_word long, end_word long, posterior double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", group: int = 400, **how) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, n_letter_words, n_switches."""
    field = fit(docs, id_col, text_col, lang_col, **how)
    parts = None if field is None else (field.langs, field.lexicon, field.weights.astype(np.float32), field.moves.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # of a size set by slots and max_langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Field(*shared.value)) if shared.value else None
        for batch in batches:
            for i in range(0, batch.num_rows, group):
                part = batch.slice(i, group)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                if tagger:
                    means, counts, turns = tagger.tag(texts)
                    best = means.argmax(1)
                    langs = [tagger.field.langs[b] if c else "und" for b, c in zip(best.tolist(), counts.tolist(), strict=True)]
                    scores = np.where(counts > 0, np.clip(means.max(1), 0, 1), 0.0)
                else:
                    counts = turns = np.zeros(len(ids), np.int64)
                    langs, scores = ["und"] * len(ids), np.zeros(len(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([held_out(d) for d in ids], pa.bool_()), pa.array(langs, pa.string()), pa.array(scores.astype(float)), pa.array(counts.astype(np.int64)), pa.array(turns.astype(np.int64))], names=["doc_id", "held_out", "lang_pred", "score", "n_letter_words", "n_switches"])

    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_letter_words long, n_switches long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
