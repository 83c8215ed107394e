"""Quality rules by hashed n-gram log-likelihood ratio.

Two multinomials over a fixed number of hashed n-gram buckets: one of a trusted target (all documents labelled good and
not toxic), one of the whole raw corpus. A document's score is the mean over its n-grams of log p_target - log p_raw. One
threshold, the same for every document, is put where it parts all labelled documents best, but no higher than ``spare``
of the trusted ones allows; ``Verdict.rates`` says what share of either kind it rejects, and what the best cut alone would
have.

Labels meet the texts in a sort-merge join, one shuffle of the texts whatever the number of labels; ``fit`` makes two of
them, the second to score labelled texts, ``quality_rules`` one, as it scores every text and stores the scores. The
threshold is found among the scores of labelled documents by a range-partitioned sort.

An n-gram is one or two consecutive tokens; tokens are runs of word characters or runs of other non-space characters,
case kept, hashed by CRC-32. Base rules (too few words, repeated phrases) go first, as in ``base_counts``.

``buckets`` (10,000) fixes the size of all that reaches the driver, but for a row a partition of the sort.

Defined cases: a null or empty text has no words and fails the base rules; of a labelled id that several rows share, the
least score counts for the threshold; columns of ``labels`` besides doc_id, quality and toxic aren't read; a document without n-grams scores 0; with no
trusted rows (or no rejected ones to part them from) every document that passes the base rules is kept; repeated rows
count and return as often as they occur; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, stored

TOKEN = re.compile(r"\w+|[^\w\s]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[token] = h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return h


def ngram_buckets(text: str | None, buckets: int, known: dict) -> np.ndarray:
    """Bucket of every unigram and bigram of a text."""
    tokens = TOKEN.findall(text or "")
    one = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    two = (one[:-1] * 31 + one[1:] * 1_000_003 + 7) & 0x7FFFFFFF
    return np.concatenate([one, two]) % buckets


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    # Code points in words: all but ASCII white space.
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = len(SYMBOLS.findall(text))
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeated = 0
    if n >= 6:
        code: dict[bytes, int] = {}
        ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
        runs = ids[: n - 4]
        for j in range(1, 5):  # exact: runs are renumbered after each word
            runs = np.unique(runs * len(code) + ids[j : n - 4 + j], return_inverse=True)[1]
        often = np.flatnonzero(np.bincount(runs)[runs] > 1)
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, often, 1)
        np.add.at(marks, often + 5, -1)
        repeated = int((np.cumsum(marks)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


class Verdict:
    """The fitted rule: a ratio for each bucket, and the threshold."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold
        self.rates: dict[str, float] = {}

    def score(self, text: str | None, known: dict) -> float:
        at = ngram_buckets(text, len(self.ratio), known)
        return float(self.ratio[at].mean()) if len(at) else 0.0


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, good): every id that is labelled good and not toxic, or else of low quality."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good"), (F.col("quality") == 0).alias("bad"))
    return marks.where("doc_id IS NOT NULL AND (good OR bad)").groupBy("doc_id").agg(F.max("good").alias("good"))


def ratios(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, buckets: int, smooth: float) -> np.ndarray:
    """log p_target - log p_raw of each bucket, counted over every document; zeros without a trusted one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, target = _Tokens(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = np.bincount(ngram_buckets(text, buckets, known), minlength=buckets)
                raw += seen
                if good:
                    target += seen
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = texts.where("doc_id IS NOT NULL").join(marks.hint("merge"), "doc_id", "left").select("text", "good")
    nameless = texts.where("doc_id IS NULL").select("text", F.lit(None).cast("boolean").alias("good"))  # else all in one partition
    sums = named.unionByName(nameless).mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # at most `buckets` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in sums:
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(buckets)
    logs = lambda c: np.log((c + smooth) / (c.sum() + smooth * buckets))
    return logs(target) - logs(raw)


def place_threshold(scores: DataFrame, spare: float) -> tuple[float, dict[str, float]]:
    """The score of (good, score) rows that parts them best (largest difference of their rates, the least such score), at
    most the ``spare`` quantile of good ones; and the rates of both cuts. Minus infinity if either kind is missing."""
    cuts = scores.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    cuts = settle(cuts.repartitionByRange("score").sortWithinPartitions("score").withColumn("part", F.spark_partition_id()))
    parts = sorted((lo, part, g, b) for part, lo, g, b in cuts.groupBy("part").agg(F.min("score"), F.sum("g"), F.sum("b")).collect())  # a row a partition
    n_good, n_bad = (sum(x[i] for x in parts) for i in (2, 3))
    best = cut = -np.inf
    if n_good and n_bad:
        before, at = [], [0, 0]
        for _, part, g, b in parts:
            before.append((part, *at))
            at = [at[0] + g, at[1] + b]
        below = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = cuts.join(F.broadcast(cuts.sparkSession.createDataFrame(before, "part int, g0 long, b0 long")), "part")
        placed = placed.select("score", "g", (F.col("g0") + F.sum("g").over(below) - F.col("g")).alias("gs"), (F.col("b0") + F.sum("b").over(below) - F.col("b")).alias("bs"))
        # Rejected: score < cut.
        best = cut = placed.orderBy(F.desc(F.col("bs") / F.lit(n_bad) - F.col("gs") / F.lit(n_good)), "score").first()["score"]
        if spare < 1:
            nth = int(spare * n_good)
            cut = min(best, placed.where((F.col("gs") <= nth) & (F.col("gs") + F.col("g") > nth)).first()["score"])
    under = lambda kind, at: F.coalesce(F.sum(F.when(F.col("score") < float(at), F.col(kind))), F.lit(0))
    rejected = cuts.agg(under("g", cut), under("b", cut), under("g", best), under("b", best)).first()
    names = [f"rejected_{kind}{name}" for name in ("", "_best_cut") for kind in ("trusted", "rejected")]
    return float(cut), {name: n / max(1, of) for name, n, of in zip(names, rejected, [n_good, n_bad] * 2, strict=True)}


LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # `buckets` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rule = _Tokens(), Verdict(shared.value, -np.inf)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            failed = np.array([base_failed(int(n), int(r)) for n, r in counts[:, [0, 4]]], bool)
            scores = np.array([rule.score(t, known) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, i]) for i in range(5)], pa.array(failed), pa.array(scores)], names=["doc_id", *LONGS, "base_failed", "score"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in LONGS) + ", base_failed boolean, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _ratio_and_marks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int, smooth: float) -> tuple[np.ndarray, DataFrame]:
    marks = _marks(labels)
    return ratios(docs, marks, id_col, text_col, buckets, smooth), marks


def _placed(rows: DataFrame, ratio: np.ndarray, spare: float) -> Verdict:
    """The verdict by the least score of each labelled id in the rows (doc_id, good, score)."""
    verdict = Verdict(ratio, -np.inf)
    if ratio.any():
        verdict.threshold, verdict.rates = place_threshold(rows.groupBy("doc_id", "good").agg(F.min("score").alias("score")), spare)
    return verdict


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, spare: float = 0.02, smooth: float = 1.0) -> Verdict:
    """Count both multinomials and place the threshold, over every document and label; nothing is stored."""
    ratio, marks = _ratio_and_marks(docs, labels, id_col, text_col, buckets, smooth)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # `buckets` numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rule = _Tokens(), Verdict(shared.value, -np.inf)
        for batch in batches:
            mask, scores = [], []
            for text in batch.column(2).to_pylist():
                n, *_, repeated = base_counts(text)
                mask.append(not base_failed(n, repeated))
                scores.append(rule.score(text, known) if mask[-1] else None)
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "good", "score"])
            yield made.filter(pa.array(mask, pa.bool_()))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labelled = texts.join(marks.hint("merge"), "doc_id").select("doc_id", "good", "text")
    return _placed(labelled.mapInArrow(judge, "doc_id long, good boolean, score double"), ratio, spare)


def _kept(rows: DataFrame, verdict: Verdict) -> DataFrame:
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(float(verdict.threshold)))
    return rows.select("doc_id", *LONGS, "base_failed", kept.alias("kept"), "score")


def judged(docs: DataFrame, verdict: Verdict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    return _kept(scored(docs, verdict.ratio, id_col, text_col), verdict)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, spare: float = 0.02, smooth: float = 1.0) -> DataFrame:
    """``judged`` by the verdict fitted on the same documents; each is scored once, its scores are stored."""
    ratio, marks = _ratio_and_marks(docs, labels, id_col, text_col, buckets, smooth)
    rows = stored(scored(docs, ratio, id_col, text_col), "quality-scores")
    return _kept(rows, _placed(rows.where("NOT base_failed").select("doc_id", "score").join(marks, "doc_id"), ratio, spare))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, all their columns, in one pass without a shuffle once fitted."""
    verdict = fit(docs, labels, id_col, text_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast((verdict.ratio, verdict.threshold))  # `buckets` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rule = _Tokens(), Verdict(*shared.value)
        for batch in batches:
            mask = []
            for text in batch.column(text_col).to_pylist():
                n, *_, repeated = base_counts(text)
                mask.append(not base_failed(n, repeated) and rule.score(text, known) >= rule.threshold)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
