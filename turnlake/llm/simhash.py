"""SimHash near-duplicates by segment-popcount embedding.

A text's 64-bit fingerprint sets a bit when over half of its shingle hashes set it. To link fingerprints at a
Hamming distance of at most two without comparing all of them:

1. *Embedding.* A fingerprint maps to the bit counts of its sixteen 4-bit segments, a point of the grid {0..4}^16.
   The Manhattan distance of two points never exceeds the Hamming distance of their fingerprints.
2. *Grid range-join.* Every fingerprint is filed under its own grid cell and the at most 32 cells one step away. Two
   points within distance two always share such a cell (their midpoint), so an equi-join on cells finds every
   candidate: 33 rows a fingerprint, whatever the number of fingerprints.
3. *Verification.* ``bit_count(a ^ b) <= 2`` on candidates.

Cells that more than ``crowd`` fingerprints share aren't paired. Their members are filed under themselves and their
64 one-bit neighbours instead: members of such a group are within two bits of each other by the triangle inequality,
and every pair within two bits shares one, so linking each member to the group's smallest is exact, in 65 rows each.

Copies of one text share one fingerprint and are never expanded into pairs. Components are found by minimum-label
propagation with pointer jumping, with a reliable checkpoint each round.

Defined cases: a null or empty text (or one of white space only) has fingerprint zero and links like any other; fewer
words than a shingle give one shingle of the whole sequence; repeated rows give repeated result rows; an empty table
gives an empty result; a null doc_id gets a row of its own but never names a component. Columns besides the id and
text columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, raw_bytes, settle, stored

LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, width: int, seed: int = 42, block: int = 50_000) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of a lower-cased text, repeats included."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    del words
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1]
    ends = ends[width - 1 :]
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), block):
        cut = [joined[a:b] for a, b in zip(starts[i : i + block].tolist(), ends[i : i + block].tolist(), strict=True)]
        out[i : i + len(cut)] = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.uint64, len(cut))
    return out


def majority(groups: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each group of hashes; zero for an empty group."""
    sizes = np.array([len(g) for g in groups], np.int64)
    result = np.zeros(len(groups), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return result
    hashes = np.concatenate([groups[i] for i in full])
    sizes = sizes[full]
    starts = np.cumsum(sizes) - sizes
    # Sums of at most 255 hashes, so that the eight byte lanes of a word don't run over.
    blocks = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
    first = np.searchsorted(blocks, starts)
    fingerprints = np.zeros(len(full), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, blocks)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        for byte in range(8):
            fingerprints |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + shift)
    result[full] = fingerprints
    return result


def majority_rows(hashes: np.ndarray) -> np.ndarray:
    """The same for rows of as many hashes each: the bits of all of them counted side by side, in planes."""
    n = hashes.shape[1]
    planes: list[np.ndarray] = []
    for carry in hashes.T:
        for i, plane in enumerate(planes):
            planes[i], carry = plane ^ carry, plane & carry
        if len(planes) < n.bit_length():
            planes.append(carry)
    more, even = np.zeros(len(hashes), np.uint64), np.full(len(hashes), ~np.uint64(0))
    for i in reversed(range(len(planes))):  # compare the counts with the least majority
        if (n // 2 + 1) >> i & 1:
            even &= planes[i]
        else:
            more |= even & planes[i]
            even &= ~planes[i]
    return more | even


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_bytes(batch.column(1))
            for i in range(0, len(texts), 500):
                fps = majority([shingle_hashes(t, width) for t in texts[i : i + 500]])
                ids = batch.column(0).slice(i, len(fps))
                yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def cell_of(fp: str) -> Column:
    """The grid cell of a fingerprint: the bit counts of its sixteen segments, a hexadecimal digit each."""
    return F.expr(" + ".join(f"(shiftrightunsigned({fp}, {i}) & {0x1111111111111111})" for i in range(4)))


def _cells(fps: DataFrame) -> DataFrame:
    """(fp, key, off): each fingerprint's own grid cell (off 0) and the cells one step away (off 1..32)."""
    counts = cell_of("fp")
    steps = F.array(F.lit(0), *[F.when(F.expr(f"shiftrightunsigned(cell, {4 * i}) & 15") < 4, F.lit(2 * i + 1)) for i in range(16)], *[F.when(F.expr(f"shiftrightunsigned(cell, {4 * i}) & 15") > 0, F.lit(2 * i + 2)) for i in range(16)])
    return (
        fps.withColumn("cell", counts)
        .select("fp", "cell", F.explode(F.array_compact(steps)).alias("off"))
        .select(
            "fp",
            F.expr("CASE WHEN off = 0 THEN cell WHEN off % 2 = 1 THEN cell + shiftleft(1L, (off - 1) DIV 2 * 4) ELSE cell - shiftleft(1L, (off - 1) DIV 2 * 4) END").alias("key"),
            F.col("off").cast("int").alias("off"),
        )
    )


def links(fps: DataFrame, max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints whose closure is that of all pairs within ``max_bits``.

    Outside crowded cells these are all such pairs; within crowded cells each member is linked to the smallest of every
    one-bit neighbourhood it shares, which joins the same components.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("cells one step away find distances up to two")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits
    keyed = _cells(fps)
    shared = settle(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    two = shared.where("n = 2").select("a", "b")
    members = settle(keyed.join(shared.where("n > 2").select("key", "n"), "key"))
    x, y = members.where(F.col("n") <= crowd).alias("x"), members.where(F.col("n") <= crowd).alias("y")
    # Each pair at its canonical midpoint only: the own cell of x, or steps of both in the order of segments.
    once = (F.col("x.off") == 0) | ((F.col("y.off") > 0) & (F.expr("(x.off - 1) DIV 2 <= (y.off - 1) DIV 2")) & (F.col("x.off") != F.col("y.off")))
    few = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & once & near(F.col("x.fp"), F.col("y.fp"))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pairs = two.where(near(F.col("a"), F.col("b"))).unionByName(few)
    crowded = members.where(F.col("n") > crowd).select("fp").distinct()
    if max_bits and not crowded.isEmpty():
        flips = [F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).astype(np.int64)))) for i in range(64)]
        around = crowded.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("mid"))
        if max_bits == 2:
            least = around.groupBy("mid").agg(F.min("fp").alias("a"))
            stars = around.join(least, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
        else:  # one bit apart: a fingerprint and its neighbour itself
            stars = around.join(crowded.select(F.col("fp").alias("mid")), "mid").where("mid < fp").select(F.col("mid").alias("a"), F.col("fp").alias("b"))
        pairs = pairs.unionByName(stars)
    return pairs.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of an edge list (a, b)."""
    pairs = settle(pairs)
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = settle(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        taken = settle(labels.join(offered, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("was")))
        if taken.where("label <> was").isEmpty():
            return taken.select("node", "label")
        hop = taken.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = settle(taken.join(hop, taken.label == hop["at"]).select("node", F.col("next").alias("label")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest id reachable over links."""
    prints = settle(fingerprints(docs, id_col, text_col, width))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(first.select("fp"), max_bits, crowd))
    rooted = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def text_node(text: str) -> Column:
    """The 64-bit hash that stands for a text among those compared; null is as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def view_prints(docs: DataFrame, id_col: str, text_col: str, width: int, views: int, sample: int) -> DataFrame:
    """(doc_id, node, size, prints): the text's hash, its number of distinct shingles, and fingerprints: of each view of
    the text, then of the whole.

    A view is a seeded order of shingles; its fingerprint is that of the ``sample`` first shingles in it, or of all if
    there are no more. Texts of similarity s share it with probability about s to the power of ``sample``, other texts
    hardly ever.
    """
    orders = mix64(np.arange(views, dtype=np.uint64), 77)[:, None] | np.uint64(1)  # of hashes times an odd number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_bytes(batch.column(2))
            for i in range(0, len(texts), 500):
                part = texts[i : i + 500]
                hashes = [shingle_hashes(t, width) for t in part]
                unique = [np.unique(h) for h in hashes]
                sizes = np.array([len(h) for h in unique], np.int64)
                whole = majority(hashes)
                prints = np.repeat(whole[:, None], views + 1, axis=1)
                full = np.flatnonzero(sizes > sample)
                if len(full):
                    firsts = np.concatenate([np.partition(unique[k] * orders, sample, axis=1)[:, :sample] for k in full])
                    prints[full, :views] = majority_rows(mix64(firsts)).reshape(len(full), views)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * (views + 1)), pa.array(prints.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), batch.column(1).slice(i, len(part)), pa.array(sizes), lists], names=["doc_id", "node", "size", "prints"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_node(text_col).alias("node"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, node long, size long, prints array<long>")


def jaccard(a: bytes | None, b: bytes | None, width: int) -> float:
    """Share of common shingles of two texts; 1 for equal ones, and for two without words."""
    x, y = np.unique(shingle_hashes(a, width)), np.unique(shingle_hashes(b, width))
    if a == b or not len(x) + len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


def lone_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(node, lone): how many shingles of a text (node, t) no other of the texts has; none, no row."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_bytes(batch.column(1))
            for i in range(0, len(texts), 200):
                hashes = [np.unique(shingle_hashes(t, width)) for t in texts[i : i + 200]]
                nodes = np.repeat(batch.column(0).slice(i, len(hashes)).to_numpy(), [len(h) for h in hashes])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(hashes).view(np.int64))], names=["node", "shingle"])

    shingles = texts.select("node", "t").mapInArrow(spread, "node long, shingle long")
    return shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("lone"))


WORDS = 16  # of 64 bits in a sketch


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(node, s0 .. s15): 1024 bits of each text (node, t). Each is a bit of the least shingle in an order of its own, so
    that of two texts of similarity s a share of (1 - s) / 2 differ."""
    orders = mix64(np.arange(64 * WORDS, dtype=np.uint64), 78) | np.uint64(1)
    names = [f"s{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 64 * WORDS), bool)
            for row, text in enumerate(raw_bytes(batch.column(1))):
                h = np.unique(shingle_hashes(text, width))
                step = max(1, (1 << 18) // max(1, len(h)))
                for i in range(0, len(orders) if len(h) else 0, step):
                    out[row, i : i + step] = mix64((h[:, None] * orders[i : i + step]).min(0)) & np.uint64(1)
            packed = np.packbits(out, axis=1).view(np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(packed[:, i]) for i in range(WORDS)]], names=["node", *names])

    return texts.select("node", "t").mapInArrow(run, "node long, " + ", ".join(f"{n} long" for n in names))


def near_sketches(h: str, m: str, similarity: float) -> Column:
    """Whether two sketches differ in no more bits than texts of that similarity do, and four deviations."""
    bits, q = 64 * WORDS, (1 - similarity) / 2
    apart = reduce(operator.add, [F.bit_count(F.col(f"{h}.s{i}").bitwiseXOR(F.col(f"{m}.s{i}"))) for i in range(WORDS)])
    return apart <= int(bits * q + 4 * (bits * q * (1 - q)) ** 0.5)


def open_meetings(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (meet, node, ...) of meetings that hold more than one component, with their labels."""
    named = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("meet").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("meet")
    return settle(named.join(mixed, "meet"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, t) are similar, computed from the texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_bytes(batch.column(2)), raw_bytes(batch.column(3))
            close = [jaccard(x, y, width) >= similarity for x, y in zip(*texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(close, pa.bool_()))

    beside = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
    return settle(beside.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, max_bits: int, views: int, sample: int) -> DataFrame:
    """(doc_id, node, label) of every row; equal labels: one group."""
    prints = stored(view_prints(docs, id_col, text_col, width, views, sample), "view-prints")
    own = stored(prints.select("node", "size", "prints").dropDuplicates(["node"]), "texts-prints")
    met = own.select("node", "size", F.posexplode("prints").alias("view", "print")).select("node", "size", F.xxhash64("view", cell_of("print")).alias("meet"))
    met = stored(met.join(met.groupBy("meet").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "meet"), "meetings")
    sizes = own.select(F.col("node").alias("a"), F.col("size").alias("size_a"))
    pairs = met.where("node <> a").select("a", F.col("node").alias("b"), "size").distinct().join(sizes, "a")
    pairs = pairs.where(F.least("size", "size_a") >= similarity * F.greatest("size", "size_a") - 1e-9).select("a", "b")
    by_print = own.select("node", F.element_at("prints", -1).alias("fp")).groupBy("fp").agg(F.min("node").alias("a"))
    near = links(by_print.select("fp"), max_bits)
    at = lambda c, d: by_print.select(F.col("fp").alias(c), F.col("a").alias(d))
    near = near.join(at("a", "x"), "a").join(at("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = settle(pairs.unionByName(near).distinct())
    # From here on, only the texts that met others; they are shuffled once for that.
    some = met.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.select(text_node(text_col).alias("node"), F.col(text_col).cast("string").alias("t")).join(some, "node", "left_semi")
    texts = stored(texts.dropDuplicates(["node"]), "texts-that-met")
    edges = verified(pairs, texts, width, similarity)
    labels = components(edges)
    members = open_meetings(met.where("n > 2 AND node <> a").select("meet", "node", "size"), labels)
    if not members.isEmpty():
        some = settle(texts.join(members.select("node").distinct(), "node", "left_semi"))
        members = members.join(sketches(some, width), "node").join(lone_shingles(some, width), "node", "left").withColumn("shared", F.col("size") - F.coalesce("lone", F.lit(0))).drop("lone")
        # A text without enough shared shingles is like none of the others.
        members = members.where(F.col("shared") >= similarity * F.col("size") - 1e-9).withColumn("share", F.col("shared") / F.greatest("size", F.lit(1)))
        members = open_meetings(members, labels)
    heads_each = 64
    while not members.isEmpty():
        order = Window.partitionBy("meet").orderBy(F.desc("share"), "node")
        heads = settle(members.withColumn("at", F.row_number().over(order)).where(F.col("at") <= heads_each).drop("at"))
        h, m = heads.alias("h"), members.alias("m")
        after = (F.col("m.share") < F.col("h.share")) | ((F.col("m.share") == F.col("h.share")) & (F.col("m.node") > F.col("h.node")))
        most = F.least("h.shared", "m.shared")
        likely = most >= similarity * (F.col("h.size") + F.col("m.size") - most) - 1e-9
        meet = (F.col("h.meet") == F.col("m.meet")) & (F.col("h.label") != F.col("m.label"))
        pairs = h.join(m, meet & after & likely & near_sketches("h", "m", similarity)).select(F.least("h.node", "m.node").alias("a"), F.greatest("h.node", "m.node").alias("b")).distinct()
        found = verified(pairs, texts, width, similarity)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            labels = components(edges)
        members = open_meetings(members.join(heads.select("meet", "node"), ["meet", "node"], "left_anti"), labels)
        heads_each *= 64
    named = own.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return prints.select("doc_id", "node").join(named, "node")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_bits: int = 2, views: int = 16, sample: int = 4) -> DataFrame:
    """(doc_id, component_id) of every row: groups of texts linked at ``similarity`` or more of their shingles.

    Texts at 0.8 differ in some ten of 64 fingerprint bits, beyond what a grid over 64 bits can separate. So besides the
    fingerprint's own links (the grid range-join), ``views`` small samples of a text's shingles are fingerprinted too, and
    all these fingerprints go through the same segment-popcount embedding: texts meet where they share a grid cell. A
    link is kept only after its exact similarity was computed from the two texts. Equal texts are one from the start.

    All members of a meeting are held against one of them first. Where the others are still of more than one component,
    they are held against further heads, 64 times as many each round, until every two members of a meeting are of one
    component or were compared. Heads come in the order of the share of their shingles that others have too: a source of
    edited copies is before its copies. Texts x and y have at most c = min(s_x, s_y) shingles in common, s being those of
    a text that any other has; pairs that ``c / (|x| + |y| - c)`` puts below ``similarity`` aren't compared, nor, of the
    first ones, those whose sizes alone do, nor those whose sketches of 1024 bits are over four deviations further apart
    than such texts' (3 of 100,000 pairs at just ``similarity``). So in a large group of edited copies of one text, texts
    are sent for those pairs alone that are near the limit.

    A null id counts after all others; component_id is null in a group of such rows only.
    """
    found = settle(_labelled(docs, id_col, text_col, width, similarity, max_bits, views, sample))
    least = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "label").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_bits: int = 2, views: int = 16, sample: int = 4) -> DataFrame:
    """One row of each group of similar texts, with all its columns: that of the smallest id, null ids last, and of rows
    that share that id that of the smallest text hash; of rows equal in id and text one."""
    found = settle(_labelled(docs, id_col, text_col, width, similarity, max_bits, views, sample))
    best = found.groupBy("label").agg(F.min("doc_id").alias("least"))
    ours = found.join(best, "label").where(F.col("doc_id").eqNullSafe(F.col("least")))
    kept = settle(ours.groupBy("label", "least").agg(F.min("node").alias("__kept_node"), F.count("*").alias("n")))
    rows = docs.withColumn("__kept_node", text_node(text_col)).join(kept.select("__kept_node", F.col("least").alias("__kept_id")), "__kept_node")
    rows = rows.where(F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id"))).drop("__kept_id")
    if not kept.where("n > 1").isEmpty():  # rows equal in id and text
        rows = rows.dropDuplicates([id_col, "__kept_node"])
    return rows.select(*docs.columns)
