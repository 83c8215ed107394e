import itertools
import random

import numpy as np
import pytest
import xxhash

from turnlake.llm import simhash
from pyspark.sql import functions as F


def slow_print(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=2):
    label = {f: f for f in set(prints)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(label), 2):
        if bin(a ^ b).count("1") <= bits:
            label[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in label}


def test_fingerprints_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["fp"] % 2**64 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: slow_print(t) for i, t in texts.items()}


def test_fingerprint_is_that_of_spark_hashes(spark):
    words = "the quick brown fox jumps".split()
    shingles = [" ".join(words[i : i + 3]) for i in range(3)]
    want = [r[0] % 2**64 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    assert simhash.shingle_hashes(" ".join(words).encode(), 3).tolist() == want


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_join_what_brute_force_joins(spark, crowd):
    rng = random.Random(5)
    prints = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(12):  # chains and dense balls
            f = base if rng.random() < 0.5 else rng.choice(sorted(prints))
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    prints |= {0, 1, 3, 2**64 - 1, 2**63}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    pairs = simhash.links(fps, 2, crowd)
    found = {(r["a"] % 2**64, r["b"] % 2**64) for r in pairs.collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in found)
    if crowd == 64:
        every = {frozenset(p) for p in itertools.combinations(prints, 2) if bin(p[0] ^ p[1]).count("1") <= 2}
        assert {frozenset(p) for p in found} == every
    labels = {r["node"] % 2**64: r["label"] % 2**64 for r in simhash.components(pairs).collect()}
    want = slow_components(prints)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(labels) == {g for g in groups(want) if len(g) > 1}


def test_odd_rows_and_result(spark, make, odd):
    got = sorted((r["doc_id"] or -1, r["component_id"], r["fp"]) for r in simhash.near_duplicates(make(odd)).collect())
    by_id = {}
    for i, c, f in got:
        by_id.setdefault(i, []).append((c, f))
    assert len(got) == len(odd)
    assert {by_id[i][0] for i in (1, 2, 3)} == {(1, 0)}
    assert len(by_id[7]) == 2 and by_id[7][0][0] == 6
    assert by_id[-1][0][0] is None
    assert simhash.near_duplicates(make(odd[:0])).collect() == []


def test_keep_one(make, odd):
    docs = make(odd)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 8, 9, 10]


def test_keep_one_with_shared_and_missing_ids(make):
    """Different texts of one id both stay; copies without an id go before those with one; equal rows leave one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (None, a), (None, c), (None, c), (9, a), (7, b + " end")]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(make(rows)).collect())
    near = min((simhash_node(t), t) for t in (b, b + " end"))[1]
    assert kept == sorted([(7, a), (7, near), (-1, c)])
    assert simhash.keep_one(make([])).collect() == []


def simhash_node(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64))


def test_majority_by_rows():
    rng = np.random.default_rng(1)
    for k in range(1, 10):
        h = rng.integers(0, 1 << 63, (50, k), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (50, k), dtype=np.uint64)
        assert simhash.majority_rows(h).tolist() == simhash.majority(list(h)).tolist()


def test_similar_texts_form_groups(make):
    rng = random.Random(3)
    rows, group = [], {}
    for g in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for k in range(rng.randint(1, 5)):
            w = list(words)
            for _ in range(int(len(w) * 0.018) if k else 0):  # each edit spoils five shingles of either text
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            group[len(rows)] = g, k
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(make(rows)).collect()}
    texts = dict(rows)
    first = {g: i for i, (g, k) in group.items() if k == 0}
    near = [i for i, (g, k) in group.items() if k and simhash.jaccard(texts[i].encode(), texts[first[g]].encode(), 5) >= 0.8]
    assert len(near) > 30 and sum(got[i] == first[group[i][0]] for i in near) >= 0.98 * len(near)
    assert all(group[i][0] == group[c][0] for i, c in got.items())


@pytest.mark.parametrize("where", [0.5, 1.0])
def test_edited_copies_of_a_source_of_any_id_form_one_group(make, where):
    """Copies at 0.82 of a source that isn't the smallest id, and lower to each other."""
    rng = random.Random(8)
    rows, group = [], {}
    for n in (10, 120):
        source = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts = []
        for _ in range(n):
            w = list(source)
            for k in rng.sample(range(6), 6):  # places wide apart: each edit spoils five shingles of either text
                w[rng.randrange(50 * k + 5, 50 * k + 45)] = f"x{rng.randrange(10**9)}"
            texts.append(w)
        texts.insert(int(where * n), source)
        for w in texts:
            group[len(rows)] = n
            rows.append((len(rows), " ".join(w)))
    first = {g: min(i for i in group if group[i] == g) for g in group.values()}
    assert simhash.jaccard(rows[0][1].encode(), rows[1][1].encode(), 5) < 0.8
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(make(rows)).collect()}
    assert got == {i: first[g] for i, g in group.items()}
