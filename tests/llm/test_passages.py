"""Substring dedup, decontamination, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from turnlake.llm import decontam, substring


def digests(rows):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows}


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 20_000, "bucket_bytes": 50_000}])
def test_removals_by_brute_force(spark, data, how):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = substring.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert digests(substring.cut_repeats(docs, **how).collect()) == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_planted_passages(make):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, short = words(55), words(19)
    rows = []
    for i in range(60):
        w = words(rng.randint(0, 80))
        at = rng.randrange(len(w) + 1)
        lo = rng.randrange(0, 30)
        w[at:at] = passage[lo : lo + rng.randint(20, 25)] if i % 3 == 0 else short if i % 3 == 1 else ["x"] * rng.randint(0, 70)
        rows.append((1000 - i, " ".join(w)))
    got = digests(substring.cut_repeats(make(rows), chunk_bytes=3000, bucket_bytes=4000).collect())
    assert got == substring.brute_force(rows)


def test_substring_odd_rows(make, odd):
    rows = substring.cut_repeats(make(odd)).collect()
    assert len(rows) == len(odd)
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_text"]))
    assert of[1] == of[2] == of[3] == [(0, 0, "")] and of[None] == [(5, 0, "no id here at all")]
    assert of[7] == [(60_000, 60_000, "")] * 2 and of[6][0][:2] == (60_000, 60_000 - 977 - 19 + 0) or of[6][0][1] > 0
    assert substring.cut_repeats(make([])).collect() == []


def test_named_phrases_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 40, 500).astype(np.uint64)
    hashes, places = substring.named_phrases(codes, np.arange(500) <= 480, 20, 8)
    inside = set(places.tolist())
    assert all(any(s <= p <= s + 12 for p in inside) for s in range(481)) and len(inside) < 300
    other, _ = substring.named_phrases(codes[100:200], np.arange(100) <= 80, 20, 8)
    assert set(other.tolist()) <= set(hashes.tolist())


def test_occurrences_by_brute_force_and_branches_of_states(monkeypatch):
    """Phrases over few and over very many different words; no state of an automaton has thousands of branches."""
    import ahocorasick

    made, rng = [], np.random.default_rng(3)
    kind = ahocorasick.Automaton
    monkeypatch.setattr(ahocorasick, "Automaton", lambda *a: made.append(kind(*a)) or made[-1])
    few, many = rng.integers(0, 3, 3000), np.r_[rng.permutation(70_000), np.arange(5000, 9000), 1_200_000]
    for numbers, patterns in ((few, np.arange(0, 200, 5)), (many, np.arange(0, 60_000, 12)), (many, np.array([70_000, 73_000, 73_993])), (few, np.empty(0, np.int64)), (few[:0], np.empty(0, np.int64))):
        wanted = {tuple(numbers[p : p + 8].tolist()) for p in patterns.tolist()}
        want = [i for i in range(len(numbers) - 7) if tuple(numbers[i : i + 8].tolist()) in wanted] if wanted else []
        assert substring.occurrences(numbers, patterns, 8).tolist() == want and len(want) >= len(patterns)
    branches = [max(np.unique([e[0] for e in a.dump()[1]], return_counts=True)[1]) for a in made if len(a)]
    assert len(branches) == 3 and max(branches) <= 1200


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_edits_by_dynamic_programming():
    rng = random.Random(7)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 16))]
        most = rng.randint(0, 5)
        want = slow_edits(a, b[: len(a) + most])
        assert decontam.edits_within(a, b, most) == (want if want <= most else None)


def items_of(spark, data):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]


def test_contamination_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 700")
    items = items_of(spark, data)
    want = decontam.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    rows = decontam.contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect()
    got = {r["doc_id"]: r["item_ids"] for r in rows}
    assert got.keys() == want.keys() and all(set(got[d]) <= set(want[d]) for d in want)
    assert sum(map(len, got.values())) >= 0.9 * sum(map(len, want.values()))


def test_share_found_of_edited_passages(spark, data):
    rng = random.Random(1)
    items = items_of(spark, data)
    index = decontam.Index([(i, t.encode()) for i, t in items])
    planted = []
    for _ in range(300):
        i, t = rng.choice(items)
        w = t.split()
        for _ in range(rng.randint(0, int(0.2 * len(w)))):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [["zz"], []][rng.random() < 0.4 and len(w) > 5]
        noise = lambda: [f"n{rng.randrange(999)}" for _ in range(rng.randint(0, 60))]
        planted.append((i, " ".join([*noise(), *w, *noise()])))
    codes = decontam.BoundedCodes(xxhash.xxh64_intdigest)
    found = decontam.found_in(index, codes, [t.encode() for _, t in planted])
    sets = {i: decontam.words_of(t.encode()) for i, t in items}
    near = [any(slow_edits(sets[i], decontam.words_of(t.encode())[s : s + len(sets[i]) + 12]) <= int(0.2 * len(sets[i]) + 1e-9) for s in range(len(t.split()))) for i, t in planted]
    hits = [i in h for (i, _), h in zip(planted, found, strict=True)]
    assert sum(near) > 200 and sum(h and n for h, n in zip(hits, near, strict=True)) >= 0.97 * sum(near)
    assert not any(h and not n for h, n in zip(hits, near, strict=True))


@pytest.mark.parametrize("kind", ["deletions", "insertions", "substitutions", "mixed"])
def test_share_found_by_length_and_kind_of_edits(kind):
    """With the whole budget of 20% used up; one segment with one edit is found at 0.99, and most items have several."""
    rng, sizes, repeats = random.Random(2), [5, 9, 14, 15, 29, 60, 100, 200, 400], 100
    items = [(k, [f"w{rng.randrange(10**6)}" for _ in range(n)]) for k, n in enumerate(sizes * repeats)]
    index = decontam.Index([(i, " ".join(w).encode()) for i, w in items])
    texts = []
    for i, w in items:
        w, gone = list(w), sorted(rng.sample(range(len(w)), len(w) // 5), reverse=True)
        for k in gone:
            edit = kind if kind != "mixed" else rng.choice(["deletions", "insertions", "substitutions"])
            w[k : k + (edit != "insertions")] = [] if edit == "deletions" else [f"z{rng.randrange(10**6)}"]
        noise = lambda: [f"n{rng.randrange(999)}" for _ in range(rng.randint(0, 60))]
        texts.append(" ".join([*noise(), *w, *noise()]).encode())
    found = decontam.found_in(index, decontam.BoundedCodes(xxhash.xxh64_intdigest), texts)
    for n in set(sizes):
        assert sum(i in f for f, (i, w) in zip(found, items, strict=True) if len(w) == n) >= 0.95 * repeats
    assert sum(i in f for f, (i, _) in zip(found, items, strict=True)) >= 0.985 * len(items)
    assert all(list(f) in ([], [i]) and f.get(i, 1) >= 0.8 - 1e-9 for f, (i, _) in zip(found, items, strict=True))


def test_few_different_words_against_brute_force():
    """Items and documents of few different words, so that segments meet by chance too."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = [(i, words(rng.randint(1, 30))) for i in range(60)]
    docs = [(i, words(rng.randint(0, 60))) for i in range(150)]
    found = decontam.found_in(decontam.Index([(i, t.encode()) for i, t in items]), decontam.BoundedCodes(xxhash.xxh64_intdigest), [t.encode() for _, t in docs])
    want = decontam.brute_force(docs, items)
    assert all(set(f) <= set(want[d]) for (d, _), f in zip(docs, found, strict=True))
    assert sum(map(len, found)) >= 0.99 * sum(map(len, want.values()))


def test_decontam_odd_rows_and_blocks(spark, make, odd):
    bench = spark.createDataFrame([(1, "one", "n", 5), (2, None, "n", 5), (None, "one two", "n", 5), (3, "  ", "n", 5), (4, "a b c d e f g a b c d e f g", "n", 5), (4, "a b c d e f g a b c d e f g", "n", 5)], "item_id long, text string, item_ids string, doc_id int")
    docs = make([*odd, (40, "x y ONE, z"), (None, "so one it is"), (8, "only one of two"), (8, "none")])
    results = []
    for how in ({}, {"block_bytes": 8}):
        rows = decontam.contamination(docs, bench, **how).collect()
        results.append(sorted((r["doc_id"] or -1, r["item_ids"], r["contaminated"], r["best_similarity"] or 0) for r in rows))
        got = {r["doc_id"]: r["item_ids"] for r in rows}
        assert len(rows) == len(odd) + 4 and got[4] == [1] and got[40] == [1] and got[9] == [4] and got[1] == []
    assert results[0] == results[1]
    assert [x[1] for x in results[0] if x[0] in (-1, 8)] == [[], [1], [], [], [1]]
    kept = decontam.clean(docs, bench, block_bytes=8)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 6, 7, 7, 8, 8, 10]
    assert not any(r["contaminated"] for r in decontam.contamination(docs, bench.limit(0)).collect())
    assert decontam.contamination(make([]), bench).collect() == []


def test_pipeline_by_its_parts(spark, data):
    """Each stage against a plain re-computation of what it must keep."""
    import corpus_pipeline as cp
    from turnlake.llm import pii, quality
    from turnlake.llm.simhash import shingle_hashes

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    verdict, known = quality.fit(docs, labels), quality._Tokens()
    left = {i: t for i, t in texts.items() if not quality.base_failed(*np.array(quality.base_counts(t))[[0, 4]]) and verdict.score(t, known) >= verdict.threshold}
    sets = {i: set(shingle_hashes(t.encode(), 5).tolist()) for i, t in left.items()}
    root = {i: i for i in left}
    ids = sorted(left)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if left[a] == left[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    left = {i: left[i] for i in left if root[i] == i}
    found = {r["doc_id"] for r in decontam.contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").collect()}
    left = {i: pii.Pseudonyms().replaced(t)[0] for i, t in left.items() if i not in found}
    import zlib

    rows = cp.run(spark, data).collect()
    assert {r["doc_id"]: r["decoded_crc32"] for r in rows} == {i: zlib.crc32(t.encode()) for i, t in left.items()}
    assert all(r["lossless"] for r in rows) and len(cp.STAGES) == 5


def test_pipeline_stages_keep_columns_on_odd_rows(spark, make, odd, data):
    import corpus_pipeline as cp

    for pairs in (odd, []):
        docs = make(pairs)
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == docs.columns, name
            out.count()
        assert cp.STAGES[-1][1](spark, docs, data).count() == len(pairs)
