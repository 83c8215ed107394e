"""Language identification, language model, pieces."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from turnlake.llm import langid, lm, pieces


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    sizes = np.array([4, 2])
    gamma, _, _ = langid.forward_backward(scores, sizes, moves)
    for b, n in enumerate(sizes):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(scores[b, i, y] for i, y in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            for i, y in enumerate(path):
                want[i, y] += w
        want /= want.sum(1, keepdims=True)
        assert np.allclose(gamma[b, :n], want)


def test_training_learns_switching_text():
    a, b = [f"ka{i % 9}lo ma ri".split() for i in range(60)], [f"zu{i % 9}x the thor".split() for i in range(60)]
    field = langid.train({"aa": a, "bb": b}, slots=1 << 12, length=16)
    assert field.moves[0, 0] + field.moves[1, 1] > field.moves[0, 1] + field.moves[1, 0]
    means, counts, turns = langid.Tagger(field, span=4).tag(["kalo ma ri ma", "the thor zux", "ma ri ma ri the thor the thor", "12 !!", None])
    assert means[0].argmax() == 0 and means[1].argmax() == 1 and turns[2] == 1 and counts.tolist() == [4, 3, 8, 0, 0]


def test_runs_of_code_switched_text():
    a, b = [f"ka{i % 9}lo ma ri".split() for i in range(60)], [f"zu{i % 9}x the thor".split() for i in range(60)]
    tagger = langid.Tagger(langid.train({"aa": a, "bb": b}, slots=1 << 12, length=16), span=4, around=2)
    found = tagger.runs(["ma ri ma ri 12 the thor the thor ma ri kalo", None, "!!"])
    assert [(r[0], r[1], r[2]) for r in found[0]] == [("aa", 0, 4), ("bb", 5, 9), ("aa", 9, 12)] and found[1:] == [[], []]
    assert all(0.5 < r[3] <= 1 for r in found[0])


def test_sequences_with_words_around_are_near_whole_texts():
    rng = np.random.default_rng(2)
    a, b = [f"ka{i % 9}lo ma ri".split() for i in range(60)], [f"zu{i % 9}x the thor".split() for i in range(60)]
    field = langid.train({"aa": a, "bb": b}, slots=1 << 12, length=16)
    text = " ".join(rng.choice("ma ri kalo the thor zux xx yy".split(), size=300))
    whole, cut = (langid.Tagger(field, span=s).posteriors([text])[2] for s in (1000, 40))
    assert np.abs(whole - cut).max() < 0.01


def test_more_languages_than_a_machine_word_has_bits_and_very_few_words():
    word = lambda k, end: f"{chr(97 + k // 9)}{chr(109 + k % 9)}{end}"
    samples = {f"l{k:03d}": [[word(k, "a"), word(k, "b"), word(k, "a")] * 8] for k in range(70)}
    field = langid.train(samples, slots=1 << 14, length=8, epochs=4)
    means = langid.Tagger(field).tag([f"{word(k, 'a')} {word(k, 'b')}" for k in range(70)])[0]
    assert np.mean([field.langs[m.argmax()] == f"l{k:03d}" for k, m in enumerate(means)]) > 0.9
    few = langid.train({"aa": [["foo", "foo"]], "bb": [["bar", "bar"]]}, slots=1 << 10)
    assert np.abs(few.weights).sum() > 0


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = [lang[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_langid_odd_rows(make, odd):
    rows = {r["doc_id"]: r for r in langid.identify(make([*odd, (11, "12 ½ !!")])).collect()}
    assert {rows[i]["lang_pred"] for i in (1, 2, 3, 11)} == {"und"} and rows[4]["lang_pred"] == "en"
    none = langid.identify(make(odd, lang=None)).collect()
    assert len(none) == len(odd) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in none)
    assert langid.identify(make([])).collect() == []


def slow_base(rows):
    c = Counter()
    words = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in rows:
        if not lm.held_out(i):
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    return n, {i: (len(words(t)), sum(c[w] > 0 for w in words(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in rows}


@pytest.mark.parametrize("how", [{}, {"block_tokens": 3000, "bucket_bytes": 20_000}])
def test_lm_base_and_held_out_gain(spark, data, how):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n, want = slow_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = lm.score_documents(docs, **how).collect()
    assert len(rows) == len(want)
    for r in rows:
        tokens, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and abs(r["base_score"] - base) < 1e-6
        assert r["score"] < 0 and r["held_out"] == lm.held_out(r["doc_id"])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def bucket_of(texts, ids=None, n_buckets=1, heavy=None):
    """All restaurants of a few texts in one bucket, and what its fit is told."""
    import pyarrow as pa

    heavy = heavy or lm.Heavy(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    (block,) = lm.blocks(ids or list(range(1, len(texts) + 1)), [t.encode() for t in texts], 10**6)
    table = lambda rows, schema: pa.Table.from_batches([lm.batch_of(rows, schema)])
    totals = lm.sum_words(table([r for r in lm.count_words(block, heavy, 1)], lm.COUNTED)).to_pylist()
    stats = next(r for r in totals if r["bucket"] is None)
    base = next(r for r in totals if r["bucket"] == 0)
    rows = table([(b, 0, *x, None) for b, *x in lm.invert(block, heavy, 1)], lm.SENT).to_pydict()
    m = {"types": stats["types"], "tokens": stats["tokens"], "discount": 0.4, "sweeps": 5, "burn": 2}
    return lm.Bucket(rows, {"codes": np.frombuffer(base["codes"], np.uint64), "counts": np.frombuffer(base["counts"], np.int64)}, heavy), m


TRAINED = [i for i in range(1, 400) if not lm.held_out(i)]


def test_lm_probabilities_sum_to_one():
    """Over known types and the one further type, after every context."""
    b, m = bucket_of(["a b a b c", "a a b", "c c c a b b"], TRAINED[:3])
    b.start(m)
    rng = np.random.default_rng(1)
    for _ in range(3):
        b.sweep(rng)
        further = m["discount"] * m["types"] / (m["types"] + 1) / m["tokens"]
        assert abs(b.root.sum() + further - 1) < 1e-9
        back = (b.theta0 + b.d0 * b.parent_tables.sum()) / (b.theta0 + b.parent_counts.sum())
        assert abs(b.prior().sum() + back * further - 1) < 1e-9
        laid = b.laid()
        for u in range(len(b.contexts)):
            seen = b.ctx == u
            rest = (b.theta + b.d * laid[u]) / (b.theta + b.served[u])
            p = rest + ((b.counts - b.d * b.tables)[seen] / (b.theta + b.served[u])).sum()
            assert abs(p - 1) < 1e-9 and b.served[u] == b.counts[seen].sum()


def slow_seat(counts, prior, rest, d, theta, draws):
    """Dish by dish and customer by customer, a number for each but the first."""
    tables = []
    for c, p, r in zip(counts, prior, rest, strict=True):
        t = min(c, 1)
        for n in range(1, c):
            fresh = (theta + d * (r + t)) * p
            t += draws() * (fresh + n - d * t) < fresh
        tables.append(t)
    return tables


def test_scores_are_those_of_a_slow_sampler():
    """Restaurants as dictionaries, over words rather than codes, with the same random numbers."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05], size=rng.integers(1, 25))) for _ in range(11)]
    ids = list(range(1, 12))
    b, m = bucket_of(texts, ids)
    logs = b.fitted(m, np.random.default_rng(9))
    got = {(int(b.contexts[u]), int(b.words[w])): x for u, w, x in zip(b.ctx, b.dish, logs, strict=True)}
    code = lambda w: lm.END if w is None else xxhash.xxh64_intdigest(w)
    counts, words, everything = Counter(), Counter(), []
    for i, t in zip(ids, texts, strict=True):
        before = None
        for w in [*t.split(), None]:
            pair = code(before), code(w)
            everything.append(pair)
            if not lm.held_out(i):
                counts[pair] += 1
                words[code(w)] += 1
            before = w
    pairs = sorted(set(everything))
    names = sorted({w for _, w in pairs})
    served = {u: sum(c for (v, _), c in counts.items() if v == u) for u, _ in pairs}
    root = {w: (max(words[w] - 0.4, 0) + 0.4 * m["types"] / (m["types"] + 1)) / m["tokens"] for w in names}
    rng = np.random.default_rng(9)
    tables = {p: min(counts[p], 1) for p in pairs}
    parent = {w: sum(t for (_, v), t in tables.items() if v == w) for w in names}
    laid0 = {w: min(c, 1) for w, c in parent.items()}
    d, d0 = lm.discount_of(np.array(list(counts.values()))), lm.discount_of(np.array(list(parent.values())))
    theta = theta0 = 1.0
    mean = dict.fromkeys(pairs, 0.0)
    for sweep in range(m["sweeps"]):
        prior = lambda w: (parent[w] - d0 * laid0[w] + (theta0 + d0 * sum(laid0.values())) * root[w]) / (theta0 + sum(parent.values()))  # noqa: E731, B023
        laid = lambda u: sum(t for (v, _), t in tables.items() if v == u)  # noqa: E731, B023
        made = slow_seat([counts[p] for p in pairs], [prior(w) for _, w in pairs], [laid(u) - tables[u, w] for u, w in pairs], d, theta, rng.random)
        tables = dict(zip(pairs, made, strict=True))
        parent = {w: sum(t for (_, v), t in tables.items() if v == w) for w in names}
        made = slow_seat([parent[w] for w in names], [root[w] for w in names], [sum(laid0.values()) - laid0[w] for w in names], d0, theta0, rng.random)
        laid0 = dict(zip(names, made, strict=True))
        contexts = sorted(served)
        theta = lm.draw_theta(theta, d, np.array([served[u] for u in contexts]), np.array([laid(u) for u in contexts]), rng)
        theta0 = lm.draw_theta(theta0, d0, np.array([sum(parent.values())]), np.array([sum(laid0.values())]), rng)
        if sweep >= m["burn"]:
            for u, w in pairs:
                mean[u, w] += (counts[u, w] - d * tables[u, w] + (theta + d * laid(u)) * prior(w)) / (theta + served[u])
    assert max(counts.values()) > 4 and max(parent.values()) > 10 and len(pairs) > 30
    assert got.keys() == set(pairs)
    assert all(abs(got[p] - math.log10(mean[p] / (m["sweeps"] - m["burn"]))) < 1e-9 for p in pairs)


def test_seating_side_by_side_is_seating_one_by_one():
    rng = np.random.default_rng(4)
    counts, prior, rest = rng.integers(0, 300, 200), rng.random(200) * 0.5, rng.integers(0, 50, 200)
    for run in (1 << 20, 1000, 50):
        made = lm.seat(counts, prior, rest, 0.6, 2.0, np.random.default_rng(7), run) if run > 300 else None
        slow = slow_seat(counts.tolist(), prior.tolist(), rest.tolist(), 0.6, 2.0, np.random.default_rng(7).random)
        assert made is None or made.tolist() == slow
    assert max(slow) > 20


def test_seating_by_table_is_seating_by_customer():
    """Dishes beyond a run: drawing the next table's customer at once against drawing for each customer."""
    rng = np.random.default_rng(3)
    n, most = 3000, 400
    by_table = np.array([lm.seat(np.array([most]), np.array([1e-3]), np.array([2000.0]), 0.5, 1.0, rng, 20)[0] for _ in range(n)])
    one_by_one = lm.seat(np.full(n, most), np.full(n, 1e-3), np.full(n, 2000.0), 0.5, 1.0, rng)
    assert abs(by_table.mean() - one_by_one.mean()) < 4 * (by_table.std() + one_by_one.std()) / n**0.5 and by_table.min() >= 1
    # The chance that nobody opens a table, as a product.
    for seated, m, t, a in ((1, 50, 1, 0.7), (40, 90, 7, 3.2), (1000, 5000, 20, 0.01)):
        product = np.prod([(j - 0.5 * t) / (j - 0.5 * t + a) for j in range(seated, m)])
        x = lambda v: np.array([v - 0.5 * t])  # noqa: E731, B023
        assert abs(np.exp(lm.log_rise(x(seated), np.array([a])) - lm.log_rise(x(m), np.array([a])))[0] - product) < 1e-9
    huge = lm.seat(np.array([10**10]), np.array([0.001]), np.array([0.0]), 0.5, 1.0, rng)
    assert 1 <= huge[0] < 10**7


def test_heavy_contexts_are_dealt_by_word_and_lose_nothing():
    texts = ["the " + " the ".join(f"w{i % 40}" for i in range(k, k + 60)) for k in range(30)]
    (block,) = lm.blocks(TRAINED[:30], [t.encode() for t in texts], 10**6)
    code = np.uint64(xxhash.xxh64_intdigest(b"the"))
    heavy = lm.Heavy.dealt(np.array([code]), np.array([1800]), 600)
    assert heavy.parts.tolist() == [12]
    bucket = block.buckets(heavy, 8)
    after_the = block.codes[block.contexts] == code
    assert len(set(bucket[after_the].tolist())) > 4
    for u in set(block.contexts[~after_the].tolist()):
        assert len(set(bucket[block.contexts == u].tolist())) == 1
    rows = list(lm.invert(block, heavy, 8))
    assert sum(len(np.frombuffer(r[-1], np.uint16)) for r in rows) == len(block.numbers)
    assert max(np.bincount(bucket)) < 0.6 * len(bucket)
    big = block.buckets(heavy, 1 << 40)  # as many buckets as 100 TB and more would have
    assert big.min() >= 0 and big.max() > 1 << 35
    list(lm.invert(block, heavy, 1 << 40)), lm.count_words(block, heavy, 1 << 40)


def test_lm_odd_rows(make, odd):
    rows = lm.score_documents(make(odd)).collect()
    assert len(rows) == len(odd)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1} and all(math.isfinite(r["score"]) for r in rows)
    assert lm.score_documents(make([])).collect() == []
    untrained = lm.score_documents(make([(i, "a b") for i in range(200) if lm.held_out(i)])).collect()
    assert untrained and all(r["train_tokens"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in untrained)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_without_dropout_pieces_are_the_models_own(spark, data, vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    flat, counts = pieces.Encoder(vocabulary, dropout=0.0).encode(list(range(len(texts))), texts)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == model.encode(texts)


def test_round_trip_and_variety(make, odd, vocabulary):
    docs = make([*odd, (30, "▁ mark  and   spaces \n"), (31, "same words same words " * 50)])
    rows = pieces.encoded(docs).collect()
    assert len(rows) == len(odd) + 2 and all(r["lossless"] for r in rows)
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in docs.collect())
    again = {r["doc_id"]: r["pieces"] for r in pieces.encoded(docs.repartition(1), group=2).collect()}
    assert all(again[r["doc_id"]] == r["pieces"] for r in rows)
    many = next(r for r in rows if r["doc_id"] == 31)["pieces"]
    plain = pieces.Encoder(vocabulary, dropout=0.0).encode([31], ["same words same words " * 50])[0].tolist()
    assert many != plain and len(many) > len(plain)
    assert pieces.encoded(make([])).collect() == []


def test_grid_and_heap_agree(vocabulary):
    rng = np.random.default_rng(2)
    words = [" " + "".join(rng.choice(list("etaoinshr"), size=rng.integers(1, 30))) for _ in range(300)] + [" \U0001f600é漢▁x", "   "]
    for k in (0, 1):
        keys = np.array([pieces.word_key(w, k, 3) for w in words], np.uint64)
        flat, lens = pieces.segment_words(vocabulary, words, keys, 0.2)
        assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == [pieces.segment_word(vocabulary, w, k, 3, 0.2) for w in words]


def test_one_candidate_is_skipped_as_many_are(vocabulary):
    rng = np.random.default_rng(4)
    key, start, end, piece = (rng.integers(0, 1 << 62, 500), *rng.integers(0, 3000, (3, 500)))
    many = pieces.skipped(key.astype(np.uint64), start, end, piece, 0.3)
    assert many.tolist() == [pieces.skips_one(*map(int, x), 0.3) for x in zip(key, start, end, piece, strict=True)]


def test_dropout_against_a_plain_agenda(vocabulary):
    """Short words: the same segmentations as a list walked candidate by candidate, given which of them are skipped."""

    def plain(word, skips):
        parts, barred, nth = [vocabulary.chars[c] for c in word], set(), 0
        spans = [(i, i + 1) for i in range(len(word))]
        while True:
            open_ = [(vocabulary.rank[vocabulary.pairs[a, b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in vocabulary.pairs and (spans[i], spans[i + 1]) not in barred]
            if not open_:
                return parts, nth
            _, i = min(open_)
            if nth in skips:
                barred.add((spans[i], spans[i + 1]))
            else:
                parts[i : i + 2] = [vocabulary.pairs[parts[i], parts[i + 1]]]
                spans[i : i + 2] = [(spans[i][0], spans[i + 1][1])]
            nth += 1

    rng = np.random.default_rng(6)
    words = [" " + "".join(rng.choice(list("etaoinshrdlu"), size=rng.integers(1, 15))) for _ in range(400)]
    skips = [tuple(sorted(rng.choice(6, size=rng.integers(0, 4), replace=False).tolist())) for _ in words]
    flat, lens, drawn = pieces.segment_skipping(vocabulary, words, skips)
    want = [plain(w, set(k)) for w, k in zip(words, skips, strict=True)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == [p for p, _ in want] and drawn.tolist() == [n for _, n in want]


def test_each_occurrence_has_its_own_skips(vocabulary):
    """Shares of a frequent word's segmentations against independent skips, by occurrences in one text and over ids."""
    for word in ("important", "evaluation", "internationalisations"):
        draws = 4000
        independent = [tuple(pieces.segment_word(vocabulary, " " + word, k % 256, 1000 + k // 256, 0.1)) for k in range(draws)]
        for ids, texts in ((list(range(draws)), [word] * draws), ([5], [" ".join([word] * draws)])):
            flat, counts = pieces.Encoder(vocabulary).encode(ids, texts)
            if len(ids) == 1:
                again = pieces.Encoder(vocabulary).encode(ids, texts)[0]
                assert flat.tolist() == again.tolist() and vocabulary.decode(flat.tolist()) == texts[0]
                continue
            cuts = np.cumsum(counts)[:-1]
            got = [tuple(x.tolist()) for x in np.split(flat, cuts)]
            assert len(set(got)) > 20
            for way in set(independent):
                share = independent.count(way) / draws
                assert abs(got.count(way) / draws - share) < 0.01 + 4 * (share * (1 - share) / draws * 2) ** 0.5
