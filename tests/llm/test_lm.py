import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pipespark.llm import lm, queries
from pipespark.llm.common import LOWER, Workspace, id_crc

SF = "/root/testdata/sf0.01"


def plain_forward(seq, start, move, emit):
    a, total = start * emit[seq[0]], 0.0
    for s in seq[1:]:
        total += math.log(a.sum())
        a = (a / a.sum()) @ move * emit[s]
    return total + math.log(a.sum())


def plain_counts(seq, start, move, emit):
    """By enumeration of all paths of a short sequence."""
    k, n = len(start), len(seq)
    c = [np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape)]
    total = 0.0
    for code in range(k**n):
        path = [code // k**i % k for i in range(n)]
        p = start[path[0]] * emit[seq[0], path[0]]
        for t in range(1, n):
            p *= move[path[t - 1], path[t]] * emit[seq[t], path[t]]
        total += p
        c[0][path[0]] += p
        for t in range(n):
            c[2][seq[t], path[t]] += p
            if t:
                c[1][path[t - 1], path[t]] += p
    return [x / total for x in c], math.log(total)


@pytest.fixture()
def model():
    rng = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0)


@pytest.mark.parametrize("steps,side", [(1 << 15, 1 << 18), (3, 20), (1, 5)])
def test_recursions_equal_enumeration(model, monkeypatch, steps, side):
    monkeypatch.setattr(lm, "STEPS", steps)
    monkeypatch.setattr(lm, "_SIDE_BY_SIDE", side)
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 5, 8, 3, 8, 7, 2, 1)]
    got = lm.expected_counts(seqs, *model)
    want = [plain_counts(s.tolist(), *model) for s in seqs]
    for g, ws in zip(got[:3], zip(*[w[0] for w in want], strict=True), strict=True):
        assert np.allclose(g, sum(ws))
    assert np.isclose(got[3], sum(w[1] for w in want))
    assert np.allclose(lm.log_likelihoods(seqs, *model), [w[1] for w in want])
    long = [rng.integers(0, 7, 500).astype(np.uint16)]
    assert np.isclose(lm.log_likelihoods(long, *model)[0], plain_forward(long[0].tolist(), *model))


def test_query_has_exact_base_and_a_better_model(spark):
    docs = {d.doc_id: [*(d.text or "").encode().translate(LOWER).split(), None] for d in queries.table(spark, SF, "documents").collect()}
    c = Counter()
    for k, w in docs.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    got = queries.op1_hidden_markov(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        w = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_the_exact_likelihood_and_training_raises_it(spark, monkeypatch):
    """With a vocabulary cut short, so that texts need classes and the join."""
    for k, x in (("WORDS", 50), ("LOOKUP", 200), ("_HELD_WORDS", 40)):
        monkeypatch.setattr(lm, k, x)
    docs = queries.table(spark, SF, "documents").limit(200)
    of_training = id_crc() % 7 != 2
    texts = {d.doc_id: (d.text or "").encode().translate(LOWER).split() for d in docs.collect()}
    train = [w for k, w in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(x for w in train for x in w)
    work = Workspace(spark)
    counts = work.keep(lm.count_words(docs.filter(of_training).selectExpr("cast(text as binary) as t")), "counts")
    assert {bytes(r.w): r.n for r in counts.collect()} == c
    voc, known = lm.vocabulary(counts, len(train))
    assert voc.n_own <= 50 < len(voc.entries) <= 200 and min(voc.counts) == known
    assert voc.tokens == sum(c.values()) + len(train) and voc.distinct == len(c) + 1
    encoded = work.keep(lm.encode(docs.selectExpr("doc_id", "doc_id as row", "cast(text as binary) as t"), voc), "encoded")
    model, logliks = lm.train(encoded, voc, iterations=4)
    assert all(b > a - 1e-6 * abs(a) for a, b in zip(logliks, logliks[1:], strict=False))
    own = {w: i for i, w in enumerate(voc.entries[: voc.n_own])}
    share = {g: math.log10(1 / (voc.class_tokens[g] + voc.class_words[g] + 1)) for g in range(lm.CLASSES)}
    got = {r.doc_id: r.score for r in lm.score(docs, of_training, Workspace(spark)).collect()}
    # The same by hand, from the model that the same data give.
    again, _ = lm.train(encoded.filter(id_crc() % 7 != 2), voc)
    for k in list(texts)[:40]:
        w = texts[k]
        seq = [own.get(x, voc.n_own + lm.ending(x)) for x in w] + [voc.symbols - 1]
        extra = sum(math.log10(c[x] + 1) + share[lm.ending(x)] for x in w if x not in own)
        assert np.isfinite(got[k])
        want = plain_forward(seq, *again) / math.log(10) + extra
        assert abs(got[k] - want) < 1e-6 * max(1, abs(want))


def test_probabilities_of_symbols_add_up(spark):
    voc = lm.Vocabulary([b"a", b"b"], np.array([9, 4]), 1, np.zeros(lm.CLASSES, np.int64), np.zeros(lm.CLASSES, np.int64), 3, 16, 3)
    start, move, emit = lm.starting_model([np.array([0, voc.symbols - 1], np.uint16)] * 3, voc.prior())
    assert np.allclose(emit.sum(0), 1) and np.allclose(move.sum(1), 1) and np.isclose(start.sum(), 1) and (emit > 0).all()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "Word word " * 30_000, "x"), (5, "a b c", "x"), (5, "a b c", "x"), (None, "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = lm.score(df, id_crc() % 7 != 2, Workspace(spark)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_tokens for r in got} == {1: 1, 2: 1, 3: 1, 4: 60_001, 5: 4, None: 2}
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm.score(df.limit(0), id_crc() % 7 != 2, Workspace(spark)).count() == 0
    none = lm.score(df, id_crc() < 0, Workspace(spark)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)
