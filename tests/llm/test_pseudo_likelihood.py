import random
from collections import Counter

import numpy as np
from dendra.llm import pseudo_likelihood as L
from tests.llm.conftest import prose

SIDE = 16


def plain_log_probability(net, tokens, at):
    total = net.bias.astype(float).copy()
    for k, o in enumerate(L.OFFSETS):
        near = tokens[at + o] if 0 <= at + o < len(tokens) else net.pad
        total += net.embed[near].astype(float) * net.place[k]
    hidden, c = np.tanh(total), tokens[at] // net.side
    a = net.to_class @ hidden + net.class_bias
    part = slice(c * net.side, (c + 1) * net.side)
    b = net.to_token[part] @ hidden + net.token_bias[part]
    return a[c] - np.log(np.exp(a).sum()) + b[tokens[at] % net.side] - np.log(np.exp(b).sum())


def network(seed=0):
    made = L.Network.fresh(np.ones(SIDE * SIDE))
    made.flat[:] = np.random.default_rng(seed).normal(0, 0.3, len(made.flat))
    made.embed[made.pad] = 0
    return made


def test_probabilities_match_brute_force():
    net, rng = network(), np.random.default_rng(1)
    held = [rng.integers(net.pad, size=n) for n in (5, 1, 0, 9)]
    padded, places = L._padded([h.astype(np.int32) for h in held], net.pad)
    want = [plain_log_probability(net, h, i) for h in held for i in range(len(h))]
    assert np.allclose(net.log_probabilities(padded, places), want, atol=1e-4)


def test_probabilities_sum_to_one():
    net, tokens = network(), np.array([3, 70, 200, 5, 40], dtype=np.int32)
    total = 0.0
    for t in range(net.pad):
        tokens[2] = t
        padded, places = L._padded([tokens], net.pad)
        total += np.exp(net.log_probabilities(padded, places[2:3]).astype(float))[0]
    assert abs(total - 1) < 1e-3


def test_gradient_matches_differences():
    net = L.Network(network().flat.astype(np.float64), SIDE)
    rng = np.random.default_rng(2)
    padded, places = L._padded([rng.integers(net.pad, size=n).astype(np.int32) for n in (25, 1, 14)], net.pad)
    slope = net.gradient(padded, places)
    loss = lambda: -net.log_probabilities(padded, places).mean()
    for i in np.argsort(-np.abs(slope))[:: len(slope) // 40]:
        was, step = net.flat[i], 1e-5
        net.flat[i] = was + step
        up = loss()
        net.flat[i] = was - step
        assert abs((up - loss()) / (2 * step) - slope[i]) < 1e-5
        net.flat[i] = was


def test_vocabulary_counts_all_words(docs, rows):
    want = Counter(int(h) for r in rows[0] for h in L.hashes_of(r[1]))
    vocabulary, counts = L.learn_vocabulary(docs)
    assert counts.sum() == sum(want.values()) == sum(len((r[1] or "").split()) for r in rows[0])
    tokens = vocabulary.tokens(np.array(list(want), dtype=np.uint64))
    by_token = np.bincount(tokens, weights=list(want.values()), minlength=len(counts))
    assert (by_token == counts).all() and vocabulary.side == SIDE
    most = sorted(want.values(), reverse=True)[: vocabulary.frequent]
    assert counts[: vocabulary.frequent].tolist() == most


def test_the_vocabulary_grows():
    sides = [L.side_for(10**k) for k in range(13)]
    assert sides == sorted(sides) and sides[0] == 16 and sides[8] > sides[7] > sides[6] and sides[-1] == L.MOST_SIDE


def test_tree_sum(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN_IN", 4)
    rows = [(p, 1.0 + p, np.array([p, 2.0 * p]).tobytes()) for p in range(37)]
    weight, vector = L.tree_sum(spark.createDataFrame(rows, L.PART))
    assert weight == sum(1.0 + p for p in range(37)) and vector.tolist() == [sum(range(37)), 2.0 * sum(range(37))]


def test_training_learns_order(spark, monkeypatch):
    """Texts that follow a rule get likelier than the same words shuffled."""
    monkeypatch.setattr(L, "BATCH", 32)
    monkeypatch.setattr(L, "GROUP_BYTES", 20_000)
    rng = random.Random(3)
    cycle = [f"c{i}" for i in range(20)]
    texts = []
    for _ in range(120):
        k = rng.randrange(20)
        texts.append(" ".join(cycle[(k + j) % 20] for j in range(200)))
    rows = list(enumerate(texts))
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    df = spark.createDataFrame([*rows, (1000, " ".join(shuffled))], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.per_token for r in L.score_documents(df, rounds=3).collect()}
    assert got[0] > got[1000] + 0.5


def test_odd_rows(docs, rows, no_docs):
    got = L.score_documents(docs, rounds=1).collect()
    key = lambda x: str(tuple(x[:2]))
    want = [(r[0], len((r[1] or "").split())) for r in rows[0]]
    assert sorted((tuple(r)[:2] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert (r.per_token is None) == (r.tokens == 0) and (r.tokens == 0) == (r.pseudo_log_likelihood == 0)
    same = [r.per_token for r in got if r.doc_id in (15, 16, 17)]
    assert max(same) - min(same) < 1e-5
    assert L.score_documents(no_docs).collect() == []
    assert prose(random.Random(1), 3) == prose(random.Random(1), 3)


def test_training_matches_a_plain_run_whatever_the_layout(spark, monkeypatch):
    """Every token is a target once; the result is that of a plain loop over rounds and groups, for any partitioning."""
    monkeypatch.setattr(L, "BATCH", 256)
    monkeypatch.setattr(L, "GROUP_BYTES", 4000)
    rows = [(i if i % 9 else None, prose(random.Random(i), 10 + 5 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, plain = [], L.tree_sum
    monkeypatch.setattr(L, "tree_sum", lambda parts: (lambda found: seen.append(found[0]) or found)(plain(parts)))
    vocabulary, got = L.train(df, rounds=2)
    assert sum(seen) == sum(len(t.split()) for _, t in rows) and len(seen) == 2

    size = sum(len(t) for _, t in rows)
    dealt = L._dealt(df, 2, groups := -(-size // 8000)).collect()
    assert groups > 3
    net = L.Network.fresh(L.learn_vocabulary(df)[1])
    for number in range(2):
        total, weight = 0, 0
        for g in range(groups):
            texts = [r.text for r in sorted((r for r in dealt if r.round == number and r.group == g), key=lambda r: r.place)]
            own, first, second, steps, n = L.Network(net.flat.copy(), net.side), 0, 0, 0, 0
            padded, places = L._padded([vocabulary.tokens(L.hashes_of(t)) for t in texts], net.pad)
            for at in range(0, len(places), 256):
                slope, steps, n = own.gradient(padded, places[at : at + 256]), steps + 1, n + len(places[at : at + 256])
                first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
                own.flat -= 0.01 / (1 + number) * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.99**steps)) + 1e-6)
            total, weight = total + own.flat.astype(float) * n, weight + n
        net = L.Network((total / weight).astype(np.float32), net.side)
    assert np.abs(net.flat - got.flat).max() < 1e-3

    scores = [sorted((str(r.doc_id), r.tokens, r.per_token) for r in L.score_documents(df.repartition(n), rounds=2).collect()) for n in (2, 7)]
    assert [x[:2] for x in scores[0]] == [x[:2] for x in scores[1]]
    assert max(abs(x[2] - y[2]) for x, y in zip(*scores)) < 1e-4
