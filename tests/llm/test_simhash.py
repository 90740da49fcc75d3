import random

import numpy as np
import pytest
import xxhash
from dendra.llm import components as links_joined
from dendra.llm.components import connected_components, joined
from dendra.llm.simhash import HOT_BUCKET, fingerprint, keep_one_of_each, link_fingerprints, near_duplicates, segments


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in (None, "", " \n", "A b", "a B c d", "Ünï A\x0bB c d e e e e e e", "x y z " * 400):
        assert fingerprint(text) == plain_fingerprint(text)


def test_odd_rows_match_brute_force(docs, rows):
    ids, fps = [r[0] for r in rows[0]], [plain_fingerprint(r[1]) for r in rows[0]]
    group = components(fps)
    least = {g: min((i for i, h in zip(ids, group) if h == g and i is not None), default=None) for g in group}
    want = [(i, f"{f:016x}", least[g]) for i, f, g in zip(ids, fps, group)]
    assert sorted(map(str, map(tuple, near_duplicates(docs).collect()))) == sorted(map(str, want))


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_one_of_each_stays(docs, rows):
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(5) == 2 and 6 not in ids and 7 not in ids and 16 not in ids and 15 in ids and ids.count(None) == 2


def test_crowded_buckets_lose_no_link(spark):
    """Clouds around a few centres, larger than HOT_BUCKET, with chains and lone fingerprints."""
    rng = random.Random(11)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        soft = rng.sample(range(64), 14)
        for _ in range(3 * HOT_BUCKET):
            fps.add(centre ^ sum(1 << b for b in rng.sample(soft, rng.randrange(0, 8))))
    chain = rng.getrandbits(64)
    for k in range(12):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(100)} | {0, 1, 2**63}
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    want = components(fps)
    got = {r.fp: r.root for r in link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    sets = lambda labels: sorted(sorted(f for f, x in labels.items() if x == y) for y in set(labels.values()))
    assert sets({f: got.get(f, f) for f in fps}) == sets(dict(zip(fps, want)))


def test_segments_cover_the_radius():
    assert [(w, b) for _, w, b in segments(4, 3)] == [(21, 1), (21, 1), (22, 0)]
    assert [(w, b) for _, w, b in segments(4, 2)] == [(32, 2), (32, 1)]


@pytest.mark.parametrize("task_links", [200_000, 60])
def test_components(spark, monkeypatch, task_links):
    monkeypatch.setattr(links_joined, "TASK_LINKS", task_links)
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_links_of_one_task():
    rng = np.random.default_rng(4)
    assert [len(x) for x in joined(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]
    for nodes, n in ((50, 30), (5, 40), (3000, 2900), (3000, 3000)):
        u, v = rng.integers(-nodes, nodes, (2, n))
        if n == 3000:
            u, v = np.arange(n), np.arange(n) + 1  # a path
        least = {x: x for x in np.concatenate([u, v]).tolist()}
        changed = True
        while changed:
            changed = False
            for a, b in [*zip(u.tolist(), v.tolist())] + [*zip(u.tolist(), v.tolist())][::-1]:
                if least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
        assert dict(zip(*(x.tolist() for x in joined(u, v)))) == {a: b for a, b in least.items() if a != b}


def test_components_in_tasks_of_bounded_memory(spark, monkeypatch):
    """Links that are spread over many tasks and forests: pairs are settled in their own tasks, so only what reaches into several goes on."""
    monkeypatch.setattr(links_joined, "TASK_LINKS", 20)
    monkeypatch.setattr(links_joined, "HELD_LINKS", 60)
    went_on, plain = [], links_joined._settled_links
    monkeypatch.setattr(links_joined, "_settled_links", lambda now, rounds: went_on.append(now.count()) or plain(now, rounds))
    path = random.Random(1).sample(range(1000, 1120), 120)
    for edges, most in (([(2 * k, 2 * k + 1) for k in range(150)], 0), ([(7, x) for x in range(200)], 0), (list(zip(path, path[1:])), 119)):
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        nodes = {x for e in edges for x in e}
        assert got == ({x: x - x % 2 for x in nodes} if len(nodes) == 300 else {x: min(nodes) for x in nodes}) and went_on.pop() <= most
