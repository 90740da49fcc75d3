import random
from collections import defaultdict

from dendra.llm.conflict_packing import best_fit, pack, pack_documents
from dendra.llm.simhash import near_duplicates
from tests.llm.conftest import prose


def plain_best_fit(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= max(1, length) and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        if fits:
            i = min(fits)[1]
        else:
            bins.append([capacity, set(), set()])
            i = len(bins) - 1
        bins[i][0] -= length
        bins[i][1].add(source)
        bins[i][2].add(cluster)
        out.append(i)
    return out


def test_best_fit_matches_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        capacity = rng.choice([1, 5, 20, 100])
        pieces = [(rng.randint(0, capacity), rng.choice([None, *"abcde"]), rng.choice([None, *range(rng.choice([2, 30]))])) for _ in range(rng.randint(0, 80))]
        assert best_fit(pieces, capacity) == plain_best_fit(pieces, capacity)


def check(got, lengths, capacity):
    bins, parts = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.pack_group, r.bin].append(r)
        parts[r.doc_id].append((r.start, r.length))
    for members in bins.values():
        assert sum(r.length for r in members) <= capacity
        sources = [r.source for r in members if r.source is not None]
        assert len(sources) == len(set(sources))
        members.sort(key=lambda r: (r.offset, r.length))
        at = 0
        for r in members:
            assert r.offset == at
            at += r.length
    return bins, parts


def test_odd_rows(docs, rows):
    got = pack_documents(docs, capacity=512).collect()
    _, parts = check(got, None, 512)
    for i, text, *_ in rows[0]:
        if i not in (None, 5):
            at = 0
            for start, length in sorted(parts[i]):
                assert start == at
                at += length
            assert at == len((text or "").split())
    assert len(parts[5]) == 2 and len(parts[None]) == 2
    copies = [(r.pack_group, r.bin) for r in got if r.doc_id in (15, 16, 17)]
    assert len(set(copies)) == 3


def test_groups_match_best_fit_decreasing(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(0, 130), rng.choice("aab") if i % 3 else None, rng.choice(["c", f"d{i}"])) for i in range(400)]
    got = pack(spark.createDataFrame(rows, "id long, length int, source string, cluster string"), 50, 100).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.pack_group].append(r)
    assert len(groups) > 3
    for members in groups.values():
        members.sort(key=lambda r: (-r.length, r.id, r.piece))
        assert [r.bin for r in members] == plain_best_fit([(r.length, r.source, r.cluster) for r in members], 50)


def test_empty_table(no_docs):
    assert pack_documents(no_docs).collect() == []


def test_rows_without_ids_spread_over_groups(spark):
    df = spark.createDataFrame([(None, 3, "s", "c")] * 300, "id long, length int, source string, cluster string")
    got = pack(df, 10, 50).collect()
    assert len({r.pack_group for r in got}) == 6 and len({(r.pack_group, r.bin) for r in got}) == 300


def test_long_ids_beside_nulls_stay_exact(spark):
    ids = [2**60 + 1, 2**60 + 3, 2**60 + 5, None, -(2**62) - 1]
    got = pack(spark.createDataFrame([(i, 3, None, None) for i in ids], "id long, length int, source string, cluster string"), 10, 50).collect()
    assert sorted((r.id for r in got), key=str) == sorted(ids, key=str) and len({r.pack_group for r in got}) == 1
    docs = spark.createDataFrame([(i, f"text number {k}", "s") for k, i in enumerate(ids)], "doc_id long, text string, source string")
    assert sorted((r.doc_id for r in pack_documents(docs).collect()), key=str) == sorted(ids, key=str)


def test_near_duplicates_never_share_a_bin(spark):
    rng = random.Random(3)
    rows = []
    for base in range(6):
        words = prose(rng, 400).split()
        for k in range(8):
            near = list(words)
            near[50 * k] = f"x{k}"
            rows.append((len(rows), " ".join(near), f"s{len(rows)}"))
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=4096).collect()
    root = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(set(root.values())) < 40
    bins = defaultdict(list)
    for r in got:
        bins[r.pack_group, r.bin].append(root[r.doc_id])
    assert all(len(m) == len(set(m)) for m in bins.values()) and max(map(len, bins.values())) > 1
