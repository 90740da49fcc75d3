import random
from collections import defaultdict

from dendra.llm.token_packing import END, VOCABULARY, Encoder, best_fit_decreasing, id_matrix, pack_tokens, positions


def encoder():
    with open(VOCABULARY, "rb") as f:
        return Encoder(f.read())


def plain_best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(capacity - n)
    return sorted(free)


def test_packing_matches_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        capacity = rng.choice([1, 4, 7, 8, 9, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        rows = best_fit_decreasing(lengths, capacity)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[p] for p in r) for r in rows) == plain_best_fit_decreasing(lengths, capacity)


def test_encoding_equals_the_library():
    e, rng = encoder(), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "1", ".", "!", "\x1c", " ", "'s", "日", "\x85", " ", "word"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e.encode(text).tolist() == [*e.encoding.encode_ordinary(text), END]
        assert e.decode(e.encode(text)[:-1]) == text


def test_round_trip_of_odd_rows(docs, rows):
    e, got = encoder(), pack_tokens(docs, row=64).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.tokens <= 64 and list(r.position_resets) == list(r.cu_seqlens)[:-1]
        (ids,) = id_matrix([bytes(r.input_ids)], 64)
        assert (ids[r.tokens :] == END).all()
        where = positions(r.cu_seqlens, 64)
        assert all(where[a] == 0 for a in r.position_resets) and (where[r.tokens :] == 0).all()
        for i, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[i].append((start, ids[a:b].tolist()))
    for i, text, *_ in rows[0]:
        if i not in (None, 5):
            whole = [x for _, p in sorted(pieces[i]) for x in p]
            assert whole[-1] == END and e.decode(e.encode(text)[:-1]) == (text or "") and whole == e.encode(text).tolist()
    assert sorted(s for s, _ in pieces[5]) == sorted(2 * sorted({s for s, _ in pieces[5]}))


def test_blocks_bound_what_is_held(spark, monkeypatch):
    import dendra.llm.token_packing as P

    df = spark.createDataFrame([(i, "some words here " * (i % 5)) for i in range(100)], "doc_id long, text string").coalesce(1)
    one = pack_tokens(df, row=32).collect()
    assert {r.block for r in one} == {0}
    monkeypatch.setattr(P, "BLOCK_PIECES", 10)
    pieces = list(P._blocks([__import__("pyarrow").RecordBatch.from_pandas(df.toPandas())], encoder(), 32))
    assert max(map(len, pieces)) == 10 and sum(map(len, pieces)) >= 100


def test_empty_table(no_docs):
    assert pack_tokens(no_docs).collect() == []


def test_no_end_id(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string")
    (r,) = pack_tokens(df, end=None, row=4).collect()
    assert list(r.doc_ids) == [2] and r.tokens == 1
