import random
from collections import Counter, defaultdict

from dendra.llm.decontaminate import Bm25Index, Searcher, drop_contaminated, find_leaks, question_and_answer, words_of
from tests.llm.conftest import prose


def index_of(items, block=4):
    frequencies = Counter(w for _, t in items for w in set(words_of(t)))
    return Bm25Index(items, frequencies, len(items), sum(len(words_of(t)) for _, t in items) / len(items), block=block)


def plain_retrieve(index, terms, threshold):
    scores = defaultdict(float)
    for t in set(terms):
        for i, x in zip(index.ids[t].tolist(), index.impacts[t].tolist()):
            scores[i] += x
    return sorted((i, round(s, 9)) for i, s in scores.items() if s >= threshold - 1e-9)


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.randrange(1, 30), 60)) for i in range(60)]
    index = index_of(items)
    for _ in range(300):
        words = prose(rng, 20, 60).split() + [w for w in rng.choice(items)[1].split() if rng.random() < 0.7]
        terms = [index.terms[w] for w in words if w in index.terms]
        for threshold in (0.1, 0.4, 0.7):
            assert sorted((i, round(s, 9)) for i, s in index.retrieve(terms, threshold)) == plain_retrieve(index, terms, threshold)


def test_skipped_passages_hold_nothing():
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(3, 30), 80)) for i in range(50)]
    index = index_of(items)
    searcher, hits = Searcher(index, 0.5, 0.8), 0
    for _ in range(200):
        words = prose(rng, rng.randrange(0, 150), 80).split()
        at = rng.randrange(len(words) + 1)
        words[at:at] = rng.choice(items)[1].split()
        allowed, terms = searcher.passages(words)
        for start in range(0, len(words), index.longest):
            found = plain_retrieve(index, [t for t in terms[start : start + 2 * index.longest].tolist() if t >= 0], 0.5)
            hits += bool(found)
            assert not found or start in allowed
    assert hits > 200


def test_odd_rows(docs, items):
    got = find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.overlap) for r in got] == [(11, 0, 1.0)]
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def test_question_and_answer_overlap(spark):
    rng = random.Random(6)
    question, answer = prose(rng, 30), prose(rng, 8)
    item = f"{question}. {answer}."
    assert question_and_answer(item) == (question.split(), answer.split())
    texts = [f"{prose(rng, 50)} {item} {prose(rng, 50)}", f"{prose(rng, 50)} {question}. {prose(rng, 70)}", prose(rng, 200), f"{answer} {prose(rng, 30)} {question}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(7, item), *((100 + i, prose(rng, 40)) for i in range(20))], "item_id long, text string")
    got = {r.doc_id: r for r in find_leaks(df, table).collect()}
    assert set(got) == {0, 3} and got[0].score > 0.99 and got[3].question_overlap == got[3].answer_overlap == 1.0


def test_slices_find_the_same(spark, monkeypatch, docs, items):
    import dendra.llm.decontaminate as D

    rng = random.Random(9)
    table = [(i, prose(rng, 6 + 4 * i)) for i in range(12)]
    df = spark.createDataFrame([(i, prose(rng, 40 + 30 * i) + " " + t) for i, t in table], "doc_id long, text string")
    items = spark.createDataFrame(table, "item_id long, text string")
    pairs = lambda: sorted(tuple(r) for r in find_leaks(df, items).collect())
    whole = pairs()
    monkeypatch.setattr(D, "SLICE_BYTES", 300)
    assert whole == pairs() and len(whole) == 12


def test_empty_tables(no_docs, docs, items):
    assert find_leaks(no_docs, items).collect() == []
    assert find_leaks(docs, items.limit(0)).collect() == []
    assert drop_contaminated(docs, items.where("text = ''")).count() == docs.count()


def test_ties_go_to_the_first_passage(spark):
    """An item that stands twice, among words that change the order in which its terms' shares are summed."""
    rng = random.Random(12)
    items = [(i, prose(rng, 40)) for i in range(9)]
    rows = [(i, f"{prose(rng, 7 * i)} {t} {prose(rng, 200)} {t} {prose(rng, 30)}") for i, t in items]
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 9
    for r in got:
        at = rows[r.doc_id][1].split().index(items[r.doc_id][1].split()[0])
        assert r.score == 1 and r.overlap == 1 and r.passage_start <= at and at + 40 <= r.passage_start + 80
