import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from dendra.llm import spelling
from dendra.llm.spelling import near_words, spelling_forms, vocabulary


def plain_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    near, form = defaultdict(list), {}
    for a in words:
        near[a] = [b for b in words if is_near(a, b)]
    for a, n in words.items():
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for a, n in words.items():
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, form[a], root, n, len(near[a]), words.get(form[a])))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS key", "3 AS h")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_texts_match_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(40)] + ["Naïveté", "ÿÿÿÿÿ", "straße", "a×b÷c"]
    rows = [(None, "aaaaa aaaab aaaaaa"), (1, None), (2, ""), (3, "1 2 - "), (3, "bbbbb.bbbbb,BBBBB"), (3, "bbbbb.bbbbb,BBBBB"), (4, "q" * 30000 + " " + "q" * 29999 + "z"), (5, "q" * 30000 + " " + "q" * 29999 + "z"), (6, "q" * 30000 + " " + "q" * 29999 + "z")]
    for i in range(400):
        words = [rng.choice(base) for _ in range(60)]
        for k in range(0, 60, 7):
            at = rng.randrange(len(words[k]))
            words[k] = words[k][:at] + rng.choice(["", "a", "b", "é"]) + words[k][at + rng.randrange(2) :]
        rows.append((10 + i, " ".join(words)))
    chain = {"kkkkk": 90, "kkkkl": 40, "kkkml": 16, "kknml": 7, "konml": 3}
    rows += [(1000 + i, " ".join(w for w, n in chain.items() if i < n)) for i in range(100)]
    words = plain_words(rows)
    assert len(words) > 200
    assert {r.word: r.n for r in vocabulary(table(spark, rows)).collect()} == words
    want = plain_forms(words)
    assert any(w[1] not in (None, w[2]) for w in want)
    assert got(spelling_forms(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n")) == want


@pytest.mark.parametrize("trie_words", [1, 7, 10**6])
def test_crowded_tries_are_dealt_again_without_losing_a_pair(spark, trie_words, monkeypatch):
    rng = random.Random(trie_words)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))): rng.randrange(3, 9) for _ in range(150)}
    words |= {"".join(rng.choice("aab") for _ in range(rng.randrange(5, 12))): rng.randrange(3, 9) for _ in range(300)}
    monkeypatch.setattr(spelling, "ROWS", 50)
    found = near_words(spark.createDataFrame(list(words.items()), "word string, n long"), trie_words).collect()
    near = {a: [b for b in words if is_near(a, b)] for a in words}
    assert {r.word: r.n_near for r in found} == {a: len(x) for a, x in near.items()}
    best = {a: min(((-words[b], b) for b in x), default=None) for a, x in near.items()}
    assert {r.word: r.best and tuple(r.best) for r in found} == best


def test_odd_rows_and_empty_table(spark, docs, no_docs):
    assert spelling_forms(no_docs).collect() == []
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(spelling_forms(docs)) == plain_forms(plain_words(rows))
