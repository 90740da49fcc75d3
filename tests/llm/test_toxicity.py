import random
import zlib

import numpy as np
import pytest
from dendra.llm import toxicity as T
from tests.llm.conftest import SCHEMA, prose


def plain_ngrams(text):
    raw = b" " + (text or "").encode().lower() + b" "
    for c in b"\t\n\x0b\x0c\r":
        raw = raw.replace(bytes([c]), b" ")
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    out = []
    for n in T.ORDERS:
        for i in range(len(raw) - n + 1):
            h = 0
            for c in raw[i : i + n]:
                h = (h * int(T._BASE) + c + 1) % 2**64
            out.append((h * int(T._MIX)) % 2**64 >> 64 - T.BUCKET_BITS)
    return out


def test_ngram_buckets():
    for text in (None, "", "a", "Idiot", " a  b\n\tc ", "Ünï code"):
        assert T.ngram_buckets(text).tolist() == plain_ngrams(text)


def test_long_texts_in_pieces(monkeypatch):
    text = prose(random.Random(1), 500)
    whole = T.ngram_buckets(text)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(T, "PIECE", piece)
        assert T.ngram_buckets(text).tolist() == np.unique(whole).tolist()


def test_counts_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, prose(rng, 20)) for i in range(30)]
    counts, documents = T.count_presence(spark.createDataFrame(rows, "id long, label int, text string").repartition(5))
    want = np.zeros((2, T.BUCKETS), dtype=int)
    for _, label, text in rows:
        want[label, sorted(set(plain_ngrams(text)))] += 1
    assert (counts == want).all() and documents.tolist() == [15, 15]


def test_logistic_fit_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(400)]
    labels = np.array([float(0 in r) if rng.random() < 0.9 else 1.0 - (0 in r) for r in rows])
    ratios = np.array([1.5, 0.2, -0.3, 0.1, 0.4, -0.2])
    weights, bias = T.fit_logistic(rows, labels, ratios, steps=2000)
    dense = np.zeros((400, 6))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    error = 1 / (1 + np.exp(-(dense @ weights + bias))) - labels
    slope = (dense * ratios).T @ error / 400 + 3e-4 * weights / ratios
    assert np.abs(slope).max() < 1e-3 and abs(error.mean()) < 1e-3


def test_held_out_accuracy_and_odd_rows(docs, labels, rows):
    marked, texts = labels
    everything = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(texts)
    got = T.score_documents(everything, marked).collect()
    assert len(got) == len(rows[0]) + 160 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    truth = {r.doc_id: r.toxic for r in marked.where("doc_id >= 1000").collect()}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by_id[i].held_out for i in out) and len(out) > 15
    assert all(by_id[i].predicted == truth[i] for i in out)
    assert by_id[12].predicted == 1 and by_id[0].predicted == 0 and by_id[0].score == by_id[1].score


def test_more_features_than_two_bytes_count(labels):
    marked, texts = labels
    truth = {r.doc_id: r.toxic for r in marked.where("doc_id >= 1000").collect()}
    got = {r.doc_id: r.predicted for r in T.score_documents(texts, marked, features=200_000).collect()}
    assert all(got[i] == truth[i] for i in truth if zlib.crc32(str(i).encode()) % 5 == 0)
    for features in (0, T.BUCKETS + 1):
        with pytest.raises(ValueError):
            T.score_documents(texts, marked, features=features)


def test_inputs_of_a_score_are_texts_alone(docs, labels):
    """Labels of the held-out fold, and all columns but the text, change no score."""
    marked, texts = labels
    other = marked.withColumn("toxic", marked.toxic)
    flipped = marked.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a = T.score_documents(texts, other).collect()
    b = T.score_documents(texts.selectExpr("doc_id", "text", "'z' AS lang", "'z' AS source", "0L AS n_chars"), flipped).collect()
    assert sorted(a) == sorted(b)


def test_filter_keeps_columns(docs, labels):
    marked, texts = labels
    kept = T.drop_toxic(docs, marked.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.where("text is not null or text is null").count()


def test_empty_tables(spark, no_docs, labels):
    assert T.score_documents(no_docs, labels[0]).collect() == []
    one = spark.createDataFrame([(1, "some text", "en", "s", 9)], SCHEMA)
    (r,) = T.score_documents(one, labels[0].limit(0)).collect()
    assert abs(r.score - 1 / 3) < 1e-9
