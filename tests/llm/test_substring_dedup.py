import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from dendra.llm import blocks as B
from dendra.llm.substring_dedup import drop_repeats, find_repeats, minhash_bands, paragraphs_of, tune_bands, without_words
from dendra.llm.words import Words, words_of_groups
from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, prose


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def plain_windows(docs, n):
    """(doc_id, word) of every window of n words that an earlier document holds too."""
    first, found = {}, []
    for i, text in sorted(docs):
        words = lower(text).split()
        for k in range(len(words) - n + 1):
            if first.setdefault(tuple(words[k : k + n]), i) < i:
                found.append((i, k))
    return found


def plain_paragraphs(docs, min_words, similarity):
    """(doc_id, word, words) of each paragraph that is linked to one of an earlier document."""
    places = defaultdict(list)
    for i, text in docs:
        at = 0
        for line in text.split("\n"):
            words = lower(line).split()
            if len(words) >= min_words:
                places[tuple(words)].append((i, at, len(words)))
            at += len(words)
    kinds = list(places)
    sets = [{k[i : i + 5] for i in range(len(k) - 4)} for k in kinds]
    parent = list(range(len(kinds)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(kinds)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, k in enumerate(kinds):
        groups[find(i)] += places[k]
    return {p for g in groups.values() for p in g if p[0] > min(q[0] for q in g)}


def covered(got):
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.word, r.word + r.words))
    return spans


def plain_blocks(docs, similarity):
    """doc_id -> words of all its blocks that are similar to a block of another document, straight from the definition."""
    sets = {i: [frozenset(w[k + j : k + j + 5] for j in range(46)) for k in range(len(w) - 49)] for i, t in docs for w in [tuple(lower(t).split())]}
    holders = defaultdict(set)
    for i, own in sets.items():
        for x in {x for s in own for x in s}:
            holders[x].add(i)
    pairs = {(i, j) for ids in holders.values() for i in ids for j in ids if i < j}
    found = defaultdict(set)
    for i, j in pairs:
        for k, x in enumerate(sets[i]):
            for m, y in enumerate(sets[j]):
                both = len(x & y)
                if both and both >= similarity * (len(x) + len(y) - both):
                    found[i] |= set(range(k, k + 50))
                    found[j] |= set(range(m, m + 50))
    return found


def check(docs, got):
    """Similar lines are covered as a whole, repeats of 50 words by half at least and together by 95 %, wholly where only two documents hold them; nothing else goes."""
    spans = covered(got)
    gone = {i: {k for a, b in s for k in range(a, b)} for i, s in spans.items()}
    holders, due = defaultdict(set), defaultdict(set)
    for i, text in docs:
        words = lower(text).split()
        for k in range(len(words) - B.BLOCK + 1):
            holders[tuple(words[k : k + B.BLOCK])].add(i)
    of = {i: lower(t).split() for i, t in docs}
    for i, k in plain_windows(docs, B.BLOCK):
        due[i] |= set(range(k, k + B.BLOCK))
        lost = len(set(range(k, k + B.BLOCK)) & gone.get(i, set()))
        assert lost >= (B.BLOCK if len(holders[tuple(of[i][k : k + B.BLOCK])]) == 2 and len(docs) < 100 else B.BLOCK / 2), (i, k, lost)
    assert sum(len(d & gone[i]) for i, d in due.items()) >= 0.95 * sum(map(len, due.values()))
    lines = plain_paragraphs(docs, 50, 0.8)
    for i, at, n in lines:
        assert any(a <= at and at + n <= b for a, b in spans[i]), (i, at)
    allowed = plain_blocks(docs, 0.8)
    for i, at, n in lines:
        allowed[i] |= set(range(at, at + n))
    for i, words in gone.items():
        assert words <= allowed[i], i


def test_words():
    w = Words.of("A bc\nÜd  e\n\nf")
    assert [w.raw[a:b].decode() for a, b in zip(w.starts, w.ends)] == ["A", "bc", "Üd", "e", "f"] and w.lines.tolist() == [0, 0, 1, 1, 3]
    a, b = Words.of("x THE same Words y"), Words.of("the SAME words")
    assert a.hashes[1:4].tolist() == b.hashes.tolist() and a.shingles(3)[1] == b.shingles(3)[0]
    assert len(Words.of(None).hashes) == len(Words.of(" \n").hashes) == len(a.shingles(9)) == 0


def test_words_in_pieces(monkeypatch):
    import dendra.llm.words as W

    text = prose(random.Random(2), 300) + "\nÜber " + "x" * 90
    whole = Words.of(text).hashes.tolist()
    for piece in (1, 10, 77):
        monkeypatch.setattr(W, "PIECE", piece)
        assert Words.of(text).hashes.tolist() == whole


def test_sliding_minimum():
    rng = np.random.default_rng(1)
    values = rng.integers(1000, size=200, dtype=np.uint64)
    for width in (1, 2, 3, 46, 64, 200):
        assert B.sliding_minimum(values, width).tolist() == [values[i : i + width].min() for i in range(201 - width)]


def test_entries_stand_for_every_block(monkeypatch):
    """Runs cover each block once, blocks of one run and equal blocks anywhere share their value, and anchors stand at equal places."""
    rng = random.Random(3)
    shared = prose(rng, B.BLOCK)
    for piece in (1 << 18, 37):
        monkeypatch.setattr(B, "PIECE", piece)
        places = defaultdict(set)
        for _ in range(30):
            before = rng.randrange(60)
            w = Words.of(f"{prose(rng, before)} {shared} {prose(rng, rng.randrange(60))}")
            bucket, anchor, run = B.block_entries(w, 1)
            starts = sorted((int(a - (r >> 6)), int(a - (r & 63))) for a, r in zip(anchor, run))
            assert [x for a, b in starts for x in range(a, b + 1)] == list(range(len(w.starts) - B.BLOCK + 1))
            for v, a, r in zip(bucket.tolist(), anchor.tolist(), run.tolist()):
                if a - (r >> 6) <= before <= a - (r & 63):
                    places[v].add(a - before)
        assert len(places) == 1 and len(*places.values()) == 1
    assert all(len(x) == 0 for x in B.block_entries(Words.of(prose(rng, 49)), 2))


def test_short_texts_are_taken_together():
    """Lines, bands and entries of many texts at once are those of each text, in far fewer steps than texts."""
    rng = random.Random(17)
    texts = ["", None, " \n", prose(rng, 49), prose(rng, 50), "Ünï " * 60, "\n" + prose(rng, 70, 9) + "\n\n", prose(rng, 70000)]
    texts += ["\n".join(prose(rng, rng.randrange(80)) for _ in range(rng.randrange(6))) for _ in range(400)]
    together, groups, numbers = [], 0, np.arange(len(texts))
    for rows, words in words_of_groups(pa.array(texts)):
        text, groups = words.text, groups + 1
        a, b = paragraphs_of(words, 50)
        of = numbers[rows][text[a]]
        together += zip(of.tolist(), (a - words.first[text[a]]).tolist(), (b - a).tolist(), minhash_bands(words, a, b, 10).tolist())
        bucket, anchor, run = B.block_entries(words, 2)
        together += zip(numbers[rows][text[anchor]].tolist(), (anchor - words.first[text[anchor]]).tolist(), run.tolist(), bucket.tolist())
    alone = []
    for i, words in enumerate(map(Words.of, texts)):
        a, b = paragraphs_of(words, 50)
        alone += zip([i] * len(a), a.tolist(), (b - a).tolist(), minhash_bands(words, a, b, 10).tolist())
        bucket, anchor, run = B.block_entries(words, 2)
        alone += zip([i] * len(anchor), anchor.tolist(), run.tolist(), bucket.tolist())
    assert len(alone) > 5000 and sorted(map(repr, together)) == sorted(map(repr, alone)) and groups < 20


def test_minima_over_pieces(monkeypatch):
    """Lines that begin, end or lie within a piece have the bands of their own words."""
    import dendra.llm.substring_dedup as S

    rng = random.Random(18)
    words = Words.of("\n".join(prose(rng, rng.randrange(40, 120)) for _ in range(30)))
    ends = paragraphs_of(words, 50)
    want = [minhash_bands(Words.of(words.raw[words.starts[a] : words.ends[b - 1]]), np.array([0]), np.array([b - a]), 10)[0].tolist() for a, b in zip(*ends)]
    for piece in (1 << 15, 64, 7):
        monkeypatch.setattr(S, "PIECE", piece)
        assert minhash_bands(words, *ends, 10).tolist() == want


def test_words_of_copies_only_are_counted(spark, monkeypatch):
    import dendra.llm.substring_dedup as S

    rng, counted = random.Random(19), spark.sparkContext.accumulator(0)

    @F.udf("int")
    def count(text):
        counted.add(1)
        return len(text.split())

    monkeypatch.setattr(S.F, "regexp_count", lambda text, _: count(text))
    docs = [(i, prose(rng, 60)) for i in range(40)]
    copies, _ = S.whole_copies(spark.createDataFrame([*docs, (40, docs[3][1]), (41, "a b"), (42, "a b")], "doc_id long, text string"), 50)
    assert [(r.doc_id, r.words, r.kept_doc_id) for r in copies.collect()] == [(40, 60, 3)] and counted.value == 2


def test_similar_places_match_sets():
    """Edits, inserted and dropped words, and texts of few words that repeat."""
    rng = random.Random(6)
    rows = []
    for k in range(300):
        a = [rng.randrange(3000 if k % 4 else 3) for _ in range(B.AROUND)]
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[9999], [], [b[at], 8888], [b[at], 1, 2, 3]])
        rows.append((a, (b + [rng.randrange(3000) for _ in range(99)])[: B.AROUND], *sorted((rng.randrange(46), rng.randrange(46)))))
    a, b = (np.array([B._shingles_of(np.array(r[k])) for r in rows]) for k in (0, 1))
    low, high = (np.array([r[k] for r in rows]) for k in (2, 3))
    for similarity in (0.8, 0.9, 1.0, 0.6):
        got, in_b, _ = B.similar_places(a, b, low, high, similarity)
        assert all((in_b[i] <= np.isin(a[i], b[i])).all() for i in range(len(rows)))
        for i in range(len(rows)):
            for at in range(46):
                x, y = set(a[i, at : at + 46].tolist()), set(b[i, at : at + 46].tolist())
                assert got[i, at] == (low[i] <= at <= high[i] and len(x & y) >= similarity * len(x | y) - 1e-9), (i, at)
        assert got.any() and not got.all(axis=1).all()


def test_no_pair_of_a_crowded_bucket_is_lost(spark, monkeypatch):
    """Similar, unequal pairs among entries that share no more than a bucket, with whole buckets and with buckets in parts."""
    rng, docs = random.Random(14), []
    for _ in range(12):
        words = prose(rng, 95, 10**6).split()
        other = [*words[:47], "edited", *words[48:]]  # in every block
        docs += [" ".join(words), " ".join(other), prose(rng, 95, 10**6)]
    rng.shuffle(docs)
    rows, of = list(enumerate(docs)), {i: d.split()[0] for i, d in enumerate(docs)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    entries = spark.createDataFrame([(7, i, 45, 45 * 64) for i, _ in rows], "bucket long, doc_id long, word int, run int")
    want = sorted((i, j) for i in of for j in of if i < j and of[i] == of[j])
    for cell_rows in (8192, 10):
        monkeypatch.setattr(B, "CELL_ROWS", cell_rows)
        links, roots = B.similar_blocks(df, entries, 0.8)
        assert len(want) == 12 and sorted({(r.u, r.v) for r in links.collect()}) == want
        assert Counter(Counter(r.root for r in roots.collect()).values()) == {2: 12}


def test_cells_match_brute_force():
    """Clusters that no drawn entry belongs to, a stretch of words that all of a cell hold, few words that repeat, and several entries of a document."""
    rng = np.random.default_rng(5)
    for trial in range(4):
        rows = []
        for cell in range(3):
            common = rng.integers(1 << 32, size=14)
            for _ in range(8):
                base = rng.integers(1 << 32 if trial % 2 else 12, size=B.AROUND)
                base[40:54] = common
                for _ in range(rng.integers(1, 6)):
                    words = base.tolist()
                    for at in rng.integers(B.AROUND, size=rng.integers(3)).tolist():
                        words[at : at + 1] = [[9], [], [words[at], 7]][rng.integers(3)] if at < len(words) else []
                    low, high = sorted(rng.integers(B.SPAN, size=2).tolist())
                    rows.append((cell, len(rows) if rng.random() < 0.9 else 1, high * 64 + low, (words + rng.integers(1 << 32, size=9).tolist())[: B.AROUND]))
        rows.sort(key=lambda r: r[:2])
        cell, doc, run = (np.array([r[k] for r in rows]) for k in range(3))
        hashes, word = np.array([r[3] for r in rows], dtype="<u4"), np.arange(len(rows))
        sets = [[set(s[k : k + B.SPAN].tolist()) for k in range(B.SPAN)] for s in map(B._shingles_of, hashes)]
        places = lambda i, j: range(B.BEFORE - min(run[i] >> 6, run[j] >> 6), B.BEFORE - max(run[i] & 63, run[j] & 63) + 1)
        for similarity in (0.8, 0.6, 0.1):
            alike = {(i, j) for i in word for j in word if cell[i] == cell[j] and doc[i] < doc[j] and any(len(sets[i][k] & sets[j][k]) >= (similarity - 1e-9) * len(sets[i][k] | sets[j][k]) for k in places(i, j))}
            made = {(u, v) for m in B.linked_in_cells(cell, doc, word, run, hashes, similarity) for u, v in zip(m[1].tolist(), m[3].tolist())}
            label = list(word)
            for i, j in made:
                label = [label[i] if x == label[j] else x for x in label]
            assert made <= alike and all(label[i] == label[j] for i, j in alike)


def test_bands_reach_the_recall():
    rng, bands = random.Random(4), tune_bands(0.8, 0.999)
    hits = total = 0
    for _ in range(200):
        a = prose(rng, 120).split()
        b = list(a)
        for _ in range(2):
            b[rng.randrange(120)] = "x"
        wa, wb = Words.of(" ".join(a)), Words.of(" ".join(b))
        sa, sb = set(wa.shingles(5).tolist()), set(wb.shingles(5).tolist())
        if len(sa & sb) >= 0.8 * len(sa | sb):
            ends = np.array([0]), np.array([120])
            total += 1
            hits += bool((minhash_bands(wa, *ends, bands) == minhash_bands(wb, *ends, bands)).any())
    assert total > 50 and hits >= 0.98 * total


def test_odd_rows(docs, rows):
    known = [(r[0], r[1]) for r in rows[0] if r[0] is not None and r[1] is not None]
    got = find_repeats(docs).collect()
    check(known, got)
    assert {r.doc_id for r in got} == {6, 7, 9} and all(r.kept_doc_ids in ([5], [8]) for r in got)
    kept = drop_repeats(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r for r in kept.collect()}
    assert 6 not in texts and texts[5].text == dict(known)[5] and texts[1].text == "" and texts[0].text is None
    assert texts[9].text.count("\n") == 2 and texts[9].n_chars == len(texts[9].text) < len(dict(known)[9])
    assert texts[10].text == dict(known)[10] and kept.count() == docs.count() - 2


def test_random_documents_match_brute_force(spark):
    """Copies, near copies of varying distance, passages inside and across paragraphs."""
    rng = random.Random(12)
    bases, passages = [prose(rng, rng.randrange(50, 90)) for _ in range(4)], [prose(rng, rng.randrange(45, 90)) for _ in range(3)]
    docs = []
    for i in range(160):
        lines = [prose(rng, rng.randrange(1, 70)) for _ in range(rng.randrange(1, 4))]
        if i % 2:
            words = rng.choice(bases).split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(["edit", "Other"])
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words))
        if i % 5 == 0:
            lines[0] += " " + rng.choice(passages) + " " + prose(rng, 5)
        docs.append((i, "\n".join(lines)))
    check(docs, find_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_cutting_words():
    assert without_words("a b c\nd e  f", [(1, 3)]) == "a e  f"
    assert without_words("a b c", [(0, 3)]) == "" and without_words("a b c", [(1, 9)]) == "a "
    assert without_words("x\nP Q\ny", [(1, 2)]) == "x\ny" and without_words("é b ü", [(0, 1), (2, 1)]) == "b "
    assert without_words("a b", [(7, 2)]) == "a b"


def test_empty_table(no_docs):
    assert find_repeats(no_docs).collect() == [] and drop_repeats(no_docs).collect() == []


def test_repeats_within_a_document_stay(spark):
    rng = random.Random(1)
    line = prose(rng, 60)
    assert find_repeats(spark.createDataFrame([(1, f"{line}\n{line}", "en", "s", 1)], SCHEMA)).collect() == []
    assert Counter(r.doc_id for r in find_repeats(spark.createDataFrame([(2, line, "", "", 1), (1, f"{line}\n{line}", "en", "s", 1)], SCHEMA)).collect()) == {2: 1}


def test_near_copies_broken_over_short_lines(spark):
    """A passage of 62 words on three lines with an edit in its middle: no line has 50 words."""
    rng = random.Random(21)
    words = prose(rng, 62).split()
    other = [*words[:31], "edited", *words[32:]]
    wrap = lambda w: "\n".join(" ".join(w[k : k + 21]) for k in range(0, len(w), 21))
    docs = [(1, f"{prose(rng, 60)}\n{wrap(words)}"), (2, f"{prose(rng, 8)}\n{prose(rng, 33)}\n\n{wrap(other)}\n{prose(rng, 20)}"), (3, "\n".join(prose(rng, 20) for _ in range(9)))]
    assert plain_windows(docs, 32) == []
    got = find_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.kinds, r.kept_doc_ids) for r in got] == [(2, "block", [1])] and got[0].word >= 41 and got[0].word + got[0].words <= 103 and got[0].words >= 50


def test_planted_passages_are_found_by_the_bands(spark):
    """Passages of 50 words and more inside lines that differ otherwise, copied as they are (all found) or with a word changed in the middle."""
    rng = random.Random(9)
    docs, want = [], {True: [], False: []}
    for k in range(60):
        words = prose(rng, rng.randrange(50, 90)).split()
        other = list(words)
        if k % 2:
            other[len(words) // 2] = "edited"
        docs.append((2 * k, f"{prose(rng, rng.randrange(40))} {' '.join(words)} {prose(rng, rng.randrange(40))}"))
        docs.append((2 * k + 1, f"{prose(rng, rng.randrange(40))} {' '.join(other)} {prose(rng, rng.randrange(40))}"))
        want[k % 2 == 0].append(2 * k + 1)
    got = find_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(docs, got)
    found = {r.doc_id for r in got}
    assert found >= set(want[True]) and len(found & set(want[False])) >= 0.85 * len(want[False])


def test_many_near_copies_of_a_passage(spark):
    """Over a hundred copies with edits of their own: all but the first lose it, whatever bucket they meet in."""
    rng = random.Random(31)
    base = prose(rng, 120).split()
    docs = []
    for i in range(130):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"edit{i}"
        docs.append((i, f"{prose(rng, 70)} {' '.join(words)} {prose(rng, 9)}"))
    got = find_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    lost = defaultdict(int)
    for r in got:
        lost[r.doc_id] += r.words
    assert min(lost.get(i, 0) for i in range(1, 130)) >= 60 and max(lost.values()) <= 130 and 0 not in lost


def test_paragraphs():
    text = Words.of("\n".join(f"w{i} " * n for i, n in enumerate([60, 20, 70, 49, 50])))
    assert list(zip(*(x.tolist() for x in paragraphs_of(text, 50)))) == [(0, 60), (80, 150), (199, 249)]
    assert [x.tolist() for x in paragraphs_of(Words.of("a\n" * 49), 50)] == [[], []]
