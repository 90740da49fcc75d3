import random
import textwrap

from dendra.llm.licenses import TEMPLATES, Scanner, blocks, differences, scan_documents, words_after, words_before, words_of
from tests.llm.conftest import prose


def plain_differences(block, template):
    """Least words to delete or insert, by the full edit table over every part of the block."""
    best = len(template)
    for a in range(len(block) + 1):
        row = list(range(len(template) + 1))
        for word in block[a:]:
            new = [row[0] + 1]
            for j, t in enumerate(template, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] if word == t else 10**9))
            row = new
            best = min(best, row[-1])
    return best


def test_differences_bound_and_find_the_wording():
    rng = random.Random(0)
    for _ in range(60):
        template = [rng.choice("abcdefgh") for _ in range(8)]
        block = [rng.choice("xyz") for _ in range(4)] + list(template) + [rng.choice("xyz") for _ in range(4)]
        n, first, last = differences(block, template)
        assert (n, first, last) == (0, 4, 12)
        block[rng.randrange(4, 12)] = "q"
        n, *_ = differences(block, template)
        assert n >= plain_differences(block, template) and n <= 2 + 8


def test_each_template_wins_on_its_own_words():
    scanner, rng = Scanner(), random.Random(1)
    for name, text in TEMPLATES:
        around = f"{prose(rng, 30)}\n{text}\n{prose(rng, 30)}"
        found = [r for r in scanner.scan(around) if r[6]]
        assert [r[2] for r in found] == [name] and found[0][4] == 0, (name, found)
        a, b = found[0][:2]
        assert words_of(around[a:b]) == words_of(text)


def test_edits_and_several_notices():
    scanner = Scanner()
    mit, gpl = TEMPLATES[5][1], next(t for n, t in TEMPLATES if n == "GPL-3.0" and "program" in t)
    found = scanner.scan(mit.replace("Software", "Library") + " " + gpl.replace("program", "package"))
    assert [(r[2], r[6]) for r in found] == [("MIT", True), ("GPL-3.0", True)] and all(r[4] for r in found)
    (other,) = scanner.scan("The driver needs a license to drive.")
    assert not other[6] and scanner.scan(None) == scanner.scan("") == scanner.scan("nothing here") == []


def test_blocks():
    text = "a b. Copyright 2001 x. And y. All rights reserved. z z. q q.\nreleased under the MIT license"
    assert [text[a:b] for a, b in blocks(text)] == ["Copyright 2001 x. And y. All rights reserved.", "released under the MIT license"]


def test_odd_rows(spark, docs, no_docs):
    assert scan_documents(docs).collect() == [] and scan_documents(no_docs).collect() == []
    rows = [(None, "Released under the MIT License."), (1, "x\n" * 5000 + "Licensed under CC BY-NC 4.0."), (1, "x\n" * 5000 + "Licensed under CC BY-NC 4.0.")]
    got = scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license, r.differences) for r in got) == [("1", "CC-BY-NC-4.0", 0)] * 2 + [("None", "MIT", 0)]


def test_wrapped_notices():
    """A notice that is wrapped over lines is the same notice as on one line."""
    scanner, rng = Scanner(), random.Random(5)
    for name, text in TEMPLATES:
        for width, mark in ((76, ""), (40, "# "), (60, " * ")):
            wrapped = "\n".join(mark + line for line in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))
            around = f"{prose(rng, 30)}.\n\n{wrapped}\n\n{prose(rng, 30)}"
            found = scanner.scan(around)
            assert [(r[2], r[4], r[5], r[6]) for r in found] == [(name, 0, len(words_of(text)), True)], (name, width, found)
            a, b = found[0][:2]
            assert words_of(around[a:b]) == words_of(text)
    mit = textwrap.fill(TEMPLATES[5][1].replace(" The above", "\n\nThe above"), 76, replace_whitespace=False)
    apache = textwrap.fill(TEMPLATES[1][1], 70, break_on_hyphens=False)
    found = scanner.scan(f"{apache}\n{mit}\n\nCopyright 2001 {prose(rng, 9)}")
    assert [(r[2], r[4], r[6]) for r in found if r[6]] == [("Apache-2.0", 0, True), ("MIT", 0, True)]


def test_words_around():
    text = "aa bb " + " " * 500 + "cc dd ee"
    at = text.index("dd")
    assert text[words_before(text, 0, at, 2) : at].split() == ["bb", "cc"] and words_before(text, 0, at, 9) == 0
    assert text[: words_after(text, 0, len(text), 3)].split() == ["aa", "bb", "cc"] and words_after(text, 0, len(text), 9) == len(text)


def test_every_template_is_tried():
    """A short exact notice beside reworded ones that share more bytes with other templates."""
    scanner = Scanner()
    gnu = [t for n, t in TEMPLATES if "GPL" in n]
    reworded = " ".join(" ".join(w for k, w in enumerate(t.split()) if k % 3) for t in gnu).replace(".", ",")
    for name, short in (("MIT", "Released under the MIT License."), ("Proprietary", "All rights reserved."), ("CC-BY-4.0", "Licensed under CC BY 4.0.")):
        block = f"{reworded} {short}"
        index = next(i for i, (_, t) in enumerate(TEMPLATES) if t == short)
        assert index not in [i for _, i in scanner.rank(block)[:5]]
        i, _, n, _, _, sure = scanner.winner(block)
        assert (TEMPLATES[i][0], n, sure) == (name, 0, True)
        assert (name, 0, True) in [(r[2], r[4], r[6]) for r in scanner.scan(block)]


def test_letters_that_grow_in_lower_case():
    """The bounds hold, and further notices are found, where lower() changes the length."""
    text = "İstanbul İzmir. Released under the MIT License. İ x. Licensed under CC BY-NC 4.0. İ"
    found = Scanner().scan(text)
    assert [(r[2], r[4], r[6]) for r in found] == [("MIT", 0, True), ("CC-BY-NC-4.0", 0, True)]
    assert [words_of(text[a:b]) for a, b, *_ in found] == [words_of("Released under the MIT License"), words_of("Licensed under CC BY-NC 4.0")]


def test_long_runs_of_notices_take_time_in_proportion():
    import time

    scanner, took = Scanner(), []
    for n in (200, 800):
        text = " ".join(f"Licensed under the Apache License, Version 2.0. Released under the MIT License. Part {k} follows." for k in range(n))
        began = time.process_time()
        got = [r for r in scanner.scan(text) if r[-1]]
        took.append(time.process_time() - began)
        assert [r[2] for r in got] == ["Apache-2.0", "MIT"] * n and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert took[1] < 8 * took[0]


def test_sentences_without_an_end_take_time_in_proportion():
    import time

    rng, scanner, took = random.Random(3), Scanner(), []
    for n in (20, 160):
        text = " ".join(f"Licensed under the Apache License, Version 2.0 and {prose(rng, 60)} Released under the MIT License {prose(rng, 9)}" for k in range(n)).replace(". ", " ")
        began = time.process_time()
        got = [r for r in scanner.scan(text) if r[-1]]
        took.append(time.process_time() - began)
        assert sorted(r[2] for r in got) == sorted(["Apache-2.0", "MIT"] * n) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert took[1] < 20 * took[0]
    assert Scanner().scan("x" * 9000 + "licence" + "y" * 9000)[0][1] <= 18007


def test_scan_matches_brute_force_over_all_templates():
    """Each confirmed notice is a true one by its exact differences, and no template that stands unchanged in a text is missed."""
    rng, scanner = random.Random(17), Scanner()
    for _ in range(40):
        chosen = [rng.choice(scanner.templates) for _ in range(rng.randrange(1, 4))]
        text = " ".join(f"{prose(rng, 30)}. {t}" for _, t, _ in chosen) + f" {prose(rng, 20)}."
        if rng.random() < 0.3:
            text = "\u0130 " + text
        got = [r for r in scanner.scan(text) if r[-1]]
        for a, b, name, _, n, size, _ in got:
            words = words_of(text[a:b])
            assert n <= 0.2 * size and any(differences(words, w)[0] <= n for k, _, w in scanner.templates if k == name and len(w) == size)
        at = 0
        for name, t, _ in chosen:
            at = text.index(t, at)
            held = [r for r in got if r[0] < at + len(t) and at < r[1]]
            assert held and name in {r[2] for r in held}, (name, held)
            at += len(t)
