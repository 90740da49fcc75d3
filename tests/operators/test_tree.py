import pyarrow as pa
from pyspark.sql import functions as F

from dendra.functions.markup import clean_markup, strip_edge_templates
from dendra.operators import links, tree
from dendra.operators.pages import is_article


def shape(text, prune=False, lists=True):
    nodes, full = tree.finish(tree.parse_nodes("T", text, lists), prune)
    return [(n["id"], n["text"], n["up_id"]) for n in nodes], full, nodes


def test_level_jumps_and_paragraph_parents():
    got, _, _ = shape("intro\n==A==\na\n====B====\nb\n===C===\nc\n==D==")
    assert got == [(0, "T", None), (1, "intro", 0), (2, "==A==", 0), (3, "a", 2), (4, "====B====", 2), (5, "b", 4), (6, "===C===", 2), (7, "c", 6), (8, "==D==", 0)]


def test_skipped_sections_and_their_subsections():
    got, _, _ = shape("==See also==\nx\n===Deep===\ny\n==Next==\nz")
    assert got == [(0, "T", None), (1, "==Next==", 0), (2, "z", 1)]


def test_lists_runs_and_empty_items():
    got, _, _ = shape("para\n* one\n** two\n*\n[[File:x.jpg]]\n* three\ntext\n* four")
    assert got == [(0, "T", None), (1, "para", 0), (2, "* one", 1), (3, "** two", 2), (4, "* three", 1), (5, "text", 0), (6, "* four", 5)]
    assert shape("* one", lists=False)[0] == [(0, "T", None), (1, "* one", 0)]


def test_heading_forms():
    got, _, _ = shape("== A == tail\n ==B==\n==C=")
    assert got == [(0, "T", None), (1, "==A==", 0), (2, "==B==", 1), (3, "==C=", 1)]


def test_prune_closes_up_ids_and_spans_point_into_the_text():
    got, full, nodes = shape("==Empty==\n===Also===\n==Full==\nx\n===None===\n==Last==\n* y", prune=True)
    assert got == [(0, "T", None), (1, "==Full==", 0), (2, "x", 1), (3, "==Last==", 0), (4, "* y", 3)]
    assert full == "T\nx\n* y"
    for n in nodes:
        if n["type"] == "content":
            assert full[n["span_start"] : n["span_end"]] == n["text"]
        assert all(nodes[c]["up_id"] == n["id"] for c in n["down_ids"]) and n["subtree_end"] >= n["id"]
    assert shape("==Only==", prune=True)[0] == [(0, "T", None)]


def test_lighting_and_rendering(spark):
    pages = spark.createDataFrame([("T", "intro\n==A==\na\n===B===\nb\n==C==\nc")], "title string, text string")
    docs = tree.trees(pages)
    ids = lambda *h, **k: docs.select(tree.lit_by_headings(F.col("nodes"), F.array(*map(F.lit, h)), **k)).first()[0]
    assert ids(0) == [0, 1] and ids(4) == [0, 1, 2, 3, 4, 5] and ids(4, with_siblings=False) == [0, 1, 2, 4, 5]
    assert ids(2, with_intro=False, with_siblings=False) == [0, 2, 3, 4, 5] and ids(99, with_intro=False) == [0]
    shown = docs.select(tree.rendered(F.col("nodes"), tree.lit_by_paragraphs(F.col("nodes"), F.array(F.lit(5), F.lit(2), F.lit(77))))).first()[0]
    assert shown == "0: =T=\n    2: ==A==\n        4: ===B===\n            5: b"
    outline = docs.select(tree.outline(F.col("title"), tree.intro_of(F.col("nodes")), tree.headings_of(F.col("nodes")))).first()[0]
    assert outline == "0: =T=\n    1: intro\n    2: ==A==\n        4: ===B===\n    6: ==C=="
    assert docs.select(tree.plain_tree(F.col("nodes"))).first()[0] == "0: =T=\n    1: intro\n    2: a\n    3: b\n    4: c"


def test_innermost_headings(spark):
    lines = [("d", 0, None, False), ("d", 1, None, True), ("d", 2, 0, False), ("d", 3, 2, False), ("d", 5, 0, False)]
    headings = spark.createDataFrame(lines, "doc string, id int, up_id int, is_intro boolean")
    pick = lambda *ids: tree.innermost_headings(spark.createDataFrame([("d", i) for i in ids], "doc string, id int"), headings).first()
    assert pick(2, 3, 5).headings == [3, 5] and pick(1, 2).headings == [0, 2] and pick(0, 2).headings == [0, 2] and pick(42) is None


def test_templates():
    assert strip_edge_templates("{{a{{b}}}}\nx {{in}} y\n{{c}}") == "\nx {{in}} y\n"
    assert strip_edge_templates("{{a {b }}") == "{{a {b }}"


def test_cleaning(spark):
    cases = {
        "[[a|b]] [[c]]": "b c", "x{{cite web|u}}y": "xy", "a<ref>r</ref>b<br/>c&nbsp;d": "abcd", "[http://x.y label one] [https://z]": "label one",
        "{| t\n|}\ntext\n| row": "text", "[[File:a.jpg|x]]\n[[Category:Q]]ü\n\n\nz": "ü\nz", "<!-- n -->k": "k",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", clean_markup(F.col("t")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == list(cases.values())
    kept = spark.createDataFrame([("[[a|b]]",)], "t string").select(clean_markup(F.col("t"), keep_links=True)).first()[0]
    assert kept == "[[a|b]]"


def test_page_filter(spark):
    cases = [("Good", "text", True), ("List of x", "t", False), ("A List of x", "t", True), ("X (disambiguation)", "t", False), ("My category: x", "t", False),
             ("R", "#REDIRECT [[y]]", False), ("R", "#ReDirect", True), ("ROH World Television Championship", "t", False), ("N", None, False)]
    df = spark.createDataFrame(cases, "title string, text string, want boolean")
    assert df.where(is_article(F.col("title"), F.col("text")) != F.col("want")).count() == 0


def test_links(spark):
    text = "Intro [[Alpha|beta]] and [[Gamma]].\n==Body==\n[[Other]]\n==See also==\n* [[X|Delta]] and [[GAMMA]]\nno [[Alpha]]\n===Sub===\n* [[Lost]]\n==External links==\n{{Alpha|state=open}}\n{{Authority control}}\n{{Delta}}"
    titles = ["Alpha", "Beta", "Gamma", "Delta", "Other", "Lost", "Page", "alpha"]
    pages = spark.createDataFrame([(t, text if t == "Page" else "x") for t in titles], "title string, text string")
    got = {r.title: r for r in links.page_links(pages).collect()}
    page = got["Page"]
    assert page.see_also == ["Delta", "GAMMA"] and page.external == ["Alpha", "Delta"] and page.intro == ["beta", "Gamma"]
    assert page.see_also_docs == ["Delta", "Gamma"] and page.external_docs == ["alpha", "Delta"] and page.intro_docs == ["Beta", "Gamma"]
    assert got["Other"].intro_docs == []


def test_links_of_repeated_titles_and_spellings(spark):
    pages = spark.createDataFrame([("A", "[[B]]", 1), ("A", "[[x|a]] [[b]] [[B]]", 2), ("B", None, 3), ("b", "==See also==\n* [[B]], [[{x}]], [[ ]]\n== External links and see also ==\n* [[A]]\n{{A}}", 0)], "title string, text string, n int")
    got = [tuple(r) for r in links.page_links(pages, "n").orderBy("title", "intro").collect()]
    assert got == [
        ("A", [], [], ["B"], [], [], ["B"]),
        ("A", [], [], ["a", "b", "B"], [], [], ["A", "B"]),
        ("B", [], [], [], [], [], []),
        ("b", ["B"], ["A"], [], ["B"], ["A"], []),
    ]
    assert {r.title: r.intro_docs for r in links.page_links(pages.where("title <> 'A' or n = 1").coalesce(1)).collect()}["A"] == ["b"]  # the last in the source
    assert links.page_links(pages.limit(0)).collect() == []


def test_html_links(spark):
    html = '<A HREF="/x#a">1</A><a class=y href=\'/x\'>2</a><a href="#top"><a href="mailto:a@b"><a href="HTTPS://z/"><a href=" y.html "><a href="//h/p"><b href="/no">'
    got = spark.createDataFrame([("http://host:1/dir/page", html), ("rel", '<a href="/x">'), ("http://a/", None)], "u string, h string").select(links.html_links(F.col("u"), F.col("h"))).collect()
    assert [r[0] for r in got] == [["http://host:1/x", "HTTPS://z/", "y.html", "//h/p"], ["/x"], None]


def test_long_tables_are_cleaned(spark):
    """A table of 200,000 characters; the pattern that stood here before overflowed the stack of the task at 3,000."""
    long = "a\n{| class=x\n| " + "word {w} | " * 20_000 + "\n|}\nb {| c |"
    got = spark.createDataFrame([(long,)], "t string").select(clean_markup(F.col("t"))).first()[0]
    assert got == "a\nb {| c |"


def test_trees_hold_few_documents_at_once(spark):
    """At most SLICE documents are Python objects at once and 4 MB are sent at once, however many rows a batch has; before, up to 10,000 documents of any size were."""
    assert [len(n) for n, _ in tree._slices(pa.array([[1]] * 1000), pa.array([[2]] * 1000))] == [tree.SLICE] * (1000 // tree.SLICE) + [1000 % tree.SLICE]
    docs = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("t"), F.col("id")).alias("title"), F.concat(F.lit("intro\n== h ==\nbody "), F.col("id")).alias("text"))
    made = tree.trees(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
    shown = made.select("title", tree.rendered(F.col("nodes"), tree.lit_by_headings(F.col("nodes"), F.array(F.lit(2)))).alias("s"))
    assert {(r.title, r.s) for r in shown.collect()} == {(f"t{i}", f"0: =t{i}=\n    1: intro\n    2: ==h==\n        3: body {i}") for i in range(1000)}
