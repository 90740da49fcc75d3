"""Sources, sinks, parsers, prompts, model stages and whole runs, with rule-based stand-ins for models."""

import json

import pytest
from pyspark.sql import functions as F

from dendra.functions import parsers, prompts
from dendra.operators import context, models
from dendra.plans import pipelines
from dendra.schemas import dataset_of
from dendra.sources import readers, sinks
from dendra.streaming.incremental import process_new


def test_mediawiki_dump(spark, tmp_path):
    page = lambda t, *r: f"<page><title>{t}</title>{''.join(f'<revision><id>1</id><text>{x}</text></revision>' for x in r)}</page>"
    (tmp_path / "a.xml").write_text(f'<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">{page("One", "old", "new")}{page("Two", "x")}<page><title>None</title></page></mediawiki>')
    got = {r.title: r.text for r in readers.mediawiki_pages(spark, str(tmp_path)).collect()}
    assert got == {"One": "new", "Two": "x"}


def test_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int", skip_malformed=True).collect()] == [1, 2]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()
    (tmp_path / "d.json").write_text('{"data": [{"id": "x", "n": [1]}, {"id": "y", "n": []}]}')
    assert [(r.id, r.n) for r in readers.json_document(spark, str(tmp_path / "d.json"), "id string, n array<int>", inside="data").collect()] == [("x", [1]), ("y", [])]
    (tmp_path / "p.tsv").write_text('id\ttext\ttitle\n1\ta "b"\tT\n')
    assert readers.passages(spark, str(tmp_path / "p.tsv")).first().document == 'T\na "b"'
    (tmp_path / "s.yaml").write_text("shot: 2\nndoc: 5\n")
    assert readers.settings(str(tmp_path / "s.yaml"), {"ndoc": 3, "x": None}, {"x": 1}) == {"shot": 2, "ndoc": 3, "x": 1}
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.csv")
    docs = spark.createDataFrame([("é", 1)], "title string, v int")
    assert readers.by_titles(docs, spark.createDataFrame([("é",)], "title string"), ["title", "v"]).first().v == 1
    with pytest.raises(LookupError):
        readers.by_titles(docs, spark.createDataFrame([("zz",)], "title string"), ["title"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q", ["g"], "o")], "id int, question string, golden_answers array<string>, output string")
    for dataset, inside in (("generic", lambda d: d), ("asqa", lambda d: d["data"])):
        sinks.write_results(rows, str(tmp_path / dataset), dataset)
        (text,) = [p.read_text() for p in (tmp_path / dataset).glob("part-*")]
        assert inside(json.loads(text))[0]["question"] == "q"
    assert sinks.remaining_by_key(rows, spark.createDataFrame([("1",)], "id string"), "id").count() == 0
    answers = spark.sql("SELECT 'a' AS q_id, 'q' AS question, named_struct('text', array('x', 'y', 'z'), 'score', array(1, 5, 5)) AS answers, 'o' AS output, array('c') AS claims")
    assert sinks.final_answers(answers, "eli5").first().answer == "y"
    with pytest.raises(ValueError):
        sinks.short_form_items(rows)
    assert dataset_of("/x/ASQA_dev.json") == "asqa" and dataset_of("other") == "generic"


def test_parsers(spark):
    said = "[heading] 1: early\n[title] 0: =T: x=\n[heading] 4: ==A==\n[heading] b: no\nnoise\n[title] =U=\n [heading] =7=: y"
    df = spark.createDataFrame([(said,), ("No Relevant Headings",), (None,)], "o string")
    assert [[tuple(x) for x in r[0]] for r in df.select(parsers.heading_choices(F.col("o"))).collect()] == [[("T: x", 4), ("U", 7)], [], []]
    lines = spark.createDataFrame([("0: =T=\n    1: intro\n    2: ==A==\n        3: ===B===\n    5: ==C==\nx: y",)], "o string").select(parsers.outline_headings("o")).first()[0]
    assert [(x.id, x.up_id, x.is_intro) for x in lines] == [(0, None, False), (1, None, True), (2, 0, False), (3, 2, False), (5, 0, False)]


def test_prompts(spark):
    row = spark.range(1).select(prompts.reader_prompt(F.lit(""), F.lit("why")).alias("a"), prompts.reader_prompt(F.lit("ctx"), F.lit("why"), "qampari").alias("b")).first()
    assert "## Paragraph" not in row.a and "## Paragraph\nctx" in row.b and row.b.endswith("## Response\n")
    pack = prompts.PromptPack("Do.", "{INST} {Q}\n{D}\nA: {A}", "[{ID}] {T}|{P}\n", demos=[{"question": "dq", "answer": ["x", "y"], "docs": [{"title": "t", "text": "p"}]}])
    got = spark.range(1).select(pack.few_shot(F.lit("q"), F.array(F.lit("D\n")), 1).alias("p"), pack.shown(F.lit("q"), None).alias("bare")).first()
    assert got.p == "Do. dq\n[1] t|p\n\nA: x\ny\n\n\nDo. q\nD\n\nA:" and got.bare == "Do. q\nA:"


class Failing:
    def generate(self, prompts, max_tokens):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]


class Scripted:
    def step(self, question, shown, said):
        return ["search beta", "output found it", "end"][len(said) + bool(shown) if shown else 0]


def test_model_stages_keep_failing_rows(spark):
    df = spark.createDataFrame([("ok",), ("bad",)], "p string")
    got = {r.p: (r.o, r.o_error) for r in models.generated(df, "p", "o", Failing).collect()}
    assert got == {"ok": ("OK", None), "bad": (None, "RuntimeError: no")}
    docs = "array(named_struct('title', 't', 'text', 'alpha'), named_struct('title', 'u', 'text', 'beta'))"
    talk = models.converse(spark.sql(f"SELECT 1L AS id, 'q' AS question, {docs} AS docs"), Scripted, "id long, output string, shown array<int>").first()
    assert (talk.output, talk.shown) == ("found it", [2])
    cited = models.cite_best(spark.createDataFrame([(1, 0, "beta gamma"), (1, 1, "alpha [1]")], "id int, at int, sentence string"), spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta")], "id int, doc int, text string"))
    assert {r.at: r.sentence for r in cited.collect()} == {0: "[2] beta gamma", 1: "alpha [1]"}


def test_from_pages_to_answers(spark, tmp_path):
    pages = [("Root", "Rivers and lakes. See [[Lake]].\n==Nature==\nWater flows through mountains.\n==See also==\n* [[Mountain]]"),
             ("Lake", "A lake is still water.\n==Depth==\nThe deepest lake lies in mountains."), ("Mountain", "A mountain is high.\n==Height==\nSnow covers mountains."), ("List of lakes", "x")]
    docs, vertices, edges = pipelines.document_graph(spark.createDataFrame(pages, "title string, text string"), models.HashEmbedder)
    assert {(r.src, r.dst) for r in edges.collect()} == {("Root", "Lake"), ("Lake", "Root"), ("Root", "Mountain"), ("Mountain", "Root")}
    questions = spark.createDataFrame([("1", "At which depth does the deepest lake lie in mountains?", [("Root", "")])], "qid string, question string, pre_retrieved_passages array<struct<title:string,text:string>>")

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    (row,) = pipelines.answer(questions, docs, vertices, edges, models.HashEmbedder, models.EchoGenerator, keep, threshold=-1.0).collect()
    assert "The deepest lake lies in mountains." in row.context and "0: =Lake=" in row.context and row.output


def test_incremental_run(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    run = lambda: process_new(spark, source, "a int", lambda d: d.selectExpr("a * 2 AS b"), sink, check).awaitTermination()
    (tmp_path / "in" / "1.json").write_text('{"a": 1}\n')
    run()
    (tmp_path / "in" / "2.json").write_text('{"a": 2}\n')
    run()
    run()
    assert sorted(r.b for r in spark.read.parquet(sink).collect()) == [2, 4]


def test_title_index_takes_the_first(spark, tmp_path):
    for name, titles in (("a.jsonl", ["x", "y"]), ("b.jsonl", ["y", "z"])):
        (tmp_path / name).write_text("".join(json.dumps({"title": t, "from": name}) + "\n" for t in titles))
    rows = readers.title_index(spark.read.schema("title string, from string").json(str(tmp_path))).collect()
    assert {r.title: r.file.rsplit("/", 1)[-1] for r in rows} == {"x": "a.jsonl", "y": "a.jsonl", "z": "b.jsonl"}


def test_reports_and_trial_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, i / 2) for i in range(4)], "id int, score double")
    sinks.score_report(rows.agg(F.avg("score").alias("score")), str(tmp_path / "score"))
    sinks.item_report(rows, str(tmp_path / "items"))
    assert spark.read.json(str(tmp_path / "score")).first().score == 0.75
    assert spark.read.option("header", True).csv(str(tmp_path / "items")).count() == 4
    assert sinks.some_rows(rows, 2).count() == sinks.some_rows(rows, 2, seed=42).count() == 2
    sinks.append(rows, str(tmp_path / "p"))
    sinks.append(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 8
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    cost = sinks.token_cost(spark.createDataFrame([(1000, 500)], "prompt_tokens int, completion_tokens int"), "gpt-4").first()
    assert cost.usd == pytest.approx(0.06)


def test_context_keeps_columns_of_any_name(spark):
    names = ("number", "NUMBER_", "place", "later", "size", "left", "known_key", "before", "total", "o0", "key", "weight", "_weight")
    rows = spark.createDataFrame([("q", i, 10 - i, f"word{i} " * 4, "t%d" % (i % 2)) for i in range(5)] + [(None, 7, None, None, None), (None, 7, None, None, None)], "qid string, at long, total_score long, text string, title string")
    for n in names:
        rows = rows.selectExpr("*", f"'kept' AS `{n}`")
    known = spark.createDataFrame([("q", "t1")], "qid string, title string")
    for made in (context.interleaved(rows), context.score_order(rows), context.matched_first(rows, known)):
        assert set(made.columns) == set(rows.columns) and made.count() == 7
        got = made.collect()
        assert all(r[n] == "kept" for r in got for n in names if n != "place")
        assert sorted(r.place for r in got if r.qid) == [1, 2, 3, 4, 5] and sorted(r.place for r in got if not r.qid) == [1, 2]
    cut = context.within_budget(rows, 10, order="at")
    assert cut.columns == rows.columns
    assert sorted((r.at, r.text) for r in cut.where("qid = 'q'").collect()) == [(0, "word0 " * 4), (1, "word1 " * 4), (2, "word2 word2")]
    assert cut.where("qid is null").count() == 2


def test_malformed_lines_are_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": "no", "t": "y"}\nbroken\n{"id": 2}\n')
    (tmp_path / "in/b.jsonl").write_text('{"id": 3, "t": null}\n')
    rows, counts = readers.json_lines_counted(spark, str(tmp_path / "in"), "id long, t string")
    assert sorted((r.id, r.t) for r in rows.collect()) == [(1, "x"), (2, None), (3, None)]
    assert {r.file.rsplit("/", 1)[1]: (r.n, r.malformed) for r in counts.collect()} == {"a.jsonl": (4, 2), "b.jsonl": (1, 0)}
    query = process_new(spark, str(tmp_path / "in"), "id long, t string", lambda df: df, str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=1)
    query.awaitTermination()
    seen = [p.observedMetrics["read"] for p in query.recentProgress if "read" in p.observedMetrics]
    assert sum(r.rows for r in seen) == 5 and sum(r.malformed for r in seen) == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_draws_are_the_same_for_any_layout(spark):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("g"))
    drawn = lambda df, **k: sorted(map(tuple, sinks.seeded_draw(df, 5, 1, ["id"], **k).collect()))
    assert drawn(rows, group="g") == drawn(rows.repartition(7), group="g") and len(drawn(rows, group="g")) == 15
    assert len(drawn(rows)) == 5 and drawn(rows) != sorted(map(tuple, sinks.seeded_draw(rows, 5, 2, ["id"]).collect()))
    pack = prompts.PromptPack("", "{Q}={A}", "", ";", [{"question": str(i), "answer": str(i)} for i in range(5)])
    got = [r[0] for r in rows.select(pack.few_shot(F.lit("q"), None, 3, key=F.col("id"), seed=4)).collect()]
    assert all(len(set(t.split(";"))) == 4 and t.endswith(";q=") for t in got) and len(set(got)) > 30


def test_budget_in_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    rows = [("q", i, f"T{i}", float(-i), "Some words, naïve ones: " * (3 * i + 1)) for i in range(4)] + [("r", 0, "x", 0.0, None), ("r", 1, "x", 0.0, "")]
    items = spark.createDataFrame(rows, "qid string, at int, title string, total_score double, text string")
    asked = spark.createDataFrame([("q",), ("r",), ("s",)], "qid string")
    make = lambda: models.BytePairTokenizer(path)
    model, left, want = make(), 60, []
    for r in rows[:4]:
        tokens = model.encode([r[4]])[0]
        want.append(r[4] if len(tokens) <= left else model.decode(tokens[:left]))
        left -= len(tokens)
        if left < 0:
            break
    got = {r.qid: r.context for r in context.reader_contexts(asked, items, "tree", 60, make).collect()}
    assert got == {"q": "\n\n".join(want), "r": "", "s": ""} and len(want) == 3
    assert {r.context for r in context.reader_contexts(asked, items, "none").collect()} == {""}
    with pytest.raises(ValueError):
        context.reader_contexts(asked, items, "all")
