import pytest
from pyspark.sql import functions as F

from dendra.operators import context, metrics, models, retrieval
from dendra.operators.shared import running


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("said, golds, want", [("The Cat.", ["cat"], (True, True)), ("a big cat", ["cat"], (False, True)), ("x", ["the"], (False, False)), ("Yes", ["yes", "no"], (True, True)), ("", ["x"], (False, False))])
def test_exact_and_contained(spark, said, golds, want):
    got = one(spark, F.struct(metrics.exact_match(F.col("o"), F.col("g")), metrics.containment(F.col("o"), F.col("g"))), o=said, g=golds)
    assert tuple(got) == want


@pytest.mark.parametrize("said, golds, want", [("b b c", ["b b d"], (2 / 3, 2 / 3, 2 / 3)), ("yes sir", ["yes"], (0, 0, 0)), ("b", ["b c", "b"], (1, 1, 1)), ("b c d", ["b", "b c e f"], (2 / 3, 1, 4 / 7)), ("", ["b"], (0, 0, 0))])
def test_token_scores(spark, said, golds, want):
    got = one(spark, metrics.token_scores(F.col("o"), F.col("g")), o=said, g=golds)
    assert tuple(got) == pytest.approx(want)


def test_list_scores(spark):
    item = spark.sql("SELECT 'b, C, x.' AS o, array(array('b'), array('c', 'sea'), array('d'), array('e'), array('f'), array('g')) AS g")
    got = item.select(metrics.list_scores(F.col("o"), F.col("g"))).first()[0]
    assert got.num_preds == 3 and tuple(got)[1:] == pytest.approx((2 / 3, 2 / 6, 2 / 5, 4 / 9, 0.5))


def test_summary_overlap():
    assert metrics.lcs_length("a b c d".split(), "b x d".split()) == 2
    assert metrics.summary_overlap("the cat sat", "the cat sat") == 1.0 and metrics.summary_overlap("a b", "c") == 0.0
    assert metrics.summary_overlap("a b\nc d", "c d\na b") == 1.0 and metrics.summary_overlap("", "a") == 0.0


def test_citations(spark):
    docs = ["alpha beta", "gamma", "beta"]
    item = [("i", docs, [("alpha beta", [0]), ("alpha gamma", [0, 1]), ("beta", [0, 2]), ("alpha", []), ("alpha", [7]), ("alpha", [-1])])]
    df = spark.createDataFrame(item, "id string, docs array<string>, sentences array<struct<sentence:string,refs:array<int>>>")
    got = metrics.citation_scores(df, models.entailment(models.OverlapEntailment, 0.99)).first()
    assert got.citation_recall == pytest.approx(3 / 6) and got.citation_precision == pytest.approx(1.0)


def test_claims_and_best_output(spark):
    df = spark.createDataFrame([("i", "a b c", ["a b", "z"]), ("j", "x", [])], "id string, output string, claims array<string>")
    got = {r.id: r.claim_recall for r in metrics.claim_recall(df, models.entailment(models.OverlapEntailment)).collect()}
    assert got == {"i": 0.5, "j": 0.0}
    outs = spark.createDataFrame([("i", 0, "a", 0.5), ("i", 1, "b", 0.5), ("j", 0, "c", 0.0)], "id string, at int, output string, score double")
    assert {r.id: r.output for r in metrics.best_output(outs).collect()} == {"i": "a", "j": ""}


def test_context(spark):
    rows = spark.createDataFrame([("q", i, float(-i), f"w{i} x") for i in range(5)], "qid string, at int, total_score double, text string")
    got = context.interleaved(rows).orderBy("place").collect()
    assert [r.at for r in got] == [0, 2, 4, 3, 1]
    items = context.within_budget(context.score_order(rows), 5)
    assert [r.text for r in items.orderBy("place").collect()] == ["w0 x", "w1 x", "w2"]
    assert context.assembled(items).first().context == "w0 x\n\nw1 x\n\nw2"
    docs = "array(named_struct('s', 'fine', 'n', 1), named_struct('s', 'Irrelevant', 'n', 2), named_struct('s', 'good', 'n', 3), named_struct('s', cast(null as string), 'n', 4), named_struct('s', 'late', 'n', 5))"
    assert [d.n for d in spark.sql(f"SELECT {docs} AS d").select(context.shortened(F.col("d"), "s", 5)).first()[0]] == [1, 3]


def test_dense_top_in_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>").repartition(3)
    asked = rows.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    key = lambda: sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.dense_top(rows, asked, k=4).collect())
    whole = key()
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 1)
    assert key() == whole and len(whole) == 12
    assert retrieval.dense_top(rows, asked.limit(0)).collect() == []


def test_qa_rerank_and_forced_citations(spark):
    from dendra.functions.text import force_citations

    row = spark.sql("SELECT array(named_struct('short_answers', array('The Cat', 'dog house')), named_struct('short_answers', array('x'))) AS p, array('house dog red', 'x') AS s")
    got = row.select(metrics.qa_scores(F.col("p"), F.col("s"))).first()[0]
    assert tuple(got) == pytest.approx((0.5, (0.8 + 1) / 2, 0.0))
    outs = spark.createDataFrame([("i", 0, "alpha. zeta.", ["alpha beta"]), ("i", 1, "alpha. beta [1].", ["alpha beta"]), ("j", 0, "none.", [])], "id string, at int, output string, docs array<string>")
    assert {r.id: r.output for r in metrics.rerank(outs, models.entailment(models.OverlapEntailment, None)).collect()} == {"i": "alpha. beta [1].", "j": ""}
    assert one(spark, force_citations(F.col("t"), F.col("n")), t="A b [3]. C d.", n=[0, 2]) == "[1][3] A b. [1][3] C d."


def test_summaries_fill_gaps(spark):
    class Loud:
        def generate(self, prompts, max_tokens):
            return ["made" for _ in prompts]

    docs = [("t", "x", None), ("u", "y", "had"), ("v", "z", None)]
    df = spark.createDataFrame([("i", "q", docs), ("j", "q", [])], "id string, question string, docs array<struct<title:string,text:string,summary:string>>")
    got = {r.id: [d.summary for d in r.docs] for r in models.summarized(df, Loud, top=2).collect()}
    assert got == {"i": ["made", "had", None], "j": []}


def test_running_sums_of_hot_null_and_small_groups(spark):
    data = [("hot", i % 50, i % 7) for i in range(300)] + [(None, i, None if i == 1 else 2) for i in range(3)] + [("one", None, 5)]
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "qid string, score int, w int, at int")
    sums = lambda before, total: {"_before": before, "_total": total}
    got = running(rows, "qid", [("score", True), ("at", False)], F.col("w"), sums).collect()
    assert len(got) == len(data)
    rank = lambda r: (r["score"] is None, -(r["score"] or 0), r["at"])
    for r in got:
        group = [o for o in got if o["qid"] == r["qid"]]
        assert r["_before"] == sum(o["w"] or 0 for o in group if rank(o) < rank(r))
        assert r["_total"] == sum(o["w"] or 0 for o in group)


def test_running_sums_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "qid string, at int")
    assert running(rows, "qid", [("at", False)], F.lit(1), lambda before, total: {"sum": total}).columns == ["qid", "at", "sum"]
    assert context.interleaved(rows.withColumn("total_score", F.lit(1))).count() == 0
