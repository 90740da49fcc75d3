import pytest
from pyspark.sql import functions as F

from dendra.functions.stems import stem
from dendra.operators.metrics import best_summary_overlap, resampled, summary_overlap

#: From the tables of the published algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "vietnamization": "vietnam", "operator": "oper", "hopefulness": "hope", "sensibiliti": "sensibl", "triplicate": "triplic",
    "electrical": "electr", "revival": "reviv", "allowance": "allow", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "rolling": "roll", "was": "was", "é": "é", "naïves": "naïves", "a1s9s": "a1s9s",
}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert stem(word) == STEMS[word]


def test_stems_make_forms_equal(spark):
    a, b = "Cats were running\nand adopted", "the cat runs and adoption"
    assert summary_overlap(a, b) == pytest.approx(2 * 4 / 10) and summary_overlap(a, b, stems=False) == pytest.approx(2 / 10)
    rows = spark.createDataFrame([(["x", a], b), ([], b), (None, b), ([a], None)], "refs array<string>, said string")
    assert [r[0] for r in rows.select(best_summary_overlap(F.col("refs"), F.col("said"))).collect()] == pytest.approx([0.8, 0, 0, 0])


def test_interval_holds_the_mean_whatever_the_layout(spark):
    rows = [(i, i % 7, float(i % 10)) for i in range(400)] + [(None, 1, 3.0), (500, 1, None)]
    df = spark.createDataFrame(rows, "a long, b long, score double")
    got = resampled(df, "score", ["a", "b"], replicates=300).first()
    assert got.n == 401 and got.low < got.mean < got.high and 0.4 < got.high - got.low < 0.8  # 1.96 times 2.87 over 20 on both sides
    assert tuple(resampled(df.repartition(7), "score", ["a", "b"], replicates=300).first()) == pytest.approx(tuple(got))
    assert tuple(resampled(df.where("a < 0"), "score", ["a", "b"]).first()) == (0, None, None, None)
