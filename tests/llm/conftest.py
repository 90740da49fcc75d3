import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("id", "key", "size", "shard", "slot", "fp", "root", "score", "word", "words", "gone", "Gone_", "repeat_id", "repeat_spans", "cluster", "bucket", "label", "length")


def prose(rng, n, words=3000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and blank texts, a long one, copies, ties, repeated rows and a shared passage."""
    rng = random.Random(5)
    base, passage, item = prose(rng, 200), prose(rng, 70), prose(rng, 40)
    near = base.split()
    near[100] = "changed"
    texts = [None, "", "  \n\t ", "one", "Two words", base, base, " ".join(near), prose(rng, 60) + " " + passage + " " + prose(rng, 60),
             prose(rng, 30) + "\n" + prose(rng, 55) + " " + passage + "\n" + prose(rng, 10), prose(rng, 20000), prose(rng, 80) + " " + item + " " + prose(rng, 80),
             "you are an idiot and a moron " + prose(rng, 30), "Ünïcödé " * 40, prose(rng, 300), "same", "same", "same"]
    made = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*made, made[5], (None, prose(rng, 90), "en", "src0", 1), (None, None, None, None, None)], item


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows[0], SCHEMA)
    for name in CLASHES:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark, rows):
    return spark.createDataFrame([(0, rows[1]), (1, None), (2, ""), (3, "some other words of a test item. And its answer."), (None, "nobody has this")], "item_id long, text string").selectExpr("*", "1 AS doc_id")


@pytest.fixture(scope="session")
def labels(spark, rows):
    rng = random.Random(8)
    toxic = [(1000 + i, 1, 1) for i in range(40)] + [(2000 + i, 1, 0) for i in range(120)]
    texts = [(i, ("you idiot " if x else "") + prose(rng, 30) + (" moron" if x else ""), "en", "src1", 1) for i, _, x in toxic]
    return spark.createDataFrame([*toxic, (12, None, 1), (3, 0, None), (None, 0, 1), (1000, 1, 1)], "doc_id long, quality int, toxic int"), spark.createDataFrame(texts, SCHEMA)
