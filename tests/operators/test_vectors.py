import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.functions.vector import pooled
from dendra.operators import retrieval
from dendra.operators.models import embedded_by_tokens


def frame(spark, m, name="vec_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<float>")


def test_pooling(spark):
    rows = [([[1.0, 2.0], [3.0, 2.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0]), ([], []), (None, None), ([[0.0, 3.0], [5.0, 5.0]], [1])]
    df = spark.createDataFrame(rows, "t array<array<float>>, m array<int>")
    got = [r[0] for r in df.select(pooled(F.col("t"), F.col("m"))).collect()]
    assert got[0] == pytest.approx([2**-0.5, 2**-0.5]) and got[1] == [0, 0] and got[2] is None and got[3] is None and got[4] == [0, 1]

    class Letters:
        def tokens(self, texts, max_tokens):
            return [([[1.0, float(x == "b")] for x in t[:max_tokens]], [1] * len(t[:max_tokens])) for t in texts]

    made = spark.createDataFrame([("ab",), ("bbbb",), (None,)], "t string").select(embedded_by_tokens(F.col("t"), Letters, max_tokens=3)).collect()
    assert made[0][0] == pytest.approx([0.8**0.5, 0.2**0.5]) and made[1][0] == pytest.approx([0.5**0.5] * 2) and made[2][0] is None


@pytest.mark.parametrize("step", [1, 50, 1 << 22])
def test_dense_top_in_steps(spark, monkeypatch, step):
    monkeypatch.setattr(retrieval, "STEP_CELLS", step)
    rng = np.random.default_rng(1)
    m, q = rng.integers(-2, 3, (60, 4)).astype(float), rng.integers(-2, 3, (7, 4)).astype(float)
    vectors = frame(spark, m).unionByName(spark.createDataFrame([(100, None), (101, [1.0])], "vec_id long, embedding array<float>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in retrieval.dense_top(vectors, frame(spark, q, "query_id"), k=5).collect()}
    for i in range(7):
        order = sorted(range(60), key=lambda j: (-(q[i] @ m[j]), j))[:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, q[i] @ m[j]) for j in order]
    assert len(got) == 35


def test_cells_have_recall_and_all_cells_are_exact(spark, tmp_path):
    rng = np.random.default_rng(2)
    m = np.concatenate([rng.normal(c, 1.0, (150, 8)) for c in rng.normal(0, 2, (10, 8))]).astype(np.float32)
    vectors, queries = frame(spark, m), frame(spark, m[::20], "query_id")
    retrieval.write_cells(vectors, str(tmp_path), 16)
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 1500
    exact = {tuple(r) for r in retrieval.dense_top(vectors, queries, k=10, normalized=True).select("query_id", "vec_id").collect()}
    search = lambda p: {tuple(r) for r in retrieval.cell_top(spark, str(tmp_path), queries, k=10, probes=p, normalized=True).select("query_id", "vec_id").collect()}
    assert search(16) == exact and len(search(6) & exact) >= 0.9 * len(exact)
    few = retrieval.cell_top(spark, str(tmp_path), queries.limit(1), k=3, probes=1)
    assert few.count() == 3


def test_empty_sides(spark, tmp_path):
    none = frame(spark, [])
    assert retrieval.dense_top(none, none.withColumnRenamed("vec_id", "query_id")).collect() == []
    retrieval.write_cells(none, str(tmp_path), 4)
    assert retrieval.cell_top(spark, str(tmp_path), frame(spark, [[1, 2]], "query_id")).collect() == []


def test_rounded_zero_keeps_its_sign(spark):
    from dendra.functions.vector import rounded

    values = [-1e-7, 1e-7, 0.0, -5e-7, 5e-7, -0.1234567, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rounded(F.col("v"), 6).alias("r")).orderBy("i").collect()
    assert [repr(r.r) for r in rows] == ["-0.0", "0.0", "0.0", "-1e-06", "1e-06", "-0.123457", "None"]
