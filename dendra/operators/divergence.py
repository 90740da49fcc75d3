"""How far two sets of texts are apart as distributions: joint quantization of their vectors, histograms, and the area under the divergence curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of the curve: mixtures, how far they stay from 0 and 1, and the factor of the divergences.
MIXTURES, EDGE, SCALE = 25, 1e-6, 5.0


def _unfit(vectors: DataFrame, width: int) -> Column:
    return F.col("embedding").isNull() | (F.size("embedding") != width) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))


def _assigned(centers: np.ndarray, extra: str, schema: str):
    """Arrow batches (key, embedding) with the nearest center of each vector; of equally near ones the first."""

    def run(batches):
        half = (centers**2).sum(axis=1) / 2
        for batch in batches:
            for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                points = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                yield from nearest(part, points, np.argmin(half - points @ centers.T, axis=1))

    def nearest(part, points, bins):
        if extra == "bins":
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bins.astype(np.int32))], ["key", "bin"])
        else:
            sums = np.zeros((len(centers), centers.shape[1]))
            np.add.at(sums, bins, points)
            used = np.flatnonzero(np.bincount(bins, minlength=len(centers)))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.bincount(bins, minlength=len(centers))[used]), pa.array(sums[used].tolist())], ["bin", "n", "sums"])

    return lambda df: df.mapInArrow(run, schema)


def centers_of(vectors: DataFrame, bins: int, rounds: int = 10, key: str = "key") -> np.ndarray:
    """Centers of vectors (key, embedding) by Lloyd's rounds, starting from the vectors of the smallest keys.

    The driver holds bins x width numbers, whatever the number of vectors; a task sends one sum for each bin and batch, and these are added before the shuffle.
    A bin that loses all its vectors keeps its center. Fewer vectors than bins give fewer bins; vectors must be complete (see histograms).
    """
    first = vectors.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    start = [r.embedding for r in first.orderBy("key").limit(bins).collect()]
    if not start:
        return np.zeros((0, 1))
    centers = np.array(start, dtype=np.float64)
    for _ in range(rounds):
        sums = _assigned(centers, "sums", "bin int, n long, sums array<double>")(first)
        one = sums.select("bin", "n", F.posexplode("sums").alias("at", "x")).groupBy("bin", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        moved = centers.copy()
        for r in one.select("bin", "at", (F.col("x") / F.col("n")).alias("x")).collect():
            moved[r.bin, r["at"]] = r.x
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def cells_of(vectors: DataFrame, centers: np.ndarray, key: str) -> DataFrame:
    """vectors (key, embedding) with the number of their nearest center as `cell`."""

    def run(batches):
        half = (centers**2).sum(axis=1) / 2
        for batch in batches:
            for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                points = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                bins = np.argmin(half - points @ centers.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bins)], [key, "embedding", "cell"])

    return vectors.select(key, "embedding").mapInArrow(run, f"{key} long, embedding array<float>, cell int")


def histograms(left: DataFrame, right: DataFrame, bins: int = 500, rounds: int = 10, key: str = "vec_id") -> DataFrame:
    """(bin, n_left, n_right): how many vectors of each set (key, embedding) fall in each bin of their joint quantization.

    Vectors that are null, hold nulls or no numbers, or are not as wide as the first one are left out. Two empty sets have no bins.
    """
    spark = left.sparkSession
    both = left.select(F.struct(F.lit(0).alias("side"), F.col(key).alias("id")).alias("key"), "embedding").unionByName(right.select(F.struct(F.lit(1).alias("side"), F.col(key).alias("id")).alias("key"), "embedding"))
    width = both.where("embedding is not null").select(F.struct(F.col("key.id"), F.col("key.side"), F.size("embedding").alias("n")).alias("s")).agg(F.min("s").alias("s")).first().s
    schema = "bin int, n_left long, n_right long"
    if width is None:
        return spark.createDataFrame([], schema)
    good = both.where(~_unfit(both, width.n)).withColumn("order", F.struct("key.id", "key.side"))
    centers = centers_of(good, bins, rounds, "order")
    placed = _assigned(centers, "bins", "key int, bin int")(good.select(F.col("key.side").alias("key"), F.col("embedding").cast("array<double>").alias("embedding")))
    return placed.groupBy("bin").agg(F.count_if(F.col("key") == 0).alias("n_left"), F.count_if(F.col("key") == 1).alias("n_right"))


def divergence_curve(counts: DataFrame) -> DataFrame:
    """(x, y) points of the divergence curve of two histograms (bin, n_left, n_right), the ends (0, 1) and (1, 0) included.

    For a mixture r of both, x = exp(-c KL(right | r)) and y = exp(-c KL(left | r)), c = SCALE.
    """
    spark = counts.sparkSession
    totals = counts.agg(F.sum("n_left").alias("all_left"), F.sum("n_right").alias("all_right"))
    shares = counts.join(F.broadcast(totals)).select(F.try_divide("n_left", "all_left").alias("p"), F.try_divide("n_right", "all_right").alias("q"))
    mixtures = spark.range(MIXTURES).select((F.lit(EDGE) + F.col("id") * ((1 - 2 * EDGE) / (MIXTURES - 1))).alias("w"))
    rows = shares.join(F.broadcast(mixtures)).withColumn("r", F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q"))

    def divergence(part: str) -> Column:
        return F.sum(F.when(F.col(part) > 0, F.col(part) * F.log(F.col(part) / F.col("r"))).otherwise(0.0))

    points = rows.groupBy("w").agg(F.exp(-SCALE * divergence("q")).alias("x"), F.exp(-SCALE * divergence("p")).alias("y")).select("x", "y")
    return points.unionByName(spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "x double, y double"))


def curve_area(curve: DataFrame) -> DataFrame:
    """(area): under the curve by trapezoids, the mean of both ways to read it; 1 for equal distributions. A curve has MIXTURES + 2 points, so one task orders them."""

    def side(along: str, height: str) -> Column:
        order = Window.orderBy(along, F.desc(height))
        return (F.col(along) - F.lag(along).over(order)) * (F.col(height) + F.lag(height).over(order)) / 2

    return curve.select(side("x", "y").alias("a"), side("y", "x").alias("b")).agg((F.coalesce(F.sum("a"), F.lit(0.0)) / 2 + F.coalesce(F.sum("b"), F.lit(0.0)) / 2).alias("area"))


def distribution_score(left: DataFrame, right: DataFrame, bins: int = 500, rounds: int = 10, key: str = "vec_id") -> DataFrame:
    """(area) of two sets of vectors; null if one is empty."""
    counts = histograms(left, right, bins, rounds, key)
    sizes = counts.agg(F.sum("n_left").alias("l"), F.sum("n_right").alias("r"))
    return curve_area(divergence_curve(counts)).join(F.broadcast(sizes)).select(F.when((F.col("l") > 0) & (F.col("r") > 0), F.col("area")).alias("area"))
