"""Sharding by sampled splitters, in DataFrame operations only.

A size-weighted sample of sort keys gives quantile boundaries, records are range-partitioned by them,
overfull ranges are subdivided with boundaries drawn from within them, and exact prefix sums over the
ranges turn positions in key order into shards of near equal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpoint, unused

#: Boundaries are drawn from about this many sampled keys per range.
SAMPLES_PER_RANGE = 32
LOWEST = -(2**63)


def _longs(values) -> Column:
    """A literal array, sent as one string and folded by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(boundaries: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """Number of boundaries that are not above (key, tie): a binary search over two literal arrays."""
    if not boundaries:
        return F.lit(0)
    keys, ties = _longs(k for k, _ in boundaries), _longs(t for _, t in boundaries)
    steps = [1 << b for b in reversed(range(len(boundaries).bit_length()))]

    def step(found: Column, jump: Column) -> Column:
        to = found + jump
        inside = to <= F.lit(len(boundaries))
        at = F.when(inside, to).otherwise(F.lit(1))
        k, t = F.element_at(keys, at), F.element_at(ties, at)
        return F.when(inside & ((k < key) | ((k == key) & (t <= tie))), to).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _quantiles(sample: list[tuple[int, int, int]], share: float, parts: int) -> list[tuple[int, int]]:
    """The sampled units that start each of `parts` parts of about equal weight; a unit weighs its size, `share` at least."""
    sample = sorted(sample)
    total = sum(max(size, share) for _, _, size in sample)
    cuts, seen = [], 0.0
    for key, tie, size in sample:
        if seen >= total * (len(cuts) + 1) / parts and len(cuts) < parts - 1:
            cuts.append((key, tie))
            while seen >= total * (len(cuts) + 1) / parts and len(cuts) < parts - 1:
                cuts.append((key, tie))
        seen += max(size, share)
    return sorted(set(cuts))


def _sampled(units: DataFrame, share: float, seed: int) -> list[tuple[int, int, int]]:
    """Each record with the chance size / share: decided by a hash, so that a repeated task draws the same."""
    chance = F.pmod(F.xxhash64("key", "tie", "id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = units.where(chance * F.lit(float(share)) < F.col("size")).select("key", "tie", "size").collect()
    return [(r.key, r.tie, r.size) for r in rows]


def shard_by_bytes(
    records: DataFrame,
    n_shards: int = 8,
    hot_share: float = 0.01,
    rows_per_range: int = 1_000_000,
    ranges_per_shard: int = 32,
    rounds: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Adds `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard) to records(id, key, size, ...).

    id: long, orders records of one key. key: long by which records are placed; records of equal key stay
    in one shard unless their bytes exceed `hot_share` of a shard's share, in which case the group is split
    by id. size: long, positive. The law is `bytes`: in the order (key, id) a unit goes to the shard in which
    its middle byte lies, so no shard is further than a unit from its share at each end.

    Bounds: the driver holds SAMPLES_PER_RANGE keys per range, the range totals and at most
    n_shards / hot_share hot keys. No window holds more than a range (about total / ranges bytes).
    Nulls: a null id counts as one of the lowest longs, each row as its own, so that even rows without ids can be split; a null key as 0, a null size as 1. Repeated rows are placed like any others.
    Very long records are units like others: a unit is never cut. Ties in key and id are broken by the engine, all within one unit.
    An empty table gives an empty result. Other columns are carried, whatever their names; only shard and slot may not be among them.
    """
    others = [c for c in records.columns if c.lower() not in ("id", "key", "size")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("rest")
    records = checkpoint(
        records.select("id", "key", "size", rest).withColumns({"id": F.coalesce("id", F.lit(LOWEST) + F.monotonically_increasing_id()), "key": F.coalesce("key", F.lit(0).cast("long")), "size": F.coalesce("size", F.lit(1).cast("long"))})
    )
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not rows:
        return _unpacked(records.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}), others)
    hot = (
        records.groupBy("key").agg(F.sum("size").alias("held"))
        .where(F.col("held") * F.lit(round(n_shards / hot_share)) > F.lit(total))
        .select("key", F.lit(True).alias("hot"))
    )  # at most n_shards / hot_share rows
    hot = records.sparkSession.createDataFrame(hot.collect(), "key long, hot boolean")
    units = records.join(F.broadcast(hot), "key", "left").withColumn("tie", F.when(F.col("hot"), F.col("id")).otherwise(F.lit(LOWEST))).drop("hot")

    ranges = max(n_shards * ranges_per_shard, -(-rows // rows_per_range))
    share = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    cuts = _quantiles(_sampled(units, share, seed), share, ranges)
    for extra in range(rounds):
        ranged = units.withColumn("range", _below(cuts, F.col("key"), F.col("tie")))
        held = ranged.groupBy("range").agg(F.sum("size").alias("held"), F.count_distinct("key", "tie").alias("kinds"))
        over = {r.range: r.held for r in held.where((F.col("held") > F.lit(4 * total // ranges)) & (F.col("kinds") > 1)).collect()}
        if not over:
            break
        inner = ranged.where(F.array_contains(_longs(over), F.col("range").cast("long")))
        finer = share / 4 ** (extra + 1)
        sample: dict[int, list] = {k: [] for k in over}
        low = {k: cuts[k - 1] if k else (LOWEST, LOWEST) for k in over}
        for unit in _sampled(inner, finer, seed + extra + 1):
            sample[max((k for k in over if low[k] <= unit[:2]), key=lambda k: low[k])].append(unit)
        cuts = sorted({*cuts, *(c for k, found in sample.items() for c in _quantiles(found, finer, 2 + over[k] * ranges // total))})
    return _unpacked(_placed(units.withColumn("range", _below(cuts, F.col("key"), F.col("tie"))), total, n_shards), others)


def _unpacked(placed: DataFrame, others: list[str]) -> DataFrame:
    return placed.select("id", "key", "size", *[F.col(f"rest.`{c}`").alias(c) for c in others], "shard", "slot")


def _placed(ranged: DataFrame, total: int, n_shards: int) -> DataFrame:
    spark = ranged.sparkSession
    held = ranged.groupBy("range").agg(F.sum("size").alias("held")).orderBy("range").collect()
    before, at = [], 0
    for r in held:
        before.append((r.range, at))
        at += r.held
    order = Window.partitionBy("range").orderBy("key", "tie")
    inside = (
        ranged.join(F.broadcast(spark.createDataFrame(before, "range int, before long")), "range")
        .withColumn("row", F.row_number().over(order.orderBy("key", "tie", "id")))
        .withColumn("end", F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("unit", F.sum("size").over(Window.partitionBy("range", "key", "tie")))
        .withColumn("shard", F.expr(f"cast((2 * (before + end) - unit) * {n_shards} div (2 * {total}) as int)"))
        .drop("before", "end", "unit", "tie")
    )
    inside = checkpoint(inside)
    parts = inside.groupBy("shard", "range").agg(F.min("row").alias("first"), F.count("*").alias("n")).orderBy("shard", "range").collect()
    starts, shard, at = [], None, 0
    for r in parts:
        at = at if r.shard == shard else 0
        starts.append((r.shard, r.range, at - r.first))
        shard, at = r.shard, at + r.n
    offsets = spark.createDataFrame(starts, "shard int, range int, shift long")
    return inside.join(F.broadcast(offsets), ["shard", "range"]).withColumn("slot", F.col("row") + F.col("shift")).drop("row", "shift", "range")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row (doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document.

    size is the UTF-8 bytes of the text (null: none) plus 1; text_crc32 is the unsigned CRC-32 of these bytes;
    the law is `bytes`. The key is the first 60 bits of the text's MD5, so equal texts stay together unless
    they fill over `hot_share` of a shard. Only keys and sizes are shuffled, never texts. The sampled splitters lay out the ranges; shards and slots
    are exact prefix sums over the key order, whatever the sample. A null text counts as an empty one, a null doc_id is returned as null and comes
    before others in ties; a very long text is one unit; repeated rows are placed each; an empty table gives an empty result. Other columns of docs are not read, so their names can't clash.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    records = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(id_column).isNull().alias("no_id"),
    )
    placed = shard_by_bytes(records, n_shards, **options)
    return placed.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write whole documents as Parquet, one folder per shard, ordered by slot.

    Ids must be unique, null being one of them; with repeated ids each row is written once for each row of that id, so ties have no order. Very long
    and empty or null texts are written as they are; empty tables write no folder; columns other than the id may have any name but shard and slot.
    Shards are dealt over tasks by slot, so a shard is never one task's work.
    """
    name = unused(docs, "placed_id")
    joined = docs.join(placed.select(F.col("doc_id").alias(name), "shard", "slot"), F.col(id_column).eqNullSafe(F.col(name))).drop(name)
    joined.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
