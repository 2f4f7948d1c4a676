"""Train/test sides of rows: random, grouped, in time order; calibration slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.session import cut


def shuffled(seed: int, key: str, salt: str = "") -> Column:
    """A place in a random order that depends on seed and key alone, wherever the row lies."""
    return F.md5(F.concat(F.lit(f"{seed}{salt}:"), F.col(key).cast("string")))


def _side(rank: Column, n: Column, test_share: float) -> Column:
    return F.when(rank <= F.bround(n * F.lit(1.0 - test_share)), "train").otherwise("test")


def running(rows: DataFrame, by: list[str], order: list[Column], weight: Column | None = None) -> DataFrame:
    """Adds _before (summed weight of the rows before, within ``by``) and _total, without one task for a whole group.

    Rows are range-partitioned by (by, order) and written once; sums within each partition are shifted by
    those of the partitions before it, of which there are as many as partitions.
    """
    named = rows.withColumn("_w", (weight if weight is not None else F.lit(1)).cast("long"))
    placed = cut(named.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_w").alias("_n"))
    all_before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(all_before), F.lit(0)).alias("_shift"), F.sum("_n").over(W.partitionBy(*by)).alias("_total"))
    within = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("_in", F.coalesce(F.sum("_w").over(within), F.lit(0))).join(offsets, [*by, "_part"]).withColumn("_before", F.col("_in") + F.col("_shift")).drop("_w", "_part", "_in", "_shift")


def quantiles(rows: DataFrame, by: list[str], value: str, levels: list[float]) -> DataFrame:
    """(by, q): the linearly interpolated quantiles of ``value`` in every group, by ranks over range partitions; nulls do not count."""
    ranked = running(rows.select(*by, value).filter(F.col(value).isNotNull()), by, [F.col(value)])
    place = [F.lit(q) * (F.col("_total") - 1) for q in levels]
    at = lambda rank: F.max(F.when(F.col("_before") == rank, F.col(value)))
    ends = ranked.groupBy(*by).agg(*[x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"lo{i}"), at(F.ceil(p)).alias(f"hi{i}"), F.max(p - F.floor(p)).alias(f"part{i}"))])
    return ends.select(*by, F.array(*[F.col(f"lo{i}") + F.col(f"part{i}") * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in range(len(levels))]).alias("q"))


def _ranked(rows: DataFrame, order: list[Column], test_share: float, by: list[str]) -> DataFrame:
    return running(rows, by, order).withColumn("side", _side(F.col("_before") + 1, F.col("_total"), test_share)).drop("_before", "_total")


def random_split(rows: DataFrame, key: str, test_share: float = 0.25, seed: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """The first round-half-even(n * (1 - share)) rows of a seeded order are train."""
    return _ranked(rows.withColumn("_o", shuffled(seed, key)), [F.col("_o"), F.col(key)], test_share, list(by)).drop("_o")


def time_split(rows: DataFrame, key: str, year: str = "year", test_share: float = 0.25, by: tuple[str, ...] = ()) -> DataFrame:
    """The latest rows are test; ties by key. ``year`` must not be null (see fill_defaults)."""
    return _ranked(rows, [F.col(year), F.col(key)], test_share, list(by))


def grouped_split(rows: DataFrame, group: str, test_share: float = 0.25, seed: int = 1, smallest_first: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Whole groups go to test, in a seeded order or smallest first, while the groups before them hold less than the target.

    Only (group, size) rows are ordered: one row a group.
    """
    sizes = rows.groupBy(*by, group).agg(F.count("*").alias("_n"))
    order = [F.col("_n"), F.col(group)] if smallest_first else [shuffled(seed, group), F.col(group)]
    sided = running(sizes, list(by), order, F.col("_n"))
    sided = sided.select(*by, group, F.when(F.col("_before") < F.bround(F.col("_total") * F.lit(test_share)), "test").otherwise("train").alias("side"))
    return rows.join(sided, [*by, group])


def make_split(kind: str, rows: DataFrame, key: str, test_share: float = 0.25, seed: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Sides by kind: random, scaffold, cluster (needs that column) or time."""
    if kind == "random":
        return random_split(rows, key, test_share, seed, by)
    if kind in ("scaffold", "cluster"):
        return grouped_split(rows, kind, test_share, seed, by=by)
    if kind == "time":
        return time_split(rows, key, test_share=test_share, by=by)
    raise ValueError(f"unknown kind of split: {kind}")


def split_table(rows: DataFrame, key: str, plan: list[tuple[str, int]], test_share: float = 0.25, by: tuple[str, ...] = ()) -> DataFrame:
    """(split, seed, all columns of rows, side) for every (kind, seed) of the plan; with ``by``, every group of rows is split for itself."""
    out = None
    for kind, seed in plan:
        part = make_split(kind, rows, key, test_share, seed, by).select(F.lit(kind).alias("split"), F.lit(seed).alias("seed"), *rows.columns, "side")
        out = part if out is None else out.unionByName(part)
    return out


def calibration_roles(sided: DataFrame, key: str, share: float = 0.25, least: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """role per (by, split, seed): test, or of the train rows max(least, round(share * n)) cal and the rest fit."""
    order = F.md5(F.concat(F.col("seed").cast("string"), F.lit("cal:"), F.col(key).cast("string")))
    placed = running(sided, [*by, "split", "seed", "side"], [order, F.col(key)])
    n_cal = F.greatest(F.lit(least), F.bround(F.col("_total") * F.lit(share)))
    return placed.withColumn("role", F.when(F.col("side") == "test", "test").when(F.col("_before") + 1 <= n_cal, "cal").otherwise("fit")).drop("_before", "_total")


def large_enough(sided: DataFrame, by: list[str], test: int = 10, train: int = 40) -> DataFrame:
    """The rows of the groups that have at least ``test`` test and ``train`` train rows; the others are not evaluated."""
    sizes = sided.groupBy(*by).agg(F.count_if(F.col("side") == "test").alias("_te"), F.count_if(F.col("side") == "train").alias("_tr"))
    return sided.join(F.broadcast(sizes.filter((F.col("_te") >= test) & (F.col("_tr") >= train)).select(*by)), by)  # one row a split
