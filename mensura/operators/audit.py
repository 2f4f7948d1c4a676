"""Leakage between the sides of a split: equal keys, nearest neighbours, groups on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators.similarity import nearest, range_join
from mensura.operators.splits import quantiles
from mensura.session import cut

BY = ["split", "seed"]


def exact_dupes(sided: DataFrame, key: str = "inchikey", by: list[str] = BY) -> DataFrame:
    """(split, seed, exact_dupe_keys): test rows whose key is in train; each row counts."""
    train = sided.filter("side = 'train'").select(*by, key).distinct()
    hit = sided.filter("side = 'test'").join(train, [*by, key], "left_semi").groupBy(*by).agg(F.count("*").alias("n"))
    return sided.select(*by).distinct().join(hit, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("exact_dupe_keys"))


def scaffold_straddle(sided: DataFrame, group: str = "scaffold", by: list[str] = BY) -> DataFrame:
    """(split, seed, scaffold_straddle_frac): share of test rows whose group is in train; null groups are the group ''."""
    g = F.coalesce(group, F.lit(""))
    train = sided.filter("side = 'train'").select(*by, g.alias("_g")).distinct().withColumn("_hit", F.lit(1.0))
    test = sided.filter("side = 'test'").select(*by, g.alias("_g")).join(train, [*by, "_g"], "left")
    share = test.groupBy(*by).agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("f"))
    return sided.select(*by).distinct().join(share, by, "left").select(*by, F.round(F.coalesce("f", F.lit(0.0)), 6).alias("scaffold_straddle_frac"))


def _folded(sided: DataFrame, sets: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct vectors, test rows, train vectors): set_id, pos; by, set_id of every test row, null where its key has no vector; by, set_id of train, each once."""
    own = sets.select(key, F.col("set_id") if "set_id" in sets.columns else F.xxhash64(key).alias("set_id"), "pos").filter("size(pos) > 0")
    vectors = cut(own.groupBy("pos").agg(F.min("set_id").alias("set_id")))
    names = own.join(vectors.withColumnRenamed("set_id", "_set"), "pos").select(key, F.col("_set").alias("set_id"))
    placed = cut(sided.select(*by, "side", key).join(names, key, "left").select(*by, "side", "set_id"))
    train = cut(placed.filter("side = 'train' and set_id is not null").select(*by, "set_id").distinct())
    return vectors, placed.filter("side = 'test'").select(*by, "set_id"), train


def near_train(vectors: DataFrame, test: DataFrame, train: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by, set_id, nn): exact similarity of the test vectors that have a train vector of similarity ``least`` or more to the nearest one.

    The pairs come from one range join over all vectors, whatever the number of splits.
    """
    wanted = test.filter("set_id is not null").distinct()
    equal = wanted.join(train, [*by, "set_id"], "left_semi").withColumn("nn", F.lit(1.0))
    pairs = range_join(vectors, least)
    links = pairs.union(pairs.select("b", "a", "similarity")).toDF("set_id", "_b", "similarity")
    open_ = wanted.join(train, [*by, "set_id"], "left_anti")
    met = open_.join(cut(links), "set_id").join(train.withColumnRenamed("set_id", "_b"), [*by, "_b"]).groupBy(*by, "set_id").agg(F.max("similarity").alias("nn"))
    return equal.select(*by, "set_id", "nn").unionByName(met)


def nearest_train(sided: DataFrame, sets: DataFrame, key: str = "inchikey", by: list[str] = BY, least: float = 0.7, levels: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(by, nn) of every test row: similarity to the nearest train vector, 0 without a vector; exact from ``least`` on, and where a quantile of ``levels`` needs it.

    Where all the ranks of a split's quantiles lie among its test rows of ``least`` and more, nothing
    depends on how far below the others are: they have 0. Elsewhere the others are compared with all
    train vectors in blocks.
    """
    vectors, test, train = _folded(sided, sets, key, by)
    found = cut(near_train(vectors, test, train, by, least))
    rows = cut(test.join(found, [*by, "set_id"], "left"))
    n, below = F.count("*"), F.count_if(F.col("nn").isNull())
    lowest = F.floor(F.lit(min(levels)) * (n - 1))
    unsettled = cut(rows.groupBy(*by).agg(n.alias("_n"), below.alias("_below"), lowest.alias("_rank")).filter("_rank < _below").select(*by))  # one row a split
    rest = rows.filter("nn is null and set_id is not null").join(F.broadcast(unsettled), by, "left_semi").select(*by, "set_id").distinct().join(vectors, "set_id")
    against = train.join(F.broadcast(unsettled), by, "left_semi").join(vectors, "set_id").select(*by, "pos")
    far = nearest(cut(rest.select(*by, F.col("set_id").alias("a"), "pos")), against, by).select(*by, F.col("a").alias("set_id"), F.col("nn").alias("_far"))
    return rows.join(far, [*by, "set_id"], "left").select(*by, F.coalesce("nn", "_far", F.lit(0.0)).alias("nn"))


def twin_audit(sided: DataFrame, sets: DataFrame, key: str = "inchikey", by: list[str] = BY) -> DataFrame:
    """Of leakage_audit's figures those that the panel shows: equal keys, test rows of similarity 0.9 and more, groups on both sides. Only pairs of 0.9 are looked for."""
    vectors, test, train = _folded(sided, sets, key, by)
    rows = test.join(near_train(vectors, test, train, by, 0.9), [*by, "set_id"], "left")
    shares = rows.groupBy(*by).agg(F.round(F.avg(F.col("nn").isNotNull().cast("double")), 6).alias("frac_test_nn_ge_0_9"))
    return exact_dupes(sided, key, by).join(shares, by, "left").join(scaffold_straddle(sided, by=by), by).na.fill(0.0, ["frac_test_nn_ge_0_9"])


def leakage_audit(sided: DataFrame, sets: DataFrame, key: str = "inchikey", by: list[str] = BY) -> DataFrame:
    """One row per (split, seed) with the nine figures of the leak report."""
    sizes = sided.groupBy(*by).agg(F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test"))
    nn = cut(nearest_train(sided, sets, key, by))
    shares = nn.groupBy(*by).agg(F.avg((F.col("nn") >= 0.7).cast("double")).alias("f7"), F.avg((F.col("nn") >= 0.9).cast("double")).alias("f9"))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    figures = shares.join(quantiles(nn, by, "nn", [0.5, 0.9]), by).select(*by, r(F.col("q")[0]).alias("nn_tanimoto_median"), r(F.col("q")[1]).alias("nn_tanimoto_p90"), r(F.col("f7")).alias("frac_test_nn_ge_0_7"), r(F.col("f9")).alias("frac_test_nn_ge_0_9"))
    out = sizes.join(exact_dupes(sided, key, by), by).join(figures, by, "left").join(scaffold_straddle(sided, by=by), by)
    return out.na.fill(0.0, ["nn_tanimoto_median", "nn_tanimoto_p90", "frac_test_nn_ge_0_7", "frac_test_nn_ge_0_9"])


def render(report: DataFrame, by: list[str] = BY) -> list[str]:
    """Lines of text for a (small) report: one a split."""
    return [
        f"  [{'/'.join(str(r[c]) for c in by):>20}] train={r['n_train']} test={r['n_test']} | exact: {r['exact_dupe_keys']} | nearest median {r['nn_tanimoto_median']:.2f}, p90 {r['nn_tanimoto_p90']:.2f} | "
        f">=0.7: {r['frac_test_nn_ge_0_7']:.0%}, >=0.9: {r['frac_test_nn_ge_0_9']:.0%} | groups on both sides: {r['scaffold_straddle_frac']:.0%}"
        for r in report.orderBy(*by).collect()
    ]
