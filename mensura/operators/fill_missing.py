"""Fill a missing field from similar rows: entity, K-prototypes cluster, whole table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.session import cut


@dataclass(frozen=True)
class Prototypes:
    """k prototypes: means of the scaled numeric features and modes of the categorical ones (k rows, held on the driver)."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    scale: dict[str, tuple[float, float]]
    means: list[list[float | None]]
    modes: list[list[str | None]]
    gamma: float

    def nearest(self) -> Column:
        """Number of the nearest prototype; features that are missing on either side do not count. Ties go to the lower number."""
        numeric, categorical, scale, means, modes, gamma = self.numeric, self.categorical, self.scale, self.means, self.modes, self.gamma

        @F.pandas_udf("int")
        def place(rows: pd.DataFrame) -> pd.Series:
            d = np.zeros((len(rows), len(means)))
            for j, c in enumerate(numeric):
                x = ((rows[c].to_numpy(dtype=float, na_value=np.nan) - scale[c][0]) / scale[c][1])[:, None]
                m = np.array([np.nan if r[j] is None else r[j] for r in means])
                d += np.nan_to_num((x - m) ** 2)
            for j, c in enumerate(categorical):
                levels = {m[j]: i for i, m in enumerate(modes) if m[j] is not None}
                x = rows[c].map(levels).to_numpy(dtype=float, na_value=np.nan)[:, None]
                m = np.array([np.nan if r[j] is None else levels[r[j]] for r in modes])
                seen = rows[c].notna().to_numpy()[:, None] & ~np.isnan(m)
                d += gamma * (seen & (x != m))
            return pd.Series(d.argmin(1))

        return place(F.struct(*numeric, *categorical))


def fit_prototypes(df: DataFrame, numeric: list[str], categorical: list[str], k: int = 16, gamma: float = 1.0, step: float = 0.25, max_iter: int = 8, tol: float = 0.002) -> Prototypes | None:
    """K-prototypes (Huang) over all rows of ``df``; None for an empty table.

    Rows are first folded to weighted cells: equal categories and equal numbers after rounding to
    ``step`` standard deviations. Every iteration aggregates the cells by key; only the k prototypes
    come to the driver. Missing features are left out of distances and of means and modes.
    """
    stats = df.agg(*[f for c in numeric for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))], F.count("*").alias("n")).first() if numeric else None
    scale = {c: (float(stats[f"m_{c}"] or 0.0), float(stats[f"s_{c}"] or 0.0) or 1.0) for c in numeric}
    rounded = [(F.round((F.col(c) - scale[c][0]) / (scale[c][1] * step)) * (scale[c][1] * step) + scale[c][0]).alias(c) for c in numeric]
    cells = cut(df.select(*rounded, *categorical).groupBy(*numeric, *categorical).agg(F.count("*").alias("_w")))
    order = F.xxhash64(*[F.col(c).cast("string") for c in (*numeric, *categorical)])
    seeds = cells.orderBy(order, *numeric, *categorical).limit(k).collect()
    if not seeds:
        return None
    p = Prototypes(tuple(numeric), tuple(categorical), scale, [[None if r[c] is None else (r[c] - scale[c][0]) / scale[c][1] for c in numeric] for r in seeds], [[r[c] for c in categorical] for r in seeds], gamma)
    before = None
    for _ in range(max_iter):
        placed = cells.withColumn("_c", p.nearest())
        features = F.array(
            *[F.struct(F.lit(c).alias("f"), F.lit(None).cast("string").alias("v"), ((F.col(c) - scale[c][0]) / scale[c][1]).cast("double").alias("x")) for c in numeric],
            *[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v"), F.lit(None).cast("double").alias("x")) for c in categorical],
        )
        found = (
            placed.select("_c", "_w", F.inline(features)).filter("v is not null or x is not null")
            .groupBy("_c", "f", "v").agg(F.sum("_w").alias("w"), F.sum(F.col("x") * F.col("_w")).alias("x"), F.sum(F.col("x") * F.col("x") * F.col("_w")).alias("xx"))
            .groupBy("_c", "f").agg(F.max_by("v", F.struct("w", "v")).alias("mode"), F.max("w").alias("top"), F.sum("w").alias("w"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
            .collect()
        )
        at = {(r["_c"], r["f"]): r for r in found}
        means = [[(at[i, c]["x"] / at[i, c]["w"]) if (i, c) in at else p.means[i][j] for j, c in enumerate(numeric)] for i in range(len(p.means))]
        modes = [[at[i, c]["mode"] if (i, c) in at else p.modes[i][j] for j, c in enumerate(categorical)] for i in range(len(p.modes))]
        cost = sum((r["xx"] - r["x"] ** 2 / r["w"]) if r["f"] in scale else gamma * (r["w"] - r["top"]) for r in found)
        p = Prototypes(p.numeric, p.categorical, scale, means, modes, gamma)
        if before is not None and before - cost <= tol * max(before, 1e-9):
            break
        before = cost
    return p


def fill_from_clusters(
    df: DataFrame, field: Column, entity: Column, numeric: dict[str, Column], categorical: dict[str, Column], k: int = 16, out: str = "filled", method: str = "fill_method", kind: str = "number", hot: int = 100_000, levels: tuple[str, ...] = ("entity", "cluster", "table")
) -> DataFrame:
    """All rows of ``df`` plus ``out`` (the field, observed or filled) and ``method`` saying where it came from.

    ``field`` is the usable value or null, a number or (``kind`` "category") a text; ``entity`` the key of
    the finest group. Levels, each the fallback of the one before: ``entity`` - the value most rows of the
    same entity state (of equally frequent ones the smallest); ``cluster`` - the median, of a category the
    mode, of the row's K-prototypes cluster; ``table`` - the same of all rows. ``observed`` marks values that
    were there, ``none`` rows for which no level knows a value. Null entities never match each other.
    ``levels`` leaves some out. Rows are carried along, not joined again, so ids need not be unique and
    repeated rows are filled alike; a column that is called like ``out`` or ``method`` is replaced. An empty
    table gives no rows.

    Counts are folded per (entity, value) before any shuffle. Of the rows to fill only those whose entity
    states a value are shuffled to it; entities with more than ``hot`` such rows, of which there is at most
    one a ``hot`` rows, and the ``k`` clusters are sent to the rows instead.
    """
    df = df.drop(out, method)
    features = [*[c.cast("double").alias(f"_n_{n}") for n, c in numeric.items()], *[c.cast("string").alias(f"_k_{n}") for n, c in categorical.items()]]
    nums, cats = [f"_n_{n}" for n in numeric], [f"_k_{n}" for n in categorical]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), field.alias("_v"), entity.alias("_e"), *features)
    p = fit_prototypes(rows.select(*nums, *cats), nums, cats, k) if "cluster" in levels else None
    mode = lambda n: F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct(-F.col(n), F.col("_v"))))
    folded = rows.filter("_e is not null").groupBy("_e", "_v").agg(F.count("*").alias("_n"))
    stated = cut(folded.groupBy("_e").agg(mode("_n").alias("_entity"), F.sum(F.when(F.col("_v").isNull(), F.col("_n"))).alias("_gaps")).filter("_gaps > 0"))
    gaps = rows.filter("_v is null").withColumn("_c", p.nearest() if p else F.lit(0))
    many = F.broadcast(stated.filter(F.col("_gaps") > hot).select("_e", F.col("_entity").alias("_often"), F.lit(True).alias("_many")))
    if "entity" not in levels:
        placed = gaps.withColumn("_entity", F.lit(None).cast(gaps.schema["_v"].dataType))
    else:
        apart = gaps.join(many, "_e", "left")
        straight = apart.filter("_e is null or _many").withColumn("_entity", F.col("_often"))
        few = apart.filter("_e is not null and _many is null")
        # entities that state nothing meet nothing: their rows stay where they are
        stating = stated.filter((F.col("_gaps") <= hot) & F.col("_entity").isNotNull()).select("_e", "_entity")
        placed = straight.drop("_often", "_many").unionByName(few.drop("_often", "_many").join(stating, "_e", "left"))
    known = rows.filter("_v is not null")
    clustered = known.select((p.nearest() if p else F.lit(0)).alias("_c"), "_v")
    if kind == "number":
        by_cluster = clustered.groupBy("_c").agg(F.percentile_approx("_v", 0.5, 10000).alias("_cluster"))
        whole = known.agg(F.percentile_approx("_v", 0.5, 10000).alias("_middle")).first()["_middle"]
    else:
        counted = cut(clustered.groupBy("_c", "_v").agg(F.count("*").alias("_n")))
        by_cluster = counted.groupBy("_c").agg(mode("_n").alias("_cluster"))
        whole = counted.groupBy("_v").agg(F.sum("_n").alias("_n")).agg(mode("_n").alias("_middle")).first()["_middle"]
    usable = lambda level, c: F.col(c) if level in levels else F.lit(None).cast(rows.schema["_v"].dataType)
    table = F.lit(whole if "table" in levels else None).cast(rows.schema["_v"].dataType)
    tiers = [("entity", usable("entity", "_entity")), ("cluster", usable("cluster", "_cluster")), ("table", table)]
    named = F.lit("none")
    for name, value in reversed(tiers):
        named = F.when(value.isNotNull(), name).otherwise(named)
    filled = placed.join(F.broadcast(by_cluster), "_c", "left").select("__row.*", F.coalesce(*[v for _, v in tiers]).alias(out), named.alias(method))
    return known.select("__row.*", F.col("_v").alias(out), F.lit("observed").alias(method)).unionByName(filled)


def held_out_error(df: DataFrame, field: Column, entity: Column, numeric: dict[str, Column], categorical: dict[str, Column], order: Column, share: int = 5, k: int = 16) -> DataFrame:
    """(level, n, mean_error): every ``share``-th observed number is hidden and filled by each level alone.

    ``order`` is a number by which the rows are hidden. Says what each level is worth on these data.
    """
    hidden = F.pmod(F.xxhash64(order), F.lit(share)) == 0
    seen = df.withColumn("__true", field)
    out = None
    for level in ("entity", "cluster", "table"):
        masked = F.when(~hidden, field)
        filled = fill_from_clusters(seen, masked, entity, numeric, categorical, k, "__filled", "__method", levels=(level,))
        part = filled.filter("__true is not null").filter(hidden).agg(F.lit(level).alias("level"), F.count("__filled").alias("n"), F.round(F.avg(F.abs(F.col("__filled") - F.col("__true"))), 4).alias("mean_error"))
        out = part if out is None else out.unionByName(part)
    return out
