"""Train, validation and test splits that keep related records together, balanced by largest differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions.keys import present
from mensura.operators.components import connected_components
from mensura.session import cut

PROPORTIONS = {"train": 0.8, "valid": 0.1, "test": 0.1}


def related_groups(records: DataFrame, keys: list[Column], id_col: str = "rec_id") -> DataFrame:
    """(id, group_id, alone): records that share a value of any of ``keys``, also through other records; group_id is the smallest id, ``alone`` says that a record has no key.

    Null keys relate nothing; rows with a null id are left out. Every value is first replaced by the smallest id that has it, so the graph
    has one edge per distinct pair of values and not one per pair of records; a value that a third of
    all records share is one node.
    """
    again = cut(records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    base = again.groupBy("id").agg(*[F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))])
    for i in range(len(keys)):
        named = again.filter(F.col(f"k{i}").isNotNull()).groupBy(f"k{i}").agg(F.min("id").alias(f"h{i}"))
        base = base.join(named, f"k{i}", "left")
    base = cut(base.select("id", *[f"h{i}" for i in range(len(keys))]))
    heads = [f"h{i}" for i in range(len(keys))]
    # an id with several values of one key (repeated rows) ties them together as well
    extra = None
    for i in range(len(keys)):
        several = again.groupBy("id").agg(F.min(f"k{i}").alias("a"), F.max(f"k{i}").alias("b")).filter("a <> b")
        values = again.filter(F.col(f"k{i}").isNotNull()).groupBy(F.col(f"k{i}").alias("v")).agg(F.min("id").alias("h"))
        tie = again.select("id", F.col(f"k{i}").alias("v")).join(several.select("id"), "id", "left_semi").join(values, "v").select(F.col("id").alias("a"), F.col("h").alias("b"))
        extra = tie if extra is None else extra.union(tie)
    edges = None
    for h in heads:
        pair = base.select(F.coalesce(*heads).alias("a"), F.col(h).alias("b")).filter("a <> b")
        edges = pair if edges is None else edges.union(pair)
    edges = edges.distinct()
    edges = edges.union(extra) if extra is not None else edges
    labels = connected_components(edges)
    first = base.withColumn("node", F.coalesce(*heads, F.col("id")))
    return first.join(labels, "node", "left").select("id", F.coalesce("component", "node").alias("group_id"), F.coalesce(*heads).isNull().alias("alone"))


def _difference(groups: list[tuple[int, list[tuple[int, list]]]], bins: int) -> list[tuple[int, list]]:
    """Largest differencing (Karmarkar and Karp) with ``bins`` ways.

    Each entry is a tuple of ``bins`` subset sums with what lies in them. The two entries with the
    largest spread are combined, the heaviest subset of one with the lightest of the other, until one is left.
    """
    heap = []
    for n, parts in enumerate(groups):
        parts = sorted(parts, key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
    n = len(groups)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
        n += 1
    return heap[0][2] if heap else [(0, []) for _ in range(bins)]


def _combine(bins: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entries = []
        for _, own in pdf.groupby("entry", sort=True):
            parts = [(int(w), [(e, s)]) for w, e, s in zip(own["weight"], own["entry"], own["slot"])]
            entries.append((0, parts + [(0, [])] * (bins - len(parts))))
        result = _difference([p for _, p in entries], bins)
        rows = [(key[0], slot, w, e, s) for slot, (w, held) in enumerate(result) for e, s in (held or [(None, None)])]
        return pd.DataFrame(rows, columns=["parent", "slot", "weight", "entry", "from_slot"]).astype({"entry": "Int64", "from_slot": "Int64"})

    return run


def balanced_bins(weights: DataFrame, bins: int = 100, shard: int = 4000, fan_in: int = 32) -> tuple[DataFrame, DataFrame]:
    """(group_id -> stratum, slot; stratum, slot -> weight): groups in ``bins`` bins of nearly equal weight a stratum.

    ``weights`` has group_id, weight and stratum (a small number). The groups of a stratum are dealt by
    hash to shards of about ``shard``; each shard is differenced to one tuple of ``bins`` sums, and the
    tuples of ``fan_in`` shards are differenced again, level by level, until one a stratum is left. No
    task ever sees more than a shard or fan_in tuples.
    """
    out = "parent bigint, slot int, weight bigint, entry bigint, from_slot bigint"
    strata = 1 + (weights.agg(F.max("stratum")).first()[0] or 0)
    shards = max(1, -(-weights.count() // shard))
    at = lambda shard_no: shard_no * strata + F.col("stratum")
    level = weights.select(at(F.pmod(F.xxhash64("group_id"), F.lit(shards))).alias("parent"), F.col("group_id").alias("entry"), F.lit(0).alias("slot"), "weight")
    done = cut(level.groupBy("parent").applyInPandas(_combine(bins), out))
    placed = done.filter("entry is not null").select(F.col("entry").alias("group_id"), F.col("parent").alias("at"), "slot")
    while shards > 1:
        sums = done.select("parent", "slot", "weight", F.pmod("parent", F.lit(strata)).alias("stratum")).distinct()
        shards = -(-shards // fan_in)
        level = sums.select(at(F.pmod(F.floor(F.col("parent") / strata), F.lit(shards))).alias("up"), F.col("parent").alias("entry"), "slot", "weight").withColumnRenamed("up", "parent")
        done = cut(level.groupBy("parent").applyInPandas(_combine(bins), out))
        moved = done.filter("entry is not null").select(F.col("entry").alias("at"), F.col("from_slot").cast("int").alias("slot"), F.col("parent").alias("up"), F.col("slot").alias("to"))
        placed = placed.join(moved, ["at", "slot"]).select("group_id", F.col("up").alias("at"), F.col("to").alias("slot"))
    return placed.select("group_id", F.col("at").cast("int").alias("stratum"), "slot"), done.select(F.col("parent").cast("int").alias("stratum"), "slot", "weight").distinct()


def allot(bins: list[tuple[int, int]], proportions: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits by target proportion.

    Heaviest first, a bin goes to the split that lacks the largest share of its own target among those
    that still have room for it (so the small splits get of the heavy bins what they can hold); if none
    has, to the one that lacks most. A split that would end up empty gets the lightest bin of the split
    that has most to spare, if there are as many filled bins as splits.
    """
    total = sum(w for _, w in bins) or 1
    target = {s: p * total for s, p in proportions.items()}
    lack = dict(target)
    out: dict[int, str] = {}
    weight = dict(bins)
    for slot, w in sorted(bins, key=lambda x: (-x[1], x[0])):
        room = [s for s in lack if lack[s] >= w]
        s = max(room, key=lambda k: (lack[k] / target[k], target[k])) if room else max(lack, key=lambda k: (lack[k], target[k]))
        out[slot] = s
        lack[s] -= w
    filled = [slot for slot, w in bins if w]
    for s in sorted(target, key=lambda k: target[k]):
        if len(filled) >= len(target) and not any(out[x] == s for x in filled):
            rich = [x for x in filled if sum(out[y] == out[x] for y in filled) > 1]
            x = min(rich, key=lambda x: (weight[x], x))
            out[x] = s
    return out


def assign_splits(records: DataFrame, keys: list[Column], id_col: str = "rec_id", proportions: dict[str, float] | None = None, bins: int = 100) -> DataFrame:
    """(id, group_id, group_size, split): all records, each related group whole in one split.

    Groups are the connected components over ``keys`` (see ``related_groups``); a record with no key at
    all is its own group. Component weights are balanced into ``bins`` bins by largest differencing and
    whole bins are allotted to the splits. Records with a key and records without are balanced and
    allotted apart, so that both stand in the asked proportions: few groups with a key are not crowded
    out of the small splits by many single records. A group heavier than a bin makes its bin heavier,
    and a group heavier than a split's share makes that split larger than asked, as it must. Empty
    tables give no rows.
    """
    proportions = proportions or PROPORTIONS
    groups = cut(related_groups(records, keys, id_col))
    weights = cut(groups.groupBy("group_id").agg(F.count("*").alias("weight"), F.when(F.min("alone"), 1).otherwise(0).alias("stratum")))
    slots, loads = balanced_bins(weights, bins)
    rows = loads.collect()  # ``bins`` rows a stratum
    to = {(t, slot): s for t in {r["stratum"] for r in rows} for slot, s in allot([(r["slot"], r["weight"]) for r in rows if r["stratum"] == t], proportions).items()}
    side = F.create_map(*[F.lit(x) for (t, slot), s in to.items() for x in (t * bins + slot, s)]) if to else F.create_map().cast("map<int,string>")
    placed = weights.drop("stratum").join(slots, "group_id").select("group_id", F.col("weight").alias("group_size"), side[F.col("stratum") * bins + F.col("slot")].alias("split"))
    return groups.drop("alone").join(placed, "group_id").select("id", "group_id", "group_size", "split")


def scaffold_key(c: str = "scaffold") -> Column:
    """Scaffold without outer blanks; empty and 'NA' is none."""
    return present(c)
