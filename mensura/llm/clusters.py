"""Groups of mutually similar vectors by power-iteration spectral clustering on a sparse affinity graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.functions.batches import packed, pair_similarities, pairs_within, unpack, whole
from mensura.functions.fingerprint import N_BITS, code, positions
from mensura.operators.components import connected_components
from mensura.session import cut

#: Vectors that are iterated; equal limits of two groups in all of them are as good as impossible.
DIMS = 4
VS = [f"v{i}" for i in range(DIMS)]
#: Largest difference between linked nodes at which the vectors count as settled, and the width of the cells that settled points are told apart by.
SETTLED, CELL = 1e-9, 1e-6


def _signatures(bands: int, rows: int):
    """Band keys of each set: sets of equal key share ``rows`` min-hashes."""
    rng = np.random.default_rng(20240501)
    ranks = np.argsort(rng.random((bands * rows, N_BITS)), axis=1).astype(np.uint16)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            flat, offsets = unpack([bytes(c) for c in pdf["code"]])
            low = np.minimum.reduceat(ranks[:, flat], offsets[:-1], axis=1).astype(np.uint64)  # sets are not empty
            key = np.zeros((bands, len(pdf)), dtype=np.uint64)
            for r in range(rows):
                key = key * np.uint64(N_BITS) + low[r::rows]
            key = key * np.uint64(bands) + np.arange(bands, dtype=np.uint64)[:, None]
            yield pd.DataFrame({"set_id": pdf["set_id"], "code": pdf["code"], "bands": list(key.T.view(np.int64))})

    return run


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which links belong to a maximum spanning forest (Boruvka's rounds, all groups of a batch at once)."""
    keep = np.zeros(len(a), dtype=bool)
    label = np.arange(n)
    alive = np.argsort(-weight, kind="stable")  # a link's place in this order is its rank: no two are equal
    while True:
        la, lb = label[a[alive]], label[b[alive]]
        apart = la != lb
        alive, la, lb = alive[apart], la[apart], lb[apart]
        if not len(alive):
            return keep
        best = np.full(n, len(alive))
        place = np.arange(len(alive))
        np.minimum.at(best, la, place)
        np.minimum.at(best, lb, place)
        own = np.flatnonzero(best < len(alive))
        keep[alive[best[own]]] = True
        to = np.arange(n)
        to[own] = la[best[own]] + lb[best[own]] - own  # the label at the link's other end
        both = to[to] == np.arange(n)
        to[both] = np.minimum(to[both], np.flatnonzero(both))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _links(least: float, strongest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in whole(batches, ["band", "lo", "hi"]):
            ids, block, two = rows["set_id"].to_numpy(), rows["block"].to_numpy(), (rows["lo"] != rows["hi"]).to_numpy()
            bits, n = packed(*unpack([bytes(c) for c in rows["code"]]))
            found = []
            for left, right in pairs_within(bounds):
                meet = ~two[left] | (block[left] != block[right])
                left, right = left[meet], right[meet]
                s = pair_similarities(bits, n, bits, n, left, right)
                near = s >= least
                found.append((left[near], right[near], s[near]))
            a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3
            if not len(a):
                continue
            end, other, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
            order = np.lexsort((ids[other], -w, end))
            nth = np.empty(len(order), dtype=np.int64)
            nth[order] = np.arange(len(order)) - np.searchsorted(end[order], end[order])
            keep = (nth[: len(a)] < strongest) | (nth[len(a) :] < strongest) | spanning(len(rows), a, b, s)
            a, b, s = ids[a[keep]], ids[b[keep]], s[keep]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "w": s}).drop_duplicates()

    return run


def _block_pairs(rows: DataFrame, by: str, block: int) -> DataFrame:
    """``rows`` (by, set_id, ..) sorted into one run for every pair of blocks (lo, hi) of a ``by``; one block where that has ``block`` rows at most."""
    hot = cut(rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1"))
    if hot.isEmpty():
        spread = rows.withColumns({"block": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    else:
        placed = rows.join(hot, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
        spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    return spread.repartition(by, "lo", "hi").sortWithinPartitions(by, "lo", "hi")


def affinities(sets: DataFrame, least: float = 0.65, bands: int = 32, rows: int = 4, strongest: int = 8, block: int = 1024) -> DataFrame:
    """(a, b, w), a < b: sparse affinities of the distinct sets - each vector's strongest links and what else joins groups.

    Candidates share one of ``bands`` keys of ``rows`` min-hashes; a pair of similarity 0.7 is missed
    with probability 2e-4, one of 0.65 with 2e-3, before its other links are counted. Signatures are
    computed once. All sets of one key are compared with each other: a key with more than ``block`` sets
    is cut into blocks, and every pair of blocks is one run of bounded size. Of a run the ``strongest``
    links of each vector and a maximum spanning forest are kept: no link between groups is lost to the
    thinning, and rankings inside a group are made over all its links (see ``describe``).
    """
    signed = cut(sets.select("set_id", "code").mapInPandas(_signatures(bands, rows), "set_id bigint, code binary, bands array<bigint>"))
    keyed = signed.select(F.explode("bands").alias("band"), "set_id", "code")
    pairs = _block_pairs(keyed, "band", block).mapInPandas(_links(least, strongest), "a bigint, b bigint, w double")
    return pairs.groupBy("a", "b").agg(F.max("w").alias("w"))


def _uniform(i: int):
    """A start value in [0, 1) out of the id alone, the same on every machine."""
    return F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1_000_003)) / 1_000_003.0


def _graph(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions with self loops of weight 1, kept by dst: a round moves the vectors and not the links."""
    loops = edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct().select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(1.0).alias("w"))
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(edges.select("b", "a", "w")).union(loops)
    return _by_dst(both)


def _by_dst(graph: DataFrame) -> DataFrame:
    return graph.repartition(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dst").persist()


def _start(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("src").alias("node")).distinct().select("node", *[_uniform(i).alias(v) for i, v in enumerate(VS)])


def multiply(graph: DataFrame, v: DataFrame) -> DataFrame:
    """The vectors times the degree-normalised affinities; ``spread`` is the largest difference that a node met among the old values."""
    met = graph.join(v.select(F.col("node").alias("dst"), *VS).hint("shuffle_hash"), "dst")
    spread = F.greatest(*[F.max(x) - F.min(x) for x in VS])
    return met.groupBy(F.col("src").alias("node")).agg(*[(F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias(x) for x in VS], spread.alias("spread"))


def _summits(graph: DataFrame) -> DataFrame:
    """(node, to): every node follows its neighbour of greatest degree (then smaller id) up to one that none exceeds."""
    degree = graph.groupBy(F.col("src").alias("dst")).agg(F.round(F.sum("w"), 9).alias("d"))
    up = cut(graph.join(degree.hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("node")).agg(F.max_by("dst", F.struct("d", -F.col("dst"))).alias("to")))
    while True:  # halves the way to the top each time
        nxt = cut(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("top")), "to").select("node", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")))
        up = nxt.select("node", "to")
        if nxt.filter("moved").isEmpty():
            return up


def settle(graph: DataFrame, rounds: int = 12) -> DataFrame:
    """(node, v0..): random vectors multiplied with the normalised affinities until linked nodes differ by less than ``SETTLED``.

    The limit is constant on every group and is the degree-weighted mean of the group's start values. A
    group that has not settled after ``rounds`` multiplications (a long chain) is iterated on with its
    nodes drawn together around the nodes of greatest degree: affinities add up and the vectors become
    degree-weighted means, which leaves the limit as it is, and each such step at least halves the nodes
    that have links.
    """
    v, steps = _start(graph), []
    while True:
        for _ in range(rounds):
            v = cut(multiply(graph, v))
            worst = v.agg(F.max("spread")).first()[0]
            if worst is None or worst <= SETTLED:
                for up in reversed(steps):
                    v = up.join(v.withColumnRenamed("node", "to"), "to").select("node", *VS)
                return v.select("node", *VS)
        up = _summits(graph)
        degree = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"))
        weighed = v.join(degree, "node").join(up, "node").groupBy(F.col("to").alias("node"))
        v = cut(weighed.agg(*[(F.sum(F.col("d") * F.col(x)) / F.sum("d")).alias(x) for x in VS]))
        ends = graph.join(up.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(up.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
        coarse = cut(ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        graph.unpersist()
        graph = _by_dst(coarse)
        steps.append(up)


def spectral_groups(edges: DataFrame, embedding: DataFrame | None = None) -> DataFrame:
    """(node, cluster) of every node with a link: k-means of the settled vectors; cluster is the smallest node.

    The settled vectors have as many different points as there are groups, so the occupied cells of a
    grid of width ``CELL`` are the means' seeds, and a point's nearest mean is its own cell's. Means of
    linked nodes that lie nearer than a cell (a point on the border of two cells) are one mean. Nothing
    else joins nodes: what the iteration has not brought together stays apart. ``embedding`` replaces
    the settled vectors (for tests).
    """
    graph = _graph(cut(edges))
    point = settle(graph) if embedding is None else embedding
    placed = cut(point.select("node", *VS, F.struct(*[F.floor(F.col(x) / CELL).alias(x) for x in VS]).alias("cell")))
    means = cut(placed.groupBy("cell").agg(F.min("node").alias("first"), *[F.avg(x).alias(x) for x in VS]))
    near = graph.join(placed.select(F.col("node").alias("dst"), "cell").hint("shuffle_hash"), "dst").groupBy("src").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.max(F.when(F.col("src") == F.col("dst"), F.col("cell"))).alias("own"))
    borders = cut(near.filter("lo <> hi").select(F.explode(F.array("lo", "hi")).alias("cell"), "own").filter("cell <> own").distinct())
    graph.unpersist()
    if borders.isEmpty():
        return placed.join(means.select("cell", F.col("first").alias("cluster")), "cell").select("node", "cluster")
    a, b = (means.select(F.col("cell").alias(c), F.col("first").alias(f), F.array(*VS).alias(f"{f}_at")) for c, f in (("cell", "a"), ("own", "b")))
    gap = F.array_max(F.zip_with("a_at", "b_at", lambda x, y: F.abs(x - y)))
    one = connected_components(borders.join(a, "cell").join(b, "own").filter(gap < CELL).select("a", "b"))
    named = means.join(one.withColumnRenamed("node", "first"), "first", "left").select("cell", F.coalesce("component", "first").alias("cluster"))
    return placed.join(named, "cell").select("node", "cluster")


def spectral_clusters(edges: DataFrame, rounds: int = 6, kmeans_rounds: int = 3, close: float = 0.02) -> DataFrame:
    """(node, cluster) of every node with a link: k-means on vectors that have not settled, which parts what hangs together by few links.

    After ``rounds`` multiplications the vectors are nearly constant where affinities are dense and still
    differ across bottlenecks (power iteration clustering). Nodes of greatest degree among the neighbours
    that lie within ``close`` of them in every vector seed the means; each node moves to the nearest of
    the means that it and its neighbours belong to, and the means are averaged again. Linked clusters
    whose means differ by less than ``close`` in every vector are one. cluster is the smallest node.
    """
    graph = _graph(cut(edges))
    point = _start(graph)
    for r in range(rounds):
        point = multiply(graph, point)
        point = cut(point) if r % 2 or r == rounds - 1 else point
    here, there = (point.select(F.col("node").alias(end), F.array(*VS).alias(f"{end}_at")) for end in ("src", "dst"))
    nearby = F.array_max(F.zip_with("src_at", "dst_at", lambda x, y: F.abs(x - y))) < close
    tight = cut(graph.join(there.hint("shuffle_hash"), "dst").join(here, "src").filter(nearby).select("src", "dst", "w"))
    label = _summits(tight).select("node", F.col("to").alias("cluster"))
    offered = lambda: graph.join(label.withColumnRenamed("node", "dst").hint("shuffle_hash"), "dst").select(F.col("src").alias("node"), "cluster").distinct()
    centred = lambda: label.join(point, "node").groupBy("cluster").agg(*[F.avg(v).alias(f"c{v}") for v in VS])
    for _ in range(kmeans_rounds):
        gap = sum(((F.col(v) - F.col(f"c{v}")) * (F.col(v) - F.col(f"c{v}")) for v in VS), F.lit(0.0))
        label = cut(offered().join(centred(), "cluster").join(point, "node").groupBy("node").agg(F.min_by("cluster", F.struct(F.round(gap, 12), "cluster")).alias("cluster")))
    means = cut(centred())
    touch = offered().join(label.withColumnRenamed("cluster", "own"), "node").filter("cluster <> own").select("cluster", "own").distinct()
    other = means.select(F.col("cluster").alias("own"), *[F.col(f"c{v}").alias(f"o{v}") for v in VS])
    pairs = touch.join(means, "cluster").join(other, "own").filter(F.greatest(*[F.abs(F.col(f"c{v}") - F.col(f"o{v}")) for v in VS]) < close)
    one = connected_components(pairs.select(F.col("cluster").alias("a"), F.col("own").alias("b"))).withColumnRenamed("node", "cluster")
    graph.unpersist()
    merged = label.join(one, "cluster", "left").select("node", F.coalesce("component", "cluster").alias("cluster"))
    first = merged.groupBy("cluster").agg(F.min("node").alias("first"))
    return cut(merged.join(first, "cluster").select("node", F.col("first").alias("cluster")))


def similar_groups(vectors: DataFrame, least: float = 0.65, id_col: str = "vec_id", apart: bool = False) -> DataFrame:
    """(vec, set_id, copies, cluster, code) of all vectors with a non-empty set.

    cluster is the smallest id of the group: all that affinities of ``least`` or more hold together, or
    with ``apart`` only what they hold together densely (see ``spectral_clusters``). Equal sets are
    clustered once and share a cluster. Empty and missing sets belong to no group; null ids are left out.
    """
    own = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec"), code(positions()).alias("code")).filter(F.length("code") > 0).distinct()
    sets = cut(own.groupBy("code").agg(F.min("vec").alias("set_id"), F.count("*").alias("copies")))
    edges = affinities(sets, least)
    groups = spectral_clusters(edges) if apart else spectral_groups(edges)
    of = own.join(sets, "code").join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
    return of.select("vec", "set_id", "copies", F.coalesce("cluster", "set_id").alias("cluster"), "code")


def _sums(least: float):
    """Each set's affinities to the other sets of its cluster that it meets in a pair of blocks, summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in whole(batches, ["cluster", "lo", "hi"]):
            ids, copies, block, two = rows["set_id"].to_numpy(), rows["copies"].to_numpy(dtype=float), rows["block"].to_numpy(), (rows["lo"] != rows["hi"]).to_numpy()
            bits, n = packed(*unpack([bytes(c) for c in rows["code"]]))
            total = np.zeros(len(rows))
            for left, right in pairs_within(bounds):
                meet = ~two[left] | (block[left] != block[right])
                left, right = left[meet], right[meet]
                s = pair_similarities(bits, n, bits, n, left, right)
                s[s < least] = 0
                total += np.bincount(left, s * copies[right], len(rows)) + np.bincount(right, s * copies[left], len(rows))
            yield pd.DataFrame({"set_id": ids, "affinity": total})

    return run


def describe(members: DataFrame, typical: int = 3, least: float = 0.65, block: int = 1024) -> DataFrame:
    """(cluster, size, typical): each group with its size and its members of highest affinity inside it, best first.

    A member's affinity is the sum over all links of ``least`` or more to the vectors of its cluster,
    each once, by pairs of blocks of the cluster's sets (of ties the smaller id goes first).
    """
    label = cut(members.select("set_id", "cluster", "copies", "code").dropDuplicates(["set_id"]))
    inner = _block_pairs(label, "cluster", block).mapInPandas(_sums(least), "set_id bigint, affinity double").groupBy("set_id").agg(F.sum("affinity").alias("affinity"))
    scored = label.join(inner, "set_id", "left").withColumn("affinity", F.coalesce("affinity", F.lit(0.0)) + F.col("copies") - 1)
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.round("affinity", 9)), "set_id"))
    top = scored.withColumn("place", place).filter(F.col("place") <= typical).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "set_id"))), lambda x: x["set_id"]).alias("typical"))
    return label.groupBy("cluster").agg(F.sum("copies").alias("size")).join(top, "cluster")
