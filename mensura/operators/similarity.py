"""Tanimoto between bit sets: query set against all, nearest neighbour, range join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.functions.batches import packed, runs, unpack
from mensura.functions.fingerprint import N_BITS, code, positions, tanimoto
from mensura.functions.keys import molecule_key
from mensura.session import cut


def first_sets(vectors: DataFrame, key: str = "inchikey") -> DataFrame:
    """(key, set_id, pos, n_on): the first non-empty vector of every key, numbered by its vec_id."""
    own = vectors.select(molecule_key(key).alias(key), "vec_id", positions().alias("pos")).filter(f"{key} is not null and size(pos) > 0")
    return own.groupBy(key).agg(F.min("vec_id").alias("set_id"), F.min_by("pos", "vec_id").alias("pos")).withColumn("n_on", F.size("pos"))


def sign_bits(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, pos, n_on): positions of the positive components."""
    pos = F.filter(F.transform(vector, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return embeddings.select("vec_id", "label", pos.alias("pos")).withColumn("n_on", F.size("pos"))


def query_pairs(queries: DataFrame, all_sets: DataFrame, id_col: str = "set_id") -> DataFrame:
    """(a, b, similarity) of every query with every set it shares a position with, itself left out.

    An equi-join on positions with a count; pairs that share nothing have similarity 0 and no row.
    """
    q = queries.select(F.col(id_col).alias("a"), F.col("n_on").alias("na"), F.explode("pos").alias("p"))
    s = all_sets.select(F.col(id_col).alias("b"), F.col("n_on").alias("nb"), F.explode("pos").alias("p"))
    met = q.join(s, "p").filter("a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return met.select("a", "b", tanimoto(F.col("shared"), F.col("na"), F.col("nb")).alias("similarity"))


class Postings:
    """Bit sets by position, to count what a query shares with all of them at once: only the sets that have one of its positions are looked at."""

    def __init__(self, codes: list[bytes]):
        flat, offsets = unpack(codes)
        n = np.diff(offsets)
        self.order = np.argsort(n, kind="stable")  # by size, so that the best of every size is one slice's largest count
        self.place = np.empty(len(n), dtype=np.int64)
        self.place[self.order] = np.arange(len(n))
        self.size, self.start = np.unique(n[self.order], return_index=True)
        self.at = np.searchsorted(flat, np.arange(N_BITS + 1), sorter=(by := np.argsort(flat, kind="stable")))
        self.sets = np.repeat(self.place, n)[by]

    def best(self, own: np.ndarray, leave: int | None = None) -> float:
        """Similarity of the positions ``own`` to the most similar set; the set number ``leave`` does not count."""
        if not len(own):
            return 0.0
        shared = np.bincount(np.concatenate([self.sets[self.at[p] : self.at[p + 1]] for p in own]), minlength=len(self.place))
        if leave is not None:
            shared[self.place[leave]] = 0
        most = np.maximum.reduceat(shared, self.start)
        return float((most / (len(own) + self.size - most)).max())


def nearest(queries: DataFrame, all_sets: DataFrame, by: list[str], block: int = 32_768, id_col: str | None = None) -> DataFrame:
    """(by, a, nn): exact similarity of each query to the most similar set of its ``by`` group, 0 if it shares nothing or there is none.

    ``queries`` has by, a, pos; ``all_sets`` has by, pos (copies are folded first). The query set is
    compared with all sets in blocks: every pair of blocks (a quarter of ``block`` queries, ``block`` sets)
    is one task of bounded size, which counts shared positions in posting lists. With ``id_col``,
    the sets' id, a query is not compared with the set of its own id; copies under other ids count.
    """
    q = queries.select(*by, "a", code("pos").alias("code"))
    if id_col is None:
        s = all_sets.select(*by, code("pos").alias("code")).distinct().withColumn("only", F.lit(None).cast(dict(queries.dtypes)["a"]))
    else:
        ids = all_sets.select(*by, code("pos").alias("code"), F.col(id_col).alias("id")).groupBy(*by, "code").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        s = ids.select(*by, "code", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only"))  # the id of a set that has no copy
    sizes = q.groupBy(*by).agg(F.ceil(F.count("*") / max(1, block // 4)).cast("int").alias("qn"))
    sizes = sizes.join(s.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("sn")), by, "left").withColumn("sn", F.coalesce("sn", F.lit(0)))
    ids = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    left = q.join(sizes.filter("sn > 0"), by).withColumn("qb", F.pmod(F.xxhash64("a"), F.col("qn")).cast("int")).withColumn("sb", F.explode(ids("sn"))).select(*by, "qb", "sb", "a", "code")
    right = s.join(sizes, by).withColumn("sb", F.pmod(F.xxhash64("code"), F.greatest(F.col("sn"), F.lit(1))).cast("int")).withColumn("qb", F.explode(ids("qn"))).select(*by, "qb", "sb", "code", F.col("only").cast("string")).toDF(*[f"s_{c}" for c in by], "s_qb", "s_sb", "code", "only")

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best = np.zeros(len(a))
        if len(a) and len(b):
            postings = Postings([bytes(c) for c in b["code"]])
            flat, offsets = unpack([bytes(c) for c in a["code"]])
            column = {i: j for j, i in enumerate(b["only"]) if i is not None}
            for r, i in enumerate(map(str, a["a"])):
                best[r] = postings.best(flat[offsets[r] : offsets[r + 1]], column.get(i))
        out = pd.DataFrame({"a": a["a"].to_numpy(), "nn": best})
        for name, value in reversed(list(zip(by, key))):
            out.insert(0, name, value)
        return out

    kinds = dict(queries.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"a {kinds['a']}", "nn double"])
    met = left.groupBy(*by, "qb", "sb").cogroup(right.groupBy(*[f"s_{c}" for c in by], "s_qb", "s_sb")).applyInPandas(run, schema)
    best = met.groupBy(*by, "a").agg(F.max("nn").alias("nn"))
    return queries.select(*by, "a").join(best, [*by, "a"], "left").select(*by, "a", F.coalesce("nn", F.lit(0.0)).alias("nn"))


def _least_shared(least: float, sizes: np.ndarray | int) -> np.ndarray:
    """How many positions two sets of so many together share at least if their similarity is ``least``."""
    return np.maximum(np.ceil(least / (1 + least) * np.asarray(sizes) - 1e-9), 1).astype(np.int64)


def _blocks_of(left: np.ndarray, count: np.ndarray, most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, partner): every entry with the ``count`` entries behind it, in pieces of about ``most`` pairs."""
    total = np.cumsum(count)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        own = count[at:to]
        entry = np.repeat(left[at:to], own)
        yield entry, entry + 1 + np.arange(len(entry)) - np.repeat(np.cumsum(own) - own, own)
        at = to


def _candidates(token: int, flat: np.ndarray, offsets: np.ndarray, n: np.ndarray, block: np.ndarray, lo: int, hi: int, fold: np.ndarray, least: float) -> np.ndarray:
    """(left, right) rows, each pair once: those that share ``token`` and a second position early enough, and whose folded bits do not rule them out.

    Rows are in order of size. Only the larger set of a pair may have the second position as late as the least similar partner would allow it.
    """
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - offsets[row]
    slack = n[row] - place  # positions from here on
    first = np.zeros(len(n), dtype=np.int64)
    first[row[flat == token]] = place[flat == token]
    entry = np.flatnonzero((place > first[row]) & (slack >= np.ceil(least * n - 1e-9).astype(np.int64)[row] - 1))
    entry = entry[np.argsort(flat[entry], kind="stable")]  # by second position, then size
    second, row, slack = flat[entry], row[entry], slack[entry]
    order = second.astype(np.int64) * (2 * N_BITS) + n[row]
    behind = np.searchsorted(order, second.astype(np.int64) * (2 * N_BITS) + np.minimum(np.floor(n[row] / least + 1e-9).astype(np.int64), 2 * N_BITS - 1), "right") - np.arange(len(entry)) - 1
    needed = _least_shared(least, np.arange(2 * N_BITS + 1))
    left = np.flatnonzero((slack >= needed[2 * n[row]] - 1) & (behind > 0))
    found = [np.zeros(0, dtype=np.int64)]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        if lo != hi:
            cross = block[a] != block[b]
            a, b = a[cross], b[cross]
        at_most = n[a] - np.bitwise_count(fold[a] & ~fold[b]).sum(1, dtype=np.int64)
        meet = at_most >= needed[n[a] + n[b]]
        found.append(a[meet] * len(n) + b[meet])

    for x, y in _blocks_of(left, behind[left]):
        a, b = row[x], row[y]
        early = np.minimum(slack[x], slack[y]) >= needed[n[a] + n[b]] - 1
        keep(a[early], b[early])
    few = np.flatnonzero(n <= 1 / least + 1e-9)  # of these two may need to share no second position
    for x, y in _blocks_of(np.arange(len(few)), len(few) - 1 - np.arange(len(few))):
        alone = needed[n[few[x]] + n[few[y]]] == 1
        keep(few[x[alone]], few[y[alone]])
    return np.unique(np.concatenate(found))


def _compare(least: float):
    """Pairs of a token's block pair; a pair comes out only where the token is the first that the two sets share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["token", "lo", "hi"]):
            token, lo, hi = (int(g[c].iloc[0]) for c in ("token", "lo", "hi"))
            codes = g["code"].to_numpy()
            by_size = np.argsort(np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)), kind="stable")
            flat, offsets = unpack([bytes(c) for c in codes[by_size]])
            bits, n = packed(flat, offsets)
            ids, block = g["id"].to_numpy()[by_size], g["block"].to_numpy()[by_size]
            fold = np.bitwise_or.reduce(bits.reshape(len(n), -1, 4), axis=1)
            before = np.packbits(np.arange(N_BITS) < token).view(np.uint64)
            pairs = _candidates(token, flat, offsets, n, block, lo, hi, fold, least)
            for i in range(0, len(pairs), 65_536):
                r, c = pairs[i : i + 65_536] // len(n), pairs[i : i + 65_536] % len(n)
                both = bits[r] & bits[c]
                first = ~(both[:, : token // 64 + 1] & before[: token // 64 + 1]).any(1)
                r, c, both = r[first], c[first], np.bitwise_count(both[first]).sum(1, dtype=np.int64)
                s = both / (n[r] + n[c] - both)
                near = s >= least
                a, b = ids[r[near]], ids[c[near]]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s[near]})

    return run


def range_join(sets: DataFrame, least: float, id_col: str = "set_id", block: int = 16_384) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of sets of similarity ``least`` or more, exactly, each once.

    Prefix filter of two positions: with the positions numbered rarest first, two such sets of n and m
    share k = ceil(least * (n + m) / (1 + least)) positions, and the first two of them (k > 1) lie within
    the first n - k + 2 and m - k + 2. The sets that have a position in their prefix meet in one task;
    there, those that share a second one are compared. A position with more than ``block`` of them is cut
    into pairs of blocks. Only pairs that reach ``least`` leave the task, from the first position they
    share. ``least`` must be above 0, ids are numbers, sets not empty; copies should be folded before.
    The table of position counts has N_BITS rows at most.
    """
    counts = sets.select(F.explode("pos").alias("p")).groupBy("p").agg(F.count("*").alias("c")).collect()  # N_BITS rows
    rank = [0] * N_BITS
    for r, (p, _) in enumerate(sorted(((x["p"], x["c"]) for x in counts), key=lambda x: (x[1], x[0]))):
        rank[p] = r
    ranks = F.split(F.lit(",".join(map(str, rank))), ",").cast("array<int>")  # one constant
    coded = cut(sets.select(F.col(id_col).alias("id"), F.sort_array(F.transform("pos", lambda p: F.element_at(ranks, p + 1))).alias("ranks")).select("id", "ranks", code("ranks").alias("code")))
    prefix = F.size("ranks") - F.ceil(F.lit(least) * F.size("ranks") - 1e-9) + 2
    rows = coded.select("id", "code", F.explode(F.slice("ranks", F.lit(1), prefix.cast("int"))).alias("token"))
    sizes = cut(rows.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    placed = rows.join(F.broadcast(sizes), "token").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))  # N_BITS rows
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "code")
    parts = max(4 * sets.sparkSession.sparkContext.defaultParallelism, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = spread.repartition(parts, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return met.mapInPandas(_compare(least), "a bigint, b bigint, similarity double")
