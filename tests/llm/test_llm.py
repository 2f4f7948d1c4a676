"""Numbered operators against brute force, on small inputs with every kind of odd row."""

import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import rows  # noqa: E402

from mensura.llm import clusters, fusion, leakage, neighbours, overlap, packing, quality, splits  # noqa: E402


def tanimoto(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def sets_of(n, seed, core=8, size=40):
    rng = np.random.default_rng(seed)
    cores = [rng.choice(2048, size, replace=False).tolist() for _ in range(core)]
    out = []
    for _ in range(n):
        s = set(cores[rng.integers(core)])
        for x in rng.choice(sorted(s), rng.integers(0, 5), replace=False):
            s.discard(int(x))
        out.append(frozenset(int(x) for x in s | set(rng.choice(2048, rng.integers(0, 4)).tolist())))
    return out


def vectors(spark, sets):
    """With copies, empty and missing vectors, text instead of positions, and columns of clashing names."""
    data = [(i, f"K{i}", None if i % 5 == 0 else [int(x) for x in s], " ".join(map(str, s)) if i % 5 == 0 else None, "x", 1) for i, s in enumerate(sets)]
    n = len(data)
    data += [(n, "E", [], None, "x", 1), (n + 1, "F", None, None, "x", 1), (None, None, [1, 2], None, None, None)]
    return spark.createDataFrame(data, "vec_id long, inchikey string, bits array<int>, bits_text string, code string, set_id int")


def test_neighbours_equal_brute_force(spark):
    sets = sets_of(160, 1)
    sets += [sets[0]] * 9  # more copies than k
    truth = set()
    for i, a in enumerate(sets):
        best = sorted(((-tanimoto(a, b), j) for j, b in enumerate(sets) if j != i and tanimoto(a, b) >= 0.5))[:5]
        truth |= {(min(i, j), max(i, j)) for _, j in best}
    for index in (neighbours.Index(), neighbours.Index(capacity=4)):
        got = {(r["id_a"], r["id_b"]) for r in neighbours.neighbour_pairs(vectors(spark, sets), index=index).collect()}
        assert len(got & truth) >= 0.98 * len(truth) and len(got & truth) >= 0.98 * len(got)
    assert neighbours.neighbour_pairs(vectors(spark, sets).limit(0)).count() == 0


def shuffled_rows(spark):
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_neighbours_move_few_rows(spark):
    """Sets that resemble nothing are posted nowhere, and what goes from a batch to a partition is one row."""
    rng = np.random.default_rng(7)
    sets = sets_of(300, 5) + [frozenset(rng.choice(2048, 40, replace=False).tolist()) for _ in range(2700)]
    before = shuffled_rows(spark)
    got = {(r["id_a"], r["id_b"]) for r in neighbours.neighbour_pairs(vectors(spark, sets)).collect()}
    assert len(got) >= 900 and max(b for _, b in got) < 300
    assert shuffled_rows(spark) - before < 10 * len(sets)


def test_clusters_equal_connected_groups(spark):
    sets = sets_of(120, 2) + [frozenset(range(50)), frozenset(range(50))]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if tanimoto(sets[i], sets[j]) >= 0.65:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    members = clusters.similar_groups(vectors(spark, sets))
    got = {r["vec"]: r["cluster"] for r in members.collect()}
    assert got == {i: find(i) for i in range(len(sets))}
    d = {r["cluster"]: r for r in clusters.describe(members).collect()}
    assert sum(r["size"] for r in d.values()) == len(sets) and all(got[t] == c for c, r in d.items() for t in r["typical"])
    blocked = clusters.affinities(members.limit(0).select("set_id", F.lit(None).cast("binary").alias("code")))
    assert blocked.count() == 0


def test_hot_bands_are_cut_into_blocks(spark):
    core = list(range(100, 160))
    rng = random.Random(3)
    sets = [frozenset(core) - {rng.choice(core)} | {rng.randrange(2048)} for _ in range(90)]
    df = vectors(spark, sets).filter("size(bits) > 0 or bits_text is not null").filter("vec_id is not null")
    from mensura.functions.fingerprint import code, positions

    own = df.select(F.col("vec_id").alias("set_id"), code(positions()).alias("code")).dropDuplicates(["code"])
    e = clusters.affinities(own, block=16)
    g = clusters.spectral_groups(e)
    assert g.select("cluster").distinct().count() == 1 and g.count() == own.count()


def test_pieces_miss_no_near_pair():
    rng = random.Random(4)
    for _ in range(300):
        a = set(rng.sample(range(2048), rng.randint(1, 70)))
        b = set(a)
        for _ in range(rng.randint(0, 6)):
            b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.randrange(2048))
        text = lambda s: overlap.BEGIN + "".join(chr(x + 256) for x in sorted(s)) + overlap.END
        if tanimoto(a, b) >= 0.9:
            assert any(text(a)[i:j] in text(b) for i, j in overlap.pieces(text(a), 0.9))


def test_overlap_exact_near_both_sides_and_unknown(spark):
    base = list(range(0, 400, 10))
    fp = spark.createDataFrame([(1, "K1", base, None, "x"), (2, "inchikey=k2", base[:-1], None, "x"), (3, "K3", base[:30], None, "x"), (4, "K4", [], None, "x")], "vec_id long, inchikey string, bits array<int>, bits_text string, split_name string")
    ct = spark.createDataFrame([(1, "K1", "C", "a"), (2, "K2", "N", "b"), (3, "K3", "O", None), (4, "K4", "P", "a"), (5, " k4", None, "a"), (6, None, "P ", "a"), (7, None, None, "a")], "rec_id long, inchikey string, std_smiles string, source string")
    sm = spark.createDataFrame(
        [("random", 1, "Train"), ("Random ", 2, "validation"), ("random", 3, "test"), ("time", 2, "test"), ("random", 4, "train"), ("random", 5, "test"), ("random", 5, "test"), ("random", 6, "valid"), ("random", 7, "test"), ("random", 7, "train"), ("random", 8, "other"), (None, 1, "test")],
        "split_name string, rec_id long, side string",
    )
    got = overlap.overlapping_records(sm, ct, fp)
    assert rows(got, "split_name", "rec_id", "exact", "near") == [("random", 2, 0, 1), ("random", 5, 1, 0), ("random", 6, 1, 0), ("random", 7, 1, 0)]
    assert all(0 < r["coverage"] <= 1 for r in got.collect())
    assert {r["source"]: (r["exact_dupe_keys"], r["near_dupes"]) for r in overlap.overlap_report(got, sm).collect()} == {"a": (3, 0), "b": (0, 1)}
    assert overlap.overlapping_records(sm.limit(0), ct.limit(0), fp.limit(0)).count() == 0


def test_shards_stay_bounded_when_all_share_a_core(spark):
    """Sets with one core and keys with one first letter: small bounds split what they share, and nothing is lost."""
    sets = [s for s in sets_of(90, 11, core=1, size=45) if len(s) > 8]
    text = lambda s: overlap.BEGIN + "".join(chr(x + 256) for x in sorted(s)) + overlap.END
    keys = [overlap.BEGIN + f"#{i}" + overlap.END for i in range(40)]
    rng = random.Random(12)
    data = {text(s): ([x for x in ("p", "q") if rng.random() < 0.5], [x for x in ("p", "q") if rng.random() < 0.6]) for s in sets}
    data |= {k: (["p"] if i % 2 else [], ["p", "q"] if i % 3 else []) for i, k in enumerate(keys)}
    df = spark.createDataFrame([(t, a, b) for t, (a, b) in data.items()], "text string, train array<string>, held array<string>")
    want = set()
    for t, (_, held) in data.items():
        for u, (train, _) in data.items():
            if t == u or (overlap.is_set(t) and overlap.is_set(u) and tanimoto(set(t[1:-1]), set(u[1:-1])) >= 0.9):
                want |= {(t, x) for x in held if x in train}
    assert len(want) > 60
    for bounds in ({}, {"passages_per_shard": 5, "texts_per_task": 7}):
        got = overlap.covered(df, **bounds)
        assert {(r["text"], r["split_name"]) for r in got.collect()} == want
        assert all(0 < r["coverage"] <= 1 and r["similarity"] >= 0.9 for r in got.collect())
    rarity = np.ones(2048)
    hot = {pair: 3 for t in data if overlap.is_set(t) for _, _, pair in overlap.routed_pieces(t, 0.9, rarity)}
    units = overlap.own_units(hot, 4)
    assert sorted(units.values()) == list(range(4, 4 + 3 * len(hot), 3)) and len({overlap.unit_of(p, str(i), hot, units, 4) for p in hot for i in range(60)}) == 3 * len(hot)


CT = "rec_id long, inchikey string, gene string, endpoint string, std_smiles string, pchembl double, year int, target_chembl_id string, source string, sources string, updated_at timestamp, molecule string"


def record(i, key="K", gene="AA", endpoint="IC50", smiles="CC", p=5.0, year=2010, target="T1", source="A", sources="A", at=None):
    return (i, key, gene, endpoint, smiles, p, year, target, source, sources, at, "clash")


def test_fusion_pairs_and_survivor(spark):
    td = spark.createDataFrame([("T1", "AA", ["a-a"])], "chembl_id string, gene string, synonyms array<string>")
    data = [record(1), record(2, gene=None, target="BDB:T1", endpoint="ic 50", source="B", sources="A; B"), record(3, key="k ", p=float("nan"), year=9999, source="C", sources="B,A"), record(4, p=7.0, source="D", sources=None), record(5, key=None, smiles="CC ", source=None), record(6, endpoint="Ki"), record(7, key="NA", smiles=None), record(1)]
    f = fusion.fuse_records(spark.createDataFrame(data, CT), td)
    assert rows(fusion.duplicate_pairs(f.members)) == [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]
    s = {r["group_id"]: r for r in f.survivors.collect()}
    assert set(s) == {1, 6} and s[1]["n_records"] == 5 and s[1]["pchembl"] == 5.0 and s[1]["year"] == 2010 and s[1]["sources"] in ("a", "a,b")
    assert all(0 < r["sensitivity"] < 1 and 0 < r["specificity"] < 1 for r in f.quality.collect())
    assert fusion.fuse_records(spark.createDataFrame([], CT), td).survivors.count() == 0


def test_source_quality_is_recovered(spark):
    """Simulated claims: sensitivities and specificities come back, and judged facts agree with the truth."""
    rng = random.Random(9)
    real = {"good": (0.9, 0.95), "shy": (0.4, 0.97), "loose": (0.85, 0.5)}
    facts, truth = [], []
    for i in range(3000):
        t = rng.random() < 0.4
        votes = [(s, int(rng.random() < (a if t else 1 - b))) for s, (a, b) in sorted(real.items())]
        if any(v for _, v in votes):
            facts.append((len(truth), "sources", votes))
            truth.append(t)
    df = spark.createDataFrame(facts, "id int, field string, pattern array<struct<source:string,claimed:int>>")
    post, quality = fusion.source_quality(df)
    q = {r["source"]: r for r in quality.collect()}
    assert q["good"]["specificity"] > q["loose"]["specificity"] and q["good"]["sensitivity"] > q["shy"]["sensitivity"]
    judged = df.withColumn("pid", F.xxhash64("field", F.to_json("pattern"))).join(post, "pid")
    right = sum((r["p"] >= 0.5) == truth[r["id"]] for r in judged.collect())
    assert right / len(truth) > 0.85


def links_of(spark, pairs):
    return spark.createDataFrame([(a, b, w) for a, b, w in pairs], "a long, b long, w double")


def two_dense_groups_and_a_chain():
    """Two groups of 12 that hang together by one link, and a chain of 60 nodes."""
    dense = [(o + i, o + j, 0.9) for o in (0, 100) for i in range(12) for j in range(i + 1, 12)]
    return [*dense, (11, 100, 0.65), *((200 + i, 201 + i, 0.7) for i in range(59))]


def test_settled_vectors_decide_the_groups(spark):
    edges = links_of(spark, two_dense_groups_and_a_chain())
    got = {r["node"]: r["cluster"] for r in clusters.spectral_groups(edges).collect()}
    assert got == {**dict.fromkeys([*range(12), *range(100, 112)], 0), **dict.fromkeys(range(200, 260), 200)}
    # without the iteration nothing is told apart: with one point for all there is one group, with the start values none has two nodes
    graph = clusters._graph(edges)
    flat = clusters._start(graph).select("node", *[F.lit(0.5).alias(v) for v in clusters.VS])
    assert {r["cluster"] for r in clusters.spectral_groups(edges, flat).collect()} == {0}
    assert clusters.spectral_groups(edges, clusters._start(graph)).select("cluster").distinct().count() == 84
    assert clusters.spectral_groups(edges.limit(0)).count() == 0


def test_settled_vectors_are_the_weighted_means(spark):
    graph = clusters._graph(links_of(spark, two_dense_groups_and_a_chain()))
    degree = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    group = F.when(F.col("node") < 200, 0).otherwise(1).alias("g")
    want = {r["g"]: r["m"] for r in clusters._start(graph).join(degree, "node").groupBy(group).agg((F.sum(F.col("d") * F.col("v0")) / F.sum("d")).alias("m")).collect()}
    for r in clusters.settle(graph, 4).select(group, "v0").collect():
        assert abs(r["v0"] - want[r["g"]]) < 1e-7


def test_unsettled_vectors_part_bottlenecks_and_chains(spark):
    got = {r["node"]: r["cluster"] for r in clusters.spectral_clusters(links_of(spark, two_dense_groups_and_a_chain())).collect()}
    assert {got[i] for i in range(12)} == {0} and len({got[i] for i in range(100, 112)}) == 1 and got[0] != got[105]
    assert len({got[i] for i in range(200, 260)}) >= 4


def test_spanning_forest_is_maximal():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, 150), rng.integers(40, 80, 150)
    w = rng.random(150)
    keep = clusters.spanning(80, a, b, w)
    root = list(range(80))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = set()
    for i in np.argsort(-w):
        if find(a[i]) != find(b[i]):
            root[find(a[i])] = find(b[i])
            want.add(int(i))
    assert set(np.flatnonzero(keep).tolist()) == want


def test_model_beats_the_majority_on_masked_truth(spark):
    """One careful source against two that err a third of the time, by the same value: counting votes goes with the two, the model with the one."""
    rng = random.Random(21)
    right = {"careful": 0.97, "hasty": 0.65, "rash": 0.65}
    data, truth = [], {}
    for g in range(900):
        truth[3 * g] = 2000 + g % 20
        for n, (source, p) in enumerate(right.items()):
            data.append(record(3 * g + n, key=f"K{g}", source=source, sources=source, year=truth[3 * g] + (0 if rng.random() < p else 1)))
    td = spark.createDataFrame([("T1", "AA", ["a-a"])], "chembl_id string, gene string, synonyms array<string>")
    f = fusion.fuse_records(spark.createDataFrame(data, CT), td)
    fused = sum(r["year"] == truth[r["group_id"]] for r in f.survivors.collect()) / 900
    votes = {}
    for r in data:
        votes.setdefault(r[0] // 3 * 3, []).append(r[6])
    majority = sum(max(sorted(set(v)), key=v.count) == truth[g] for g, v in votes.items()) / 900
    assert fused > 0.94 and fused > majority + 0.05
    q = {r["source"]: r for r in f.quality.filter("field = 'year'").collect()}
    assert q["careful"]["sensitivity"] > q["hasty"]["sensitivity"]


def test_model_decides_which_molecule_a_text_names(spark):
    """Records without a key, whose text two keys claim: the pairs follow the source that is right elsewhere, not the number of records."""
    td = spark.createDataFrame([("T1", "AA", ["a-a"])], "chembl_id string, gene string, synonyms array<string>")
    data = []
    for g in range(60):  # two careful sources agree, a careless one states another key, more often
        base = 10 * g
        data += [record(base, key=f"R{g}", smiles=f"S{g}", source="a"), record(base + 1, key=f"R{g}", smiles=f"S{g}", source="b")]
        data += [record(base + 2 + i, key=f"W{g}", smiles=f"S{g}", source="c") for i in range(3)]
        data.append(record(base + 6, key=None, smiles=f"S{g}", source="d"))
    pairs = set(rows(fusion.duplicate_pairs(fusion.fuse_records(spark.createDataFrame(data, CT), td).members)))
    assert all((10 * g, 10 * g + 6) in pairs and (10 * g + 2, 10 * g + 6) not in pairs for g in range(60))
    hot = spark.createDataFrame([(7, i) for i in range(40)], "group_id long, rec_id long")
    assert rows(fusion.duplicate_pairs(hot, salts=3, hot=10)) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


def test_blocks_of_a_hot_band_all_meet(spark):
    import pandas as pd

    from mensura.functions.fingerprint import code, positions

    sets = sets_of(60, 4, core=2)
    own = vectors(spark, sets).filter("vec_id < 60").select(F.col("vec_id").alias("set_id"), code(positions()).alias("code")).cache()
    keys = pd.concat(clusters._signatures(2, 1)([own.toPandas()])).explode("bands")
    by = [set(map(int, g["set_id"])) for _, g in keys.groupby("bands")]
    want = {(i, j) for g in by for i in g for j in g if i < j and tanimoto(sets[i], sets[j]) >= 0.65}
    got = {(r["a"], r["b"]) for r in clusters.affinities(own, bands=2, rows=1, strongest=60, block=4).collect()}
    assert len(want) > 100 and got == want


def test_typical_members_have_the_highest_affinity_over_all_links(spark):
    sets = sets_of(90, 6, core=2)
    members = clusters.similar_groups(vectors(spark, sets))
    got = {r["vec"]: (r["cluster"], r["set_id"]) for r in members.collect()}
    links = lambda i: sum(x for j in got if j != i and got[j][0] == got[i][0] and (x := tanimoto(sets[i], sets[j])) >= 0.65)
    for block in (1024, 16):
        for r in clusters.describe(members, block=block).collect():
            own = sorted({s for c, s in got.values() if c == r["cluster"]}, key=lambda i: (-round(links(i), 9), i))
            assert list(r["typical"]) == own[:3]


def test_splits_keep_groups_whole_and_balanced(spark):
    rng = random.Random(5)
    data = [(i, f"m{rng.randrange(300)}" if rng.random() < 0.9 else None, f"s{min(rng.randrange(400), rng.randrange(400))}" if rng.random() < 0.9 else None, 1) for i in range(1200)]
    df = spark.createDataFrame(data + data[:3], "rec_id long, m string, s string, id int")
    out = splits.assign_splits(df, [F.col("m"), F.col("s")], bins=20)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == out.count() == 1200
    for k in (1, 2):
        by = {}
        for row in data:
            if row[k]:
                by.setdefault(row[k], set()).add((got[row[0]]["group_id"], got[row[0]]["split"]))
        assert all(len(v) == 1 for v in by.values())
    alone = splits.assign_splits(spark.createDataFrame([(i, f"g{i // 3}") for i in range(900)], "rec_id long, g string"), [F.col("g")], bins=20)
    n = {r["split"]: r["count"] for r in alone.groupBy("split").count().collect()}
    assert abs(n["train"] - 720) <= 9 and abs(n["valid"] - 90) <= 9 and abs(n["test"] - 90) <= 9
    assert splits.assign_splits(df.limit(0), [F.col("m")]).count() == 0


def test_differencing_in_levels(spark):
    w = spark.createDataFrame([(i, 1 + i % 7, 0) for i in range(2000)], "group_id long, weight long, stratum int")
    slots, loads = splits.balanced_bins(w, bins=10, shard=50, fan_in=4)
    sums = [r["w"] for r in slots.join(w, "group_id").groupBy("slot").agg(F.sum("weight").alias("w")).collect()]
    assert slots.count() == 2000 and len(sums) == 10 and max(sums) - min(sums) <= 3
    assert sorted(sums) == sorted(r["weight"] for r in loads.collect())


def test_allotment_by_relative_lack():
    parts = splits.PROPORTIONS
    share = lambda bins: {s: sum(w for slot, w in bins if splits.allot(bins, parts)[slot] == s) / sum(w for _, w in bins) for s in parts}
    even = share([(i, 10) for i in range(100)])
    assert abs(even["train"] - 0.8) < 0.011 and abs(even["valid"] - 0.1) < 0.011
    years = share([(i, w) for i, w in enumerate([300, 200, 150, 100, 90, 60, 50, 30, 10, 10])] + [(10 + i, 0) for i in range(90)])
    assert abs(years["train"] - 0.8) < 0.05 and years["valid"] > 0.05 and years["test"] > 0.05
    assert set(splits.allot([(0, 90), (1, 6), (2, 4)], parts).values()) == set(parts)  # three groups: one a split
    assert splits.allot([(0, 5)], parts) == {0: "train"} and splits.allot([], parts) == {}


def test_year_split_has_years_on_every_side(spark):
    """Most records without a key, few and uneven keys: both kinds stand in the proportions asked for."""
    data = [(i, 2000 + min(i % 23, i % 11)) for i in range(1500)] + [(1500 + i, None) for i in range(3000)]
    out = splits.assign_splits(spark.createDataFrame(data, "rec_id long, year int"), [F.col("year")])
    got = {r["id"]: r["split"] for r in out.collect()}
    assert len(got) == out.count() == 4500
    by_year = {}
    for i, y in data[:1500]:
        by_year.setdefault(y, set()).add(got[i])
    assert all(len(v) == 1 for v in by_year.values())
    for ids in (range(1500), range(1500, 4500)):
        n = {s: sum(got[i] == s for i in ids) / len(ids) for s in splits.PROPORTIONS}
        assert abs(n["train"] - 0.8) < 0.06 and n["valid"] > 0.04 and n["test"] > 0.04


def general(item, text, least=12, one_in=6):
    """The definition: a stretch of L words with at most L / 6 edits, by edit distances from every start."""
    n, m = len(item), len(text)
    d = [[10**6] * (m + 1) for _ in range(n)]
    for i in range(n):
        d[i] = [0] * (m + 1)
        for s in range(i + 1):
            old, new = d[s], [d[s][0] + 1] + [0] * m
            for j in range(m):
                new[j + 1] = min(old[j] + (item[i] != text[j]), old[j + 1] + 1, new[j] + 1)
            d[s] = new
            if i + 1 - s >= least and min(new) <= (i + 1 - s) // one_in:
                return True
    return False


def test_windows_equal_the_definition():
    rng = random.Random(6)
    seen = [0, 0]
    for _ in range(250):
        item = [rng.randrange(1, 60) for _ in range(rng.randint(10, 40))]
        text = list(item[rng.randrange(len(item)) :][: rng.randint(9, 30)])
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = [rng.randrange(1, 60)] if rng.random() < 0.6 else []
        text = [rng.randrange(1, 60) for _ in range(4)] + text
        want = general(item, text)
        seen[want] += 1
        assert leakage.holds(np.array(item, dtype=np.int32), np.array(text, dtype=np.int32), 6) == want
    assert min(seen) > 30


def test_leaked_passages(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    docs = [
        (1, "Intro. " + item.upper() + ", end"), (2, "x " + " ".join(words[5:17])), (3, "x " + " ".join(words[5:14])), (4, "a " + " ".join(words[:6] + ["new"] + words[7:10] + words[11:14])), (5, "pre w1 w2 w3-\n  w4 " + " ".join(words[5:8]) + ' "w8", w9 w1-\n0 w11 w12 w13'),
        (6, None), (7, ""), (8, "filler " * 30000 + " ".join(words[:12])), (9, " ".join(reversed(words))), (None, item), (1, "Intro. " + item.upper() + ", end"), (10, " ".join(words[:4] + ["q"] * 3 + words[7:12])),
    ]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item)], "item_id long, text string")
    truth = {(i, 7) for i, t in docs if i and t and i != 8 and general(re.sub(r"[^\w\s]", "", re.sub(r"-\s*\n\s*", "", item.lower())).split(), re.sub(r"[^\w\s]", "", re.sub(r"-\s*\n\s*", "", t.lower())).split())} | {(8, 7)}
    got = leakage.leaked_passages(d, e)
    assert set(rows(got, "doc_id", "item_id")) == truth and {1, 2, 5, 8} <= {i for i, _ in truth} and (3, 7) not in truth
    assert set(rows(leakage.leaked_passages(d, e, block_chars=150), "doc_id", "item_id")) == truth
    assert set(r["doc_id"] for r in leakage.without_leaks(d.filter("doc_id is not null"), got).collect()) == {i for i, _ in docs if i} - {i for i, _ in truth}
    assert leakage.leaked_passages(d, e.limit(0)).count() == 0 and leakage.leaked_passages(d.limit(0), e).count() == 0


def test_suffix_array_is_sorted_to_full_depth_and_matches_are_maximal():
    rng = random.Random(13)
    items = leakage.prepare([(i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randint(4, 25)))) for i in range(8)])
    text = np.array([rng.randrange(len(items.vocabulary) + 1) for _ in range(600)] + items.words[0].tolist() * 3 + [0], dtype=np.int32)
    wanted = np.unique(items.keys)
    depth = max(map(len, items.words))
    places = leakage.suffix_array(text, wanted, depth)
    upto = lambda p: [int(x) for x in text[p : p + depth]]
    stop = lambda w: tuple(w[: w.index(0)]) if 0 in w else tuple(w)
    grams = {tuple(w[i : i + 4]) for w in (x.tolist() for x in items.words) for i in range(len(w) - 3)}
    assert sorted(places.tolist()) == [p for p in range(len(text) - 3) if tuple(text[p : p + 4].tolist()) in grams]
    groups = {}
    for p in places.tolist():
        groups.setdefault(tuple(text[p : p + 4].tolist()), []).append(stop(upto(p)))
    assert all(g == sorted(g) for g in groups.values())
    want = set()
    for q, w in enumerate(items.words):
        for i in range(len(w)):
            for p in range(len(text)):
                if text[p] == w[i] and (i == 0 or p == 0 or text[p - 1] != w[i - 1]):
                    n = 0
                    while i + n < len(w) and p + n < len(text) and text[p + n] == w[i + n]:
                        n += 1
                    if n >= 4:
                        want.add((q, i, p, n))
    assert set(zip(*(x.tolist() for x in leakage.matches(items, text)))) == want and len(want) > 20


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="needs a vocabulary")
def test_packing(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice(["word ", "x,", "\n", "  ", "Ünï ", "12 ", "it's "]) for _ in range(n))
    texts = [text(rng.randint(1, 90)) for _ in range(200)] + [text(900), "", None, " ", "same", "same"]
    counter = packing.TokenCounter(packing.TOKENIZER)
    assert all(counter.count(t) == len(counter.encoding.encode_ordinary(t)) for t in texts if t)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "a", 1)], "doc_id long, text string, size int")
    out = packing.pack_documents(df, 128, shard=60).collect()
    size = {i: len(counter.encoding.encode_ordinary(t)) for i, t in enumerate(texts) if t}
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence"], []).append(r)
    assert set(by_doc) == set(size)
    for i, own in by_doc.items():
        assert sum(r["n_tokens"] for r in own) == size[i] and (len(own) == 1 or size[i] > 128)
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert sum(r["n_tokens"] for r in own) <= 128 and [r["offset"] for r in own] == [sum(x["n_tokens"] for x in own[:k]) for k in range(len(own))]
    assert len(by_seq) <= 1.05 * sum(size.values()) / 128 + 1
    assert packing.pack_documents(df.limit(0), 128).count() == 0


def test_genetic_packing_beats_best_fit_on_hard_sizes():
    """Triplets that fill a bin exactly, and sizes between a fifth and two thirds of the capacity."""
    rng = random.Random(20)
    gained = 0
    for n in (20, 30, 40):
        sizes = []
        for _ in range(n):
            a = rng.randint(380, 490)
            b = rng.randint((1000 - a) // 2 - 60, (1000 - a) // 2)
            sizes += [a, b, 1000 - a - b]
        order = sorted(range(len(sizes)), key=lambda x: -sizes[x])
        plain = packing.best_fit(sizes, order, [], 1000)
        grown = packing.evolve(sizes, 1000, [], 16, 600, seed=n, patience=300)
        assert sorted(x for one in grown for x in one[1]) == sorted(order) and all(one[0] == sum(sizes[x] for x in one[1]) <= 1000 for one in grown)
        assert len(grown) <= len(plain)
        gained += len(plain) - len(grown)
    assert gained >= 3
    sizes = [rng.randint(200, 660) for _ in range(150)]
    plain = packing.best_fit(sizes, sorted(range(150), key=lambda x: -sizes[x]), [], 1000)
    assert len(packing.evolve(sizes, 1000, [plain], 12, 400, seed=1)) <= len(plain)


TEXTS = {
    "prose": "The well is dry because the pump was not on.\nIt has been said that a man can walk to the sea in one day, if the road is good.",
    "list": "\n".join(f"- {i}-methylthing" for i in range(12)), "table": "\n".join(["| 12 | +++ | ++ |"] * 9), "junk": "\n".join(f"reg=0x{i:08x};" for i in range(9)),
}


def kinds(df, **how):
    return {r["doc_id"]: r for r in quality.text_statistics(df, **how).collect()}


def test_text_kinds_and_figures(spark):
    odd = ["", None, " \n ", "- 1 -\n- 2 -", "same SAME same " * 30, "However it is so that the cat sat on the mat.\n" * 9, "1. A method of making the thing, wherein the thing is made.\n2. The method of claim 1, wherein it is blue."]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS.values(), *odd])] + [(0, TEXTS["prose"], 1), (None, "x", 1)], "doc_id long, text string, counts int")
    got = kinds(df)
    assert [got[i]["text_kind"] for i in range(4)] == list(TEXTS) and [got[4 + i]["text_kind"] for i in range(7)] == ["junk"] * 6 + ["prose"]
    p = got[0]
    assert p["words"] == 30 and p["ended_line_share"] == 1.0 and p["common_word_share"] > 0.4 and got[4]["words"] == 0 and got[4]["mean_word_length"] == 0.0
    assert kinds(df.limit(0)) == {}


def test_chunks_change_nothing(spark):
    rng = random.Random(8)
    texts = ["\r\n".join(rng.choice([*TEXTS.values(), "", " x ", "a\tb\tc"]) for _ in range(40)) for _ in range(6)] + ["word " * 3000, "x" * 5000, TEXTS["prose"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    whole = kinds(df)
    for chunk, fan_in in ((50, 3), (333, 16)):
        assert kinds(df, chunk=chunk, fan_in=fan_in) == whole


def test_a_long_line_is_one_line_in_chunks_too(spark):
    rng = random.Random(10)
    line = " ".join(rng.choice(["the", "pump", "is", "in", "a", "well"]) for _ in range(52_000))
    texts = [line, "z" * 200_001, "first\n" + line + "\nlast.", TEXTS["prose"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    script = quality.learn_script(df)
    at = {n: quality.AT[n] for n in ("lines", "words", "word_chars", "ended_lines", "common_words", "repeated", "pairs")}
    figures = lambda **how: {r["doc_id"]: [r["counts"][i] for i in at.values()] for r in quality.text_counts(df, script, **how).collect()}
    whole = figures(chunk=10**7)
    assert [whole[i][:2] for i in range(3)] == [[1, 52_000], [1, 1], [3, 52_002]] and len(line) > 188_000
    assert figures() == whole == figures(chunk=1000, fan_in=4)


def test_unreadable_letters_broken_encodings_and_tab_bullets(spark):
    rng = random.Random(11)
    prose = [" ".join(rng.choice("the method of claim one wherein compound solvent heated mixture filtered product yields acid".split()) for _ in range(60)) + "." for _ in range(40)]
    scrambled = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  |.") for _ in range(400))
    mojibake = "".join(rng.choice("\u00c3\u00a2\u00e2\u20ac\u00c2\u00b6\u00ef\u00bf \u00bd\u00b0") for _ in range(400))
    bullets = "\n".join(f"\u25aa\t{i}-methylthiazole" for i in range(12))
    df = spark.createDataFrame(list(enumerate([scrambled, mojibake, bullets, *prose])), "doc_id long, text string")
    got = kinds(df)
    assert [got[i]["text_kind"] for i in range(3)] == ["junk", "junk", "list"] and all(got[3 + i]["text_kind"] == "prose" for i in range(40))
