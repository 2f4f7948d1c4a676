"""Operators of the measurement pipeline on small inputs, one test a trap."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from mensura.functions import keys, text
from mensura.functions.batches import packed
from mensura.functions.fingerprint import code, positions
from mensura.operators import audit, conformal, harmonise, metrics, models, report, similarity, splits
from mensura.operators.cluster import sphere_exclusion
from mensura.operators.components import connected_components
from mensura.plans import reference
from mensura.sources import api, delimited, dump


def test_keys_and_placeholders(spark):
    df = spark.createDataFrame([(1, "InChIKey= abc-d "), (2, "\tABC-D"), (3, "NA"), (4, " "), (5, None)], "i int, k string")
    assert rows(df.select("i", keys.molecule_key("k").alias("k"))) == [(1, "ABC-D"), (2, "ABC-D"), (3, None), (4, None), (5, None)]


def test_molecule_by_text_takes_the_most_stated_key(spark):
    df = spark.createDataFrame([(1, "K1", "CC", 9), (2, "K1", "CC", 9), (3, "K2", " CC", 9), (4, "NA", "CC ", 9), (5, None, None, 9), (6, "", "N", 9)], "rec_id long, inchikey string, std_smiles string, __n int")
    assert rows(keys.with_molecule(df), "rec_id", "molecule") == [(1, "K1"), (2, "K1"), (3, "K2"), (4, "K1"), (5, None), (6, None)]


def test_target_by_synonym_or_id(spark):
    targets = spark.createDataFrame([("TGT1", "AA", ["A-A", "a1"]), ("TGT2", "BB", None)], "chembl_id string, gene string, synonyms array<string>")
    df = spark.createDataFrame([(1, "a-a", None), (2, None, "BDB:TGT1"), (3, "", "tgt2"), (4, "zz", "TGT1"), (5, None, "NA")], "i int, gene string, target_chembl_id string")
    assert rows(keys.with_target(df, targets), "i", "target") == [(1, "TGT1"), (2, "TGT1"), (3, "TGT2"), (4, "GENE:ZZ"), (5, None)]


def test_exact_numbers(spark):
    cells = ["5", " 12 ", "1e3", "1_000", "1d", "nan", "inf", ">10", "=5", "~3", " ", None, "0", "-1"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").withColumn("v", text.exact_number("c"))
    assert [r["v"] for r in df.orderBy("i").collect()] == [5.0, 12.0, 1000.0, None, None, None, None, None, None, None, None, None, 0.0, -1.0]
    p = df.filter("v is not null").withColumn("p", text.p_scale(F.col("v")))
    assert {r["v"]: r["p"] for r in p.collect()}[1000.0] == pytest.approx(6.0) and {r["v"]: r["p"] for r in p.collect()}[0.0] is None


def test_relation_keeps_quotes_only_but_not_blank(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["'='", "=", " ", ">", "''", None])], "i int, c string")
    assert [r["ok"] for r in df.select("i", text.equals_relation("c").alias("ok")).orderBy("i").collect()] == [True, True, False, False, True, False]


def test_first_match_left_to_right(spark):
    df = spark.createDataFrame([("x", "B"), ("A", "B"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(text.first_match(["a", "b"], ["A", "B"])).collect()] == ["B", "A", None]


def test_largest_fragment(spark):
    df = spark.createDataFrame([("CC.CCCC.Na",), ("",), (None,), ("B.A",)], "s string")
    assert [r[0] for r in df.select(text.largest_fragment("s")).collect()] == ["CCCC", None, None, "A"]


def test_tsv_drops_long_lines_and_pads_short_ones(spark):
    header = "a\tb\tc"
    df = spark.createDataFrame([("1\t2\t3",), ("1\t2",), ("1\t2\t3\t4",), ('"\tNA\tnull',), (header,), (None,)], "value string")
    assert rows(delimited.parse_lines(df, header)) == [('"', None, None), ("1", "2", "3"), ("1", "2", None)]


def test_wide_tsv_first_chain_and_missing_columns(spark):
    header = "Ligand SMILES\tIC50 (nM)\tUniProt (SwissProt) Primary ID of Target Chain\tUniProt (SwissProt) Primary ID of Target Chain 2"
    df = spark.createDataFrame([("CC\t10\tP2\tP1",), ("CC\t>10\tP1\tP1",), ("CC\t0\tP1\t",), ("\t5\tP1\t",), ("CC\t5\tX\t",)], "value string")
    out = delimited.wide_measurements(df, header, "IC50", {"G1": "P1", "G2": "P2"})
    assert rows(out, "gene", "pchembl", "mol_id", "target_chembl_id") == [("G2", 8.0, "BDB_NA", "BDB:P2")]
    with pytest.raises(ValueError):
        delimited.wide_measurements(df, "a\tb", "IC50", {"G1": "P1"})


def test_csv_folder(spark, tmp_path):
    (tmp_path / "abc.csv").write_text("Smiles;Standard Type;Standard Relation;pChEMBL Value;Document Year\nCC;IC50;'=';7.1;2010\nCC;ic50 ;;7.2;2011\nCC;Ki;'=';7;2010\nN;IC50;=;bad;2010\n")
    (tmp_path / "d.csv").write_text("canonical_smiles,standard_type,pchembl_value\nO,IC50,5\n")
    out = delimited.read_csv_dir(spark, [str(tmp_path / "abc.csv"), str(tmp_path / "d.csv")], "IC50")
    assert rows(out, "gene", "smiles", "pchembl", "year", "mol_id") == [("ABC", "CC", 7.1, 2010, "NA"), ("D", "O", 5.0, None, "NA")]


def test_dump_join_chain(spark):
    mk = spark.createDataFrame
    t = {
        "component_sequences": mk([(1, "P1"), (2, "P9")], "component_id int, accession string"), "target_components": mk([(1, 10), (2, 20)], "component_id int, tid int"), "target_dictionary": mk([(10, "T10"), (20, "T20")], "tid int, chembl_id string"),
        "assays": mk([(5, 10, "B", "A5"), (6, 10, "F", "A6")], "assay_id int, tid int, assay_type string, chembl_id string"),
        "activities": mk([(5, 7, 3, "IC50", "=", "6.5"), (5, 7, 99, "IC50", "=", "6.6"), (6, 7, 3, "IC50", "=", "6.5"), (5, 7, 3, "Ki", "=", "6.5"), (5, 7, 3, "IC50", ">", "6.5"), (5, 8, 3, "IC50", "=", "1")], "assay_id int, molregno int, doc_id int, standard_type string, standard_relation string, pchembl_value string"),
        "compound_structures": mk([(7, "CC"), (8, None)], "molregno int, canonical_smiles string"), "molecule_dictionary": mk([(7, "M7"), (8, "M8")], "molregno int, chembl_id string"), "docs": mk([(3, 2011)], "doc_id int, year int"),
    }
    assert rows(dump.dump_measurements(t, "IC50", {"G": "P1"}), "gene", "pchembl", "year", "assay_id") == [("G", 6.5, 2011, "A5"), ("G", 6.6, None, "A5")]


def test_api_source_pages_and_retries():
    calls = []

    def get(url):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("500")
        more = "activity?page=2" if len(calls) == 2 else None
        return {"activities": [{"canonical_smiles": "CC", "molecule_chembl_id": "M", "pchembl_value": "6", "standard_type": "Ki", "document_year": None}, {"canonical_smiles": None}], "page_meta": {"next": more}}

    r = api.ActivityReader({"base": "http://x", "endpoint": "Ki", "targets": '{"G": ["T2", "T1", "T1"]}', "pace": "0"}, get)
    assert [(p.gene, p.target) for p in r.partitions()] == [("G", "T1"), ("G", "T2")]
    real, api.time.sleep = api.time.sleep, lambda s: None
    api.retried.__defaults__ = (6, 0.0, lambda s: None)
    try:
        assert len(list(r.read(r.partitions()[0]))) == 2
    finally:
        api.time.sleep = real
    with pytest.raises(RuntimeError):
        api.retried(lambda: 1 / 0, "x", 2, 0.0, lambda s: None)


def test_merge_is_a_median_of_medians_with_first_non_null(spark):
    df = spark.createDataFrame(
        [(1, "K", "G", "IC50", None, 5.0, 2010, "T", None, "ChEMBL"), (2, "K", "g", "ic 50", "CC", 7.0, 0, "T", "S", "chembl"), (3, "K", "G", "IC50", "CO", 9.0, 2005, None, "R", "BindingDB"), (4, "NA", "G", "IC50", "C", 1.0, 2000, "T", "S", "x"), (5, "K", "G", "IC50", "C", float("nan"), 2000, "T", "S", "x")],
        "rec_id long, inchikey string, gene string, endpoint string, std_smiles string, pchembl double, year int, target_chembl_id string, scaffold string, source string",
    )
    s = harmonise.per_source(df)
    assert rows(harmonise.merge_sources(s), "inchikey", "std_smiles", "pchembl", "year", "scaffold", "sources") == [("K", "CC", 7.5, 2005, "S", "bindingdb,chembl")]
    assert rows(harmonise.overlap_report(harmonise.merge_sources(s), s), "n_merged", "n_in_several", "n_naive", "n_removed") == [(1, 1, 2, 1)]
    with pytest.raises(Exception):
        harmonise.require_unique(df.limit(2).withColumn("one", F.lit(1)), ["one"]).collect()


def brute(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def random_sets(n, seed, core=6):
    rng = np.random.default_rng(seed)
    cores = [set(rng.choice(2048, 40, replace=False).tolist()) for _ in range(core)]
    out = []
    for i in range(n):
        s = set(cores[rng.integers(core)])
        for x in rng.choice(sorted(s), rng.integers(0, 14), replace=False):
            s.discard(int(x))
        s |= set(rng.choice(2048, rng.integers(0, 10)).tolist())
        out.append(frozenset(int(x) for x in s))
    return out


def test_range_join_equals_brute_force(spark):
    sets = list(dict.fromkeys(random_sets(150, 3)))
    df = spark.createDataFrame([(i, sorted(s), len(s)) for i, s in enumerate(sets)], "set_id long, pos array<int>, n_on int")
    for least in (0.5, 0.65, 0.9):
        truth = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if brute(sets[i], sets[j]) >= least}
        got = [(r["a"], r["b"]) for r in similarity.range_join(df, least, block=16).collect()]
        assert set(got) == truth and len(got) == len(truth)


def test_range_join_compares_only_sets_that_share_two_positions():
    """Of sets in one position's task few are compared, and none is missed: long ones, and such as share one position only."""
    rng = np.random.default_rng(4)
    apart = [{0, *(int(x) for x in rng.choice(np.arange(1, 2048), 40, replace=False))} for _ in range(400)]
    sets = sorted({frozenset(s) for s in [*apart, *({*sorted(s)[:-3]} for s in apart[:20]), {0}, {0, 1}, {0, 2}, {0, 1, 2}]}, key=lambda s: (len(s), sorted(s)))
    flat, offsets = np.array([p for s in sets for p in sorted(s)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits, n = packed(flat, offsets)
    fold = np.bitwise_or.reduce(bits.reshape(len(n), -1, 4), axis=1)
    for least in (0.3, 0.5, 0.65):
        truth = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if brute(sets[i], sets[j]) >= least}
        met = similarity._candidates(0, flat, offsets, n, np.zeros(len(n), dtype=int), 0, 0, fold, least)
        met = {(min(p), max(p)) for p in (divmod(int(x), len(n)) for x in met)}
        assert truth <= met and len(met) < len(truth) + len(sets) ** 2 / 200


def test_nearest_is_exact_and_zero_without_any(spark):
    sets = random_sets(80, 5)
    q = spark.createDataFrame([("s", i, sorted(s)) for i, s in enumerate(sets[:20])] + [("t", 99, [1, 2])], "g string, a long, pos array<int>")
    a = spark.createDataFrame([("s", sorted(s)) for s in sets[20:]], "g string, pos array<int>")
    got = {r["a"]: r["nn"] for r in similarity.nearest(q, a, ["g"], block=7).collect()}
    assert got.pop(99) == 0.0
    assert all(got[i] == pytest.approx(max(brute(sets[i], s) for s in sets[20:])) for i in range(20))


def test_nearest_leaves_out_only_the_row_itself(spark, tmp_path):
    data = [(100, [1, 2, 3, 4]), (200, [1, 2, 3, 5]), (7, [1, 2, 8, 9]), (300, [20, 21]), (8, [20, 21]), (400, [30])]
    spark.createDataFrame(data, "vec_id long, bits array<int>").withColumn("bits_text", F.lit(None).cast("string")).write.parquet(str(tmp_path / "fingerprint.parquet"))
    assert rows(reference.nn_tanimoto(spark, str(tmp_path))) == [(100, 0.6), (200, 0.6), (300, 1.0), (400, 0.0)]


def test_positions_from_text_and_out_of_range(spark):
    df = spark.createDataFrame([([3, 1, 3, None, 5000, -1], None), (None, "7;1, 2"), (None, None), ([], "9")], "bits array<int>, bits_text string")
    assert [r[0] for r in df.select(positions()).collect()] == [[1, 3], [1, 2, 7], [], []]
    assert df.select(F.length(code(positions()))).first()[0] == 4


def test_splits(spark):
    df = spark.createDataFrame([(f"k{i:02d}", f"g{i % 4}" if i < 10 else "big", 2000.0 + i // 5) for i in range(18)], "key string, scaffold string, year double")
    n = {r["side"]: r["count"] for r in splits.random_split(df, "key").groupBy("side").count().collect()}
    assert n == {"train": 14, "test": 4}  # round half even of 13.5
    assert {r["key"] for r in splits.time_split(df, "key").filter("side = 'test'").collect()} == {"k14", "k15", "k16", "k17"}
    for smallest in (False, True):
        g = splits.grouped_split(df, "scaffold", smallest_first=smallest)
        sides = g.groupBy("scaffold").agg(F.countDistinct("side").alias("n")).filter("n > 1").count()
        sizes = sorted(r["count"] for r in g.filter("side = 'test'").groupBy("scaffold").count().collect())
        assert sides == 0 and sum(sizes) >= 4 and sum(sizes) - max(sizes) < 4 + 8
    smallest = splits.grouped_split(df, "scaffold", smallest_first=True).filter("side = 'test'").select("scaffold").distinct()
    assert rows(smallest) == [("g2",), ("g3",)] or sum(1 for _ in rows(smallest)) == 2
    with pytest.raises(ValueError):
        splits.make_split("other", df, "key")
    roles = splits.calibration_roles(splits.split_table(df, "key", [("random", 1), ("time", 1)]), "key", least=3)
    assert {r["n"] for r in roles.filter("role = 'cal'").groupBy("split").agg(F.count("*").alias("n")).collect()} == {4}


def test_conformal_rank(spark):
    for n in (1, 9, 10, 19, 20, 100):
        scores = list(np.random.default_rng(n).permutation(n) / 1.0)
        df = spark.createDataFrame([("x", float(s)) for s in scores], "g string, score double")
        for alpha in (0.05, 0.1, 0.2):
            level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
            assert conformal.conformal_quantile(df, ["g"], alpha=alpha).first()["q"] == np.quantile(scores, level, method="higher")


def test_metrics_and_strata(spark):
    base = [("s", 1, 1.0, 1.0, 0.49, 1.0, True), ("s", 1, 2.0, 2.0, 0.5, 2.0, False), ("s", 1, 2.0, 3.0, 0.69, 3.0, True), ("s", 1, 4.0, 4.0, 0.7, 4.0, True)]
    df = spark.createDataFrame(base + [("c", 1, 5.0, 4.0, 0.6, 1.0, True)] * 2, "split string, seed int, y double, mu double, nn double, half double, covered boolean")
    m = {r["split"]: r for r in metrics.fold_result(df).collect()}
    assert m["s"]["rmse"] == 0.5 and m["s"]["coverage"] == 0.75 and m["s"]["width_low_novel"] == 8.0 and m["s"]["width_high_novel"] == 2.0
    assert m["c"]["r2"] == 1 - 2 / 1e-12 and m["c"]["spearman"] is None and m["c"]["width_low_novel"] is None
    rank = np.corrcoef([1, 2.5, 2.5, 4], [1, 2, 3, 4])[0, 1]
    assert m["s"]["spearman"] == pytest.approx(rank, abs=1e-6)


def test_report_deviations_and_verdicts(spark):
    r = spark.createDataFrame([("random", 1, 0.8), ("random", 2, 0.6), ("scaffold", 1, 0.5)], "split string, seed int, r2 double")
    full = r.select("*", *[F.lit(0.95).alias(c) for c in ("rmse", "coverage", "width", "coverage_mondrian", "width_mondrian", "width_near", "width_novel")])
    s = report.seed_summary(full)
    assert {x["split"]: x["r2_sd"] for x in s.collect()} == {"random": 0.1, "scaffold": 0.0}
    assert report.gap_verdict(s).first()["verdict"] == "random over-estimates"
    p = {x["split"]: (x["r2_mean"], x["r2_sd"]) for x in report.panel_mean_sd(full, ["r2"]).collect()}
    assert p["random"] == (0.7, pytest.approx(0.141421, abs=1e-6)) and p["scaffold"] == (0.5, 0.0) and p["time"] == (None, None)
    assert report.worst_split(s).first()["split"] == "scaffold"
    assert report.overcoverage(s).first()["improved"] is False


def test_audit_counts_rows_by_molecule(spark):
    sided = spark.createDataFrame([("r", 1, "a", "s1", "train"), ("r", 1, "a", "s2", "test"), ("r", 1, "a", None, "test"), ("r", 1, "b", "s1", "test")], "split string, seed int, inchikey string, scaffold string, side string")
    sets = spark.createDataFrame([("a", [1, 2, 3]), ("b", [1, 2, 4])], "inchikey string, pos array<int>")
    r = audit.leakage_audit(sided, sets).first()
    assert (r["n_train"], r["n_test"], r["exact_dupe_keys"]) == (1, 3, 2) and r["scaffold_straddle_frac"] == pytest.approx(1 / 3, abs=1e-6)
    assert r["nn_tanimoto_median"] == 1.0 and r["frac_test_nn_ge_0_9"] == pytest.approx(2 / 3, abs=1e-6)
    assert len(audit.render(audit.leakage_audit(sided, sets))) == 1


def test_audit_compares_all_only_where_a_figure_needs_it(spark, monkeypatch):
    """Group 1: the median lies among the near rows, so nothing is compared in blocks. Group 2: it does not, and is exact below the threshold."""
    far = {"c": [1, 2, 3, 50, 51], "d": [1, 2, 60, 61, 62], "e": [70, 71]}
    sets = spark.createDataFrame([("a", [1, 2, 3, 4, 5]), ("b", [1, 2, 3, 4]), *far.items()], "inchikey string, pos array<int>")
    one = [("r", 1, "a", "train"), ("r", 1, "a", "test"), ("r", 1, "b", "test"), ("r", 1, "e", "test")]
    two = [("r", 2, "a", "train"), *(("r", 2, k, "test") for k in far)]
    sided = spark.createDataFrame([(*x[:3], None, x[3]) for x in one + two], "split string, seed int, inchikey string, scaffold string, side string")
    asked = []
    monkeypatch.setattr(audit, "nearest", lambda q, *a, f=audit.nearest: asked.extend(r["seed"] for r in q.select("seed").collect()) or f(q, *a))
    got = {r["seed"]: r for r in audit.leakage_audit(sided, sets).collect()}
    assert set(asked) == {2} and got[1]["nn_tanimoto_median"] == 0.8 and got[2]["nn_tanimoto_median"] == 0.25
    assert got[2]["nn_tanimoto_p90"] == pytest.approx(0.25 + 0.8 * (3 / 7 - 0.25), abs=1e-6) and got[1]["frac_test_nn_ge_0_7"] == pytest.approx(2 / 3, abs=1e-6)


def test_panel_looks_for_twins_only(spark, monkeypatch):
    sided = spark.createDataFrame([("r", 1, "a", "s", "train"), ("r", 1, "a", "s", "test"), ("r", 1, "b", "t", "test"), ("r", 1, "x", "t", "test")], "split string, seed int, inchikey string, scaffold string, side string")
    sets = spark.createDataFrame([("a", list(range(10))), ("b", list(range(9)))], "inchikey string, pos array<int>")
    asked = []
    monkeypatch.setattr(audit, "range_join", lambda v, least, f=audit.range_join: asked.append(least) or f(v, least))
    want, got = audit.leakage_audit(sided, sets).first(), audit.twin_audit(sided, sets).first()
    assert asked == [0.7, 0.9] and all(got[c] == want[c] for c in ("exact_dupe_keys", "frac_test_nn_ge_0_9", "scaffold_straddle_frac")) and got["frac_test_nn_ge_0_9"] == 0.666667


def sequential(n, near):
    """Sphere exclusion one row after the other, for comparison."""
    nb = {i: {j for a, b in near for j in ((b,) if a == i else (a,) if b == i else ())} for i in range(n)}
    label = {}
    for i in sorted(range(n), key=lambda i: (-len(nb[i]), i)):
        if i not in label:
            label[i] = i
            for j in nb[i]:
                label.setdefault(j, i)
    return label


def test_sphere_exclusion_equals_the_sequential_rule(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        n = 30
        near = sorted({tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(40)})
        ids = spark.createDataFrame([(i,) for i in range(n)], "set_id long")
        pairs = spark.createDataFrame(near, "a long, b long")
        got = {r["set_id"]: r["cluster"] for r in sphere_exclusion(ids, pairs).collect()}
        assert got == sequential(n, near)
    empty = spark.createDataFrame([], "a long, b long")
    assert rows(sphere_exclusion(ids.limit(2), empty)) == [(0, 0), (1, 1)]


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 3), (10, 11), (12, 11), (5, None)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(e, "a long, b long")
    got = dict(rows(connected_components(df)))
    assert got[3] == 1 and got[12] == 10 and got[140] == 100 and 5 not in got
    assert connected_components(df.limit(0)).count() == 0


def test_forest_sigma_agrees_with_the_model(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(0)
    data = [(f"k{i}", float(a), float(b), float(a * 2 + b + rng.normal(0, 0.1))) for i, (a, b) in enumerate(rng.random((120, 2)))]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(data, "key string, a double, b double, y double"))
    out = models.forest_predict(df, df, trees=5, depth=4).join(df, "key")
    r2 = out.agg(F.corr("mu", "y").alias("r"), F.min("sigma").alias("s"), F.count("*").alias("n")).first()
    assert r2["r"] > 0.9 and r2["s"] > 0 and r2["n"] == 120


def test_random_split_intervals_cover(spark):
    """The whole harness on synthetic clusters: coverage of 0.8 or more at a nominal 0.9."""
    rng = np.random.default_rng(1)
    data = []
    for c in range(30):
        core, effect = set(rng.choice(512, 40, replace=False).tolist()), rng.normal(0, 1.2)
        for _ in range(10):
            data.append((f"m{len(data):04d}", sorted(core | set(rng.choice(512, 6).tolist())), float(6 + effect + rng.normal(0, 0.25)), f"s{c}"))
    rows_ = spark.createDataFrame([(k, k, y, s, 2000.0) for k, _, y, s in data], "key string, inchikey string, y double, scaffold string, year double")
    sets = spark.createDataFrame([(i, k, p, len(p)) for i, (k, p, _, _) in enumerate(data)], "set_id long, inchikey string, pos array<int>, n_on int")
    pairs = similarity.range_join(sets, 0.5)
    names = sets.select("set_id", "inchikey")
    named = pairs.join(names.toDF("a", "ka"), "a").join(names.toDF("b", "kb"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"), "similarity")
    p = models.knn_predict(splits.calibration_roles(splits.split_table(rows_, "key", [("random", 1)]), "key"), named)
    for method in (conformal.normalised, conformal.mondrian):
        f = metrics.fold_result(method(p)).first()
        assert f["coverage"] >= 0.8 and f["r2"] > 0.5


def test_command_line_writes_audit_results_and_text(spark, tmp_path):
    from mensura import __main__ as command

    a = command.arguments(["--data", "/root/testdata/sf0.001", "--seeds", "1", "--report", str(tmp_path)])
    lines = command.evaluate(spark, a)
    audit_rows, results = (spark.read.csv(f"{tmp_path}/{n}", header=True, inferSchema=True) for n in ("audit", "results"))
    assert {r["split"] for r in audit_rows.collect()} == {"random", "scaffold", "cluster", "time"}
    assert {"endpoint", "split", "seed", "r2", "coverage_mondrian"} <= set(results.columns) and all(0 <= r["coverage"] <= 1 for r in results.collect())
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()] == lines and lines[0] == "LEAKAGE AUDIT"


def test_quantiles_interpolate_and_skip_nulls(spark):
    from mensura.operators.splits import quantiles

    values = [3.0, 1.0, None, 4.0, 1.5, 9.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)], "g string, v double")
    got = {r["g"]: list(r["q"]) for r in quantiles(df, ["g"], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got["b"] == [2.0] * 4 and all(abs(x - y) < 1e-12 for x, y in zip(got["a"], [1.0, 3.0, 7.0, 9.0]))


def test_splits_with_too_few_rows_are_left_out(spark):
    from mensura.operators.splits import large_enough

    rows_of = lambda name, test, train: [(name, "test")] * test + [(name, "train")] * train
    df = spark.createDataFrame(rows_of("ok", 10, 40) + rows_of("few test", 9, 90) + rows_of("few train", 30, 39), "split string, side string")
    assert {r["split"] for r in large_enough(df, ["split"]).collect()} == {"ok"}
