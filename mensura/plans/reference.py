"""Queries over the given tables, one per operator of the measurement pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.fingerprint import N_BITS, positions
from mensura.functions.keys import finite, present, usable_year
from mensura.functions.text import equals_relation, exact_number, first_match, largest_fragment, p_scale, text_key
from mensura.operators import audit, cluster, conformal, harmonise, metrics, models, report, similarity, splits
from mensura.session import cut, ensure_checkpoint_dir
from mensura.sources import delimited, dump, sinks
from mensura.sources.delimited import wide_measurements
from mensura.sources.tables import table

PLAN = [("random", 1), ("random", 2), ("scaffold", 1), ("scaffold", 2), ("time", 1)]
#: The same with clusters; time is split once.
FULL_PLAN = [*PLAN[:4], ("cluster", 1), ("cluster", 2), ("time", 1)]
EBY = ["endpoint", "split", "seed"]
HELD_GENE = "KRZF"
#: Similarity from which a row is a neighbour of the similar-rows predictor.
NEIGHBOUR = 0.5
FAMILY = {"G0": "TGT40210", "G1": "TGT40247", "G2": "TGT40284"}
HEADER = "Ligand SMILES\tBindingDB MonomerID\tIC50 (nM)\tUniProt (SwissProt) Primary ID of Target Chain\tUniProt (SwissProt) Primary ID of Target Chain 2"


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# ---- sources and row-wise operators


def scan_measurements(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "measurement")
    return m.select("row_id", F.upper(present("gene")).alias("gene"), F.round(finite("pchembl"), 6).alias("pchembl"), usable_year("year").alias("year"), F.coalesce(present("source"), F.lit("ChEMBL")).alias("source")).na.drop(subset=["gene", "pchembl"])


def dump_join_chain(spark: SparkSession, d: str) -> DataFrame:
    """Six inner joins and a left one, filtered and folded."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "supplier", "lineitem", "part", "orders", "customer")}
    chain = (
        t["lineitem"].filter("l_returnflag = 'A' and l_quantity is not null").join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"].filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").filter(F.col("r_name").isNotNull() & (F.col("p_size") > 5))
    )
    return chain.groupBy("r_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.count("c_custkey").alias("n_customer"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def relation_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of measurement with a relation text made of the row number."""
    relation = F.element_at(F.array(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in ("'='", "=", "", ">", "''", None, ' "=" ')]), (F.col("row_id") % 7 + 1).cast("int"))
    m = table(spark, d, "measurement").withColumn("relation", relation)
    kept = m.filter(equals_relation("relation") & (F.upper(F.trim("endpoint")) == "IC50") & present("smiles").isNotNull())
    return kept.groupBy("gene", "relation").agg(F.count("*").alias("n"))


def exact_value_guard(spark: SparkSession, d: str) -> DataFrame:
    """Cells with prefixes and odd spellings made of events.value."""
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("", ">", "<", "~", " ", "=", "nan", "-")]), (F.col("event_id") % 8 + 1).cast("int"))
    cell = F.concat(prefix, F.format_string("%.4f", "value"), F.when(F.col("event_id") % 11 == 0, "d").otherwise(""))
    e = table(spark, d, "events").select("event_id", cell.alias("cell")).withColumn("value", exact_number("cell"))
    return e.select("event_id", F.round("value", 6).alias("value"), F.round(p_scale(F.col("value")), 6).alias("p")).filter("value is not null")


def first_match_columns(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "measurement").select("row_id", F.when(F.col("row_id") % 3 == 0, F.col("gene")).alias("a"), F.when(F.col("row_id") % 2 == 0, F.col("target_chembl_id")).alias("b"), F.col("source").alias("c"))
    wanted = ["KRZA", "KRZB", "TGT40284", "BindingDB"]
    names = F.create_map(*[F.lit(x) for w in wanted for x in (w, w.lower())])
    hit = m.withColumn("hit", first_match(["a", "b", "c"], wanted)).filter("hit is not null")
    return hit.select("row_id", "hit", names[F.col("hit")].alias("name"))


def tsv_tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    """measurement written as lines of a wide TSV, with short and long lines among them, and read again."""
    nano = F.format_string("%.3f", F.pow(F.lit(10.0), 9 - finite("pchembl")))
    fields = [F.coalesce("smiles", F.lit("NA")), F.coalesce("mol_id", F.lit("")), F.concat(F.when(F.col("row_id") % 5 == 0, ">").otherwise(""), F.coalesce(nano, F.lit("nan"))), F.when(F.col("row_id") % 2 == 0, F.col("target_chembl_id")).otherwise("X"), F.coalesce("target_chembl_id", F.lit("None"))]
    wide, short = F.concat_ws("\t", *fields), F.concat_ws("\t", *fields[:4])
    line = F.when(F.col("row_id") % 13 == 0, F.concat(wide, F.lit("\textra"))).when(F.col("row_id") % 4 == 0, short).otherwise(wide)
    lines = cut(table(spark, d, "measurement").select("row_id", line.alias("value")))
    out = wide_measurements(lines, HEADER, "IC50", FAMILY, keep=("row_id",))
    return out.select("row_id", "gene", "target_chembl_id", F.round("pchembl", 4).alias("pchembl"))


# ---- harmonising


def _replicates(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "measurement").withColumn("std_smiles", largest_fragment("smiles")).withColumn("value", F.when(finite("pchembl").between(0, 14), F.col("pchembl")))
    rows = m.select(text_key(F.col("std_smiles")).alias("inchikey"), F.upper(F.trim("gene")).alias("gene"), "endpoint", "std_smiles", F.col("value").alias("pchembl"), usable_year("year").alias("year"), "target_chembl_id", "row_id")
    return harmonise.fold_replicates(rows.na.drop(subset=["inchikey", "gene", "endpoint", "pchembl"]), harmonise.KEY, "row_id")


def replicate_agg(spark: SparkSession, d: str) -> DataFrame:
    return _replicates(spark, d).select(*harmonise.KEY, "std_smiles", _r("pchembl"), "n_meas", "year", "target_chembl_id")


def replicate_unique_check(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.repeated_keys(_replicates(spark, d), harmonise.KEY)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.per_source(table(spark, d, "compound_target"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.merge_sources(_sources(spark, d))


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    both = s.filter("source = 'chembl'").drop("scaffold").unionByName(s.filter("source = 'bindingdb'"), allowMissingColumns=True)
    return both.groupBy("source", "gene").agg(F.count("*").alias("n"), F.count("scaffold").alias("n_scaffold"), F.round(F.avg("pchembl"), 6).alias("mean"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select(*harmonise.KEY, "sources")


def harmonise_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select(*harmonise.KEY, "std_smiles", _r("pchembl"), "scaffold", "year", "target_chembl_id", "sources", "source")


def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    s = cut(_sources(spark, d))
    return harmonise.overlap_report(harmonise.merge_sources(s), s)


def gene_counts(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).groupBy("gene").agg(F.count("*").alias("n"))


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).agg(F.countDistinct("gene").alias("genes"), F.countDistinct("scaffold").alias("scaffolds"), F.countDistinct("inchikey").alias("molecules"))


def fill_defaults(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.fill_defaults(cut(_merged(spark, d))).select(*harmonise.KEY, "scaffold", _r("year"))


# ---- similarity


def fp_binarise(spark: SparkSession, d: str) -> DataFrame:
    return similarity.sign_bits(table(spark, d, "embeddings")).select("vec_id", F.col("n_on").cast("long").alias("n_on"), F.concat_ws(",", "pos").alias("bits"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fingerprint").select(F.col("vec_id").alias("set_id"), positions().alias("pos")).filter("size(pos) > 0").withColumn("n_on", F.size("pos"))


def tanimoto_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all."""
    v = _vectors(spark, d)
    return similarity.query_pairs(v.filter("set_id % 100 = 0"), v).select("a", "b", _r("similarity"))


def nn_tanimoto(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of all other vectors for every vector whose id is divisible by 100."""
    v = _vectors(spark, d)
    q = v.filter("set_id % 100 = 0")
    nn = similarity.nearest(q.select(F.lit(0).alias("g"), F.col("set_id").alias("a"), "pos"), v.select(F.lit(0).alias("g"), "set_id", "pos"), ["g"], id_col="set_id")
    return nn.select(F.col("a").alias("vec_id"), _r("nn"))


def first_sets(spark: SparkSession, d: str) -> DataFrame:
    return similarity.first_sets(table(spark, d, "fingerprint"))


def tanimoto_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Distinct vectors of similarity 0.65 or more; copies are folded to the smallest id."""
    v = _vectors(spark, d).groupBy("pos").agg(F.min("set_id").alias("set_id"), F.first("n_on").alias("n_on"))
    return similarity.range_join(cut(v), 0.65).select("a", "b", _r("similarity"))


def _neighbours(spark: SparkSession, d: str, least: float) -> tuple[DataFrame, DataFrame]:
    sets = cut(first_sets(spark, d))
    keys = sets.select("set_id", "inchikey")
    pairs = similarity.range_join(sets, least)
    named = pairs.join(keys.withColumnRenamed("set_id", "a").withColumnRenamed("inchikey", "ka"), "a").join(keys.withColumnRenamed("set_id", "b").withColumnRenamed("inchikey", "kb"), "b")
    return sets, named.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "similarity")


def cluster_sphere(spark: SparkSession, d: str) -> DataFrame:
    sets, pairs = _neighbours(spark, d, 0.65)
    return cluster.sphere_exclusion(sets.select("inchikey"), cut(pairs), "inchikey")


def cluster_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Counts that must be zero: neighbouring centres, members away from their centre; and the number of rows."""
    sets, pairs = _neighbours(spark, d, 0.65)
    pairs = cut(pairs)
    c = cut(cluster.sphere_exclusion(sets.select("inchikey"), pairs, "inchikey"))
    centres = c.select("cluster").distinct()
    near_centres = pairs.join(centres.withColumnRenamed("cluster", "a"), "a", "left_semi").join(centres.withColumnRenamed("cluster", "b"), "b", "left_semi").agg(F.count("*").alias("near_centres"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    stray = c.filter("inchikey <> cluster").join(both, (F.col("a") == F.col("inchikey")) & (F.col("b") == F.col("cluster")), "left_anti").agg(F.count("*").alias("stray_members"))
    return c.agg(F.count("*").alias("n")).join(near_centres, F.lit(True)).join(stray, F.lit(True))


# ---- splits and audit


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """IC50 rows of the merged table: key, inchikey, gene, scaffold, year, y."""
    m = harmonise.fill_defaults(cut(_merged(spark, d).filter("endpoint = 'IC50'")))
    return m.select(F.concat_ws("|", *harmonise.KEY).alias("key"), "inchikey", "gene", "scaffold", "year", F.col("pchembl").alias("y"))


def _sided(spark: SparkSession, d: str) -> DataFrame:
    return cut(splits.split_table(cut(model_rows(spark, d)), "key", PLAN))


def split_random(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_split(model_rows(spark, d), "key").select("key", "side")


def split_time(spark: SparkSession, d: str) -> DataFrame:
    return splits.time_split(model_rows(spark, d), "key").select("key", "side")


def split_grouped(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_split(cut(model_rows(spark, d)), "scaffold").select("key", "side")


def split_grouped_smallest(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_split(cut(model_rows(spark, d)), "scaffold", smallest_first=True).select("key", "side")


def calibration_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.calibration_roles(_sided(spark, d), "key").select("split", "seed", "key", "role")


def exact_dupes(spark: SparkSession, d: str) -> DataFrame:
    return audit.exact_dupes(_sided(spark, d))


def scaffold_straddle(spark: SparkSession, d: str) -> DataFrame:
    return audit.scaffold_straddle(_sided(spark, d))


def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.leakage_audit(_sided(spark, d), cut(first_sets(spark, d)))


def logo_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the held-out gene whose molecule no other gene has, with the verdict on whether they suffice."""
    rows = cut(model_rows(spark, d))
    held, rest = rows.filter("gene = 'KRZF'"), rows.filter("gene <> 'KRZF'")
    own = held.join(rest.select("inchikey").distinct(), "inchikey", "left_anti")
    n = held.agg(F.count("*").alias("n_held")).join(own.agg(F.count("*").alias("n_distinct")), F.lit(True))
    return n.withColumn("n_duplicates", F.col("n_held") - F.col("n_distinct")).withColumn("verdict", F.when(F.col("n_distinct") >= 10, "evaluate").otherwise("too few"))


# ---- models, intervals, figures


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    roles = cut(splits.calibration_roles(_sided(spark, d), "key"))
    _, pairs = _neighbours(spark, d, NEIGHBOUR)
    return cut(models.knn_predict(roles, cut(pairs)))


def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).select("split", "seed", "key", "role", _r("mu"), _r("sigma"), _r("nn"))


def conformal_normalised(spark: SparkSession, d: str) -> DataFrame:
    return conformal.normalised(_predicted(spark, d)).select("split", "seed", "key", F.round(F.log10(F.col("half") + 1), 6).alias("log_half"), "covered")


def conformal_mondrian(spark: SparkSession, d: str) -> DataFrame:
    return conformal.mondrian(_predicted(spark, d)).select("split", "seed", "key", F.col("bin").cast("long").alias("bin"), _r("half"), "covered")


def point_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.point_metrics(_predicted(spark, d).filter("role = 'test'"))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spearman(_predicted(spark, d).filter("role = 'test'"))


def coverage_strata(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage_strata(conformal.mondrian(_predicted(spark, d)))


def evaluate_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fold_result(cut(conformal.mondrian(_predicted(spark, d))))


def _results(spark: SparkSession, d: str) -> DataFrame:
    p = _predicted(spark, d)
    return cut(report.result_rows(metrics.fold_result(cut(conformal.normalised(p))), metrics.coverage_strata(cut(conformal.mondrian(p)))))


def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.seed_summary(_results(spark, d)).select("split", *[_r(c, 4) for c in ("r2", "r2_sd", "rmse", "coverage", "cov_sd", "width", "cov_mond", "width_mond")])


def gap_verdict(spark: SparkSession, d: str) -> DataFrame:
    return report.gap_verdict(report.seed_summary(_results(spark, d))).select(_r("gap", 4), _r("gap_sd", 4), "verdict")


def worst_split(spark: SparkSession, d: str) -> DataFrame:
    return report.worst_split(report.seed_summary(_results(spark, d))).select("split", _r("r2", 4))


def overcoverage(spark: SparkSession, d: str) -> DataFrame:
    return report.overcoverage(report.seed_summary(_results(spark, d))).select("split", _r("coverage", 4), _r("width", 4), _r("cov_mond", 4), _r("width_mond", 4), "improved")


def panel_a(spark: SparkSession, d: str) -> DataFrame:
    rows = _sided(spark, d)
    return report.panel_audit(audit.twin_audit(cut(rows.filter("seed = 1")), cut(first_sets(spark, d))))


def panel_b(spark: SparkSession, d: str) -> DataFrame:
    return report.panel_mean_sd(_results(spark, d), ["r2"]).select("split", "ord", _r("r2_mean", 4), _r("r2_sd", 4))


def panel_c(spark: SparkSession, d: str) -> DataFrame:
    p = report.panel_mean_sd(_results(spark, d), ["coverage", "coverage_mondrian"])
    return p.select("split", "ord", *[_r(f"{c}_{s}", 4) for c in ("coverage", "coverage_mondrian") for s in ("mean", "sd")])


def panel_d(spark: SparkSession, d: str) -> DataFrame:
    return report.panel_widths(_results(spark, d)).select("split", "ord", _r("near", 4), _r("novel", 4))


def evaluate_cluster(spark: SparkSession, d: str) -> DataFrame:
    """The cluster split end to end: clusters, audit figures, both interval methods."""
    sets, pairs = _neighbours(spark, d, NEIGHBOUR)
    pairs = cut(pairs)
    c = cluster.sphere_exclusion(sets.select("inchikey"), pairs.filter("similarity >= 0.65"), "inchikey")
    rows = cut(model_rows(spark, d).join(c, "inchikey", "left").withColumn("cluster", F.coalesce("cluster", "inchikey")))
    roles = cut(splits.calibration_roles(cut(splits.split_table(rows, "key", [("cluster", 1), ("cluster", 2)])), "key"))
    p = cut(models.knn_predict(roles, pairs))
    return report.result_rows(metrics.fold_result(cut(conformal.normalised(p))), metrics.coverage_strata(cut(conformal.mondrian(p))))


def rf_predict_sigma(spark: SparkSession, d: str) -> DataFrame:
    """Forest on hashed positions: fit on the random split's train rows, predict its test rows."""
    from pyspark.ml.feature import HashingTF

    tf = HashingTF(numFeatures=2048, binary=True, inputCol="words", outputCol="features")
    rows = splits.random_split(model_rows(spark, d), "key").join(first_sets(spark, d).select("inchikey", F.transform("pos", lambda p: p.cast("string")).alias("words")), "inchikey")
    data = cut(tf.transform(rows).select("key", "side", "y", "features"))
    out = models.forest_predict(data.filter("side = 'train'"), data.filter("side = 'test'"))
    return out.select("key", _r("mu"), _r("sigma"))


# ---- every endpoint


def endpoint_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the merged table of every endpoint: endpoint, key, inchikey, gene, scaffold, year (the endpoint's median where it is missing), y."""
    m = cut(_merged(spark, d))
    medians = m.groupBy("endpoint").agg(F.median("year").alias("_m"))
    filled = m.join(F.broadcast(medians), "endpoint").withColumn("year", F.coalesce(F.col("year").cast("double"), "_m"))  # one row an endpoint
    return filled.select("endpoint", F.concat_ws("|", *harmonise.KEY).alias("key"), "inchikey", "gene", F.coalesce("scaffold", F.lit("")).alias("scaffold"), "year", F.col("pchembl").alias("y"))


def clustered_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rows of every endpoint with their cluster, neighbours)."""
    sets, pairs = _neighbours(spark, d, NEIGHBOUR)
    pairs = cut(pairs)
    c = cluster.sphere_exclusion(sets.select("inchikey"), pairs.filter("similarity >= 0.65"), "inchikey")
    return cut(endpoint_rows(spark, d).join(c, "inchikey", "left").withColumn("cluster", F.coalesce("cluster", "inchikey"))), pairs


def _evaluated(sided: DataFrame, pairs: DataFrame) -> DataFrame:
    """Results table per endpoint, split and seed; splits with too few rows are left out."""
    roles = cut(splits.calibration_roles(splits.large_enough(sided, EBY), "key", by=("endpoint",)))
    p = cut(models.knn_predict(roles, pairs, by=EBY))
    return report.result_rows(metrics.fold_result(cut(conformal.normalised(p, by=EBY)), by=EBY), metrics.coverage_strata(cut(conformal.mondrian(p, by=EBY)), by=EBY), by=EBY)


def _endpoint_results(spark: SparkSession, d: str) -> DataFrame:
    rows, pairs = cut(endpoint_rows(spark, d)), cut(_neighbours(spark, d, NEIGHBOUR)[1])
    return cut(_evaluated(cut(splits.split_table(rows, "key", PLAN, by=("endpoint",))), pairs))


def endpoint_results(spark: SparkSession, d: str) -> DataFrame:
    """Every endpoint, split and seed but for the cluster split (see pipeline_results)."""
    r = _endpoint_results(spark, d)
    return r.select(*EBY, *[_r(c, 4) for c in r.columns if c not in EBY])


def endpoint_audit(spark: SparkSession, d: str) -> DataFrame:
    sided = cut(splits.split_table(cut(endpoint_rows(spark, d)), "key", PLAN, by=("endpoint",)))
    return audit.leakage_audit(sided, cut(first_sets(spark, d)), by=EBY)


def endpoint_overcoverage(spark: SparkSession, d: str) -> DataFrame:
    """At a nominal coverage of 0.8, so that there are splits that cover more."""
    s = report.seed_summary(_endpoint_results(spark, d), ("endpoint",))
    return report.overcoverage(s, 0.2, ("endpoint",)).select("endpoint", "split", _r("coverage", 4), _r("width", 4), _r("cov_mond", 4), _r("width_mond", 4), "improved")


def endpoint_choice(spark: SparkSession, d: str) -> DataFrame:
    """The endpoint with most rows, which the figures show (ties by name)."""
    n = endpoint_rows(spark, d).groupBy("endpoint").agg(F.count("*").alias("n"))
    return n.agg(F.min_by("endpoint", F.struct(-F.col("n"), "endpoint")).alias("endpoint"), F.max("n").alias("n"))


def pipeline_results(spark: SparkSession, d: str) -> DataFrame:
    """All four splits of every endpoint, the cluster split among them."""
    rows, pairs = clustered_rows(spark, d)
    r = _evaluated(cut(splits.split_table(rows, "key", FULL_PLAN, by=("endpoint",))), pairs)
    return r.select(*EBY, *[_r(c, 4) for c in r.columns if c not in EBY])


def pipeline_audit(spark: SparkSession, d: str) -> DataFrame:
    """Leak figures of all four splits of every endpoint, seed 1."""
    rows, _ = clustered_rows(spark, d)
    plan = [(kind, seed) for kind, seed in FULL_PLAN if seed == 1]
    return audit.leakage_audit(cut(splits.split_table(rows, "key", plan, by=("endpoint",))), cut(first_sets(spark, d)), by=EBY)


def pipeline_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per endpoint of the cluster split: rows, clusters on both sides (none), and whether test holds about a quarter."""
    rows, _ = clustered_rows(spark, d)
    sided = cut(splits.split_table(rows, "key", [("cluster", 1)], by=("endpoint",)))
    torn = sided.groupBy("endpoint", "cluster").agg(F.countDistinct("side").alias("n")).groupBy("endpoint").agg(F.count_if(F.col("n") > 1).alias("n_torn"))
    n = sided.groupBy("endpoint").agg(F.count("*").alias("n_rows"), (F.avg((F.col("side") == "test").cast("double")).between(0.2, 0.35)).alias("about_a_quarter"))
    return n.join(torn, "endpoint")


def logo_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Leave one gene out, per endpoint: its rows whose molecule no other gene has are the test rows, where there are ten or more."""
    rows = cut(endpoint_rows(spark, d))
    rest = rows.filter(F.col("gene") != HELD_GENE)
    own = rows.filter(F.col("gene") == HELD_GENE).join(rest.select("endpoint", "inchikey").distinct(), ["endpoint", "inchikey"], "left_anti")
    both = rest.withColumn("side", F.lit("train")).unionByName(own.withColumn("side", F.lit("test")))
    sided = cut(both.select(F.lit("logo").alias("split"), F.lit(42).alias("seed"), *rows.columns, "side"))
    r = _evaluated(sided, cut(_neighbours(spark, d, NEIGHBOUR)[1]))
    return r.select(*EBY, *[_r(c, 4) for c in r.columns if c not in EBY])


def rf_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """The forest through both kinds of intervals: fit on the fit rows of every endpoint's random split, calibrated, judged on its test rows.

    Features are the vector's positions and, beside them, how many there are and how many others share
    them on average (the counterparts of the counts and descriptors of a chemistry toolkit).
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    sets, pairs = _neighbours(spark, d, NEIGHBOUR)
    rows = cut(endpoint_rows(spark, d).filter("endpoint = 'IC50'").join(sets.select("inchikey", "pos", "n_on"), "inchikey"))
    roles = cut(splits.calibration_roles(splits.large_enough(cut(splits.split_table(rows, "key", [("random", 1)], by=("endpoint",))), EBY), "key", by=("endpoint",)))
    common = F.broadcast(sets.select(F.explode("pos").alias("p")).groupBy("p").agg(F.count("*").alias("c")))  # N_BITS rows
    shared = sets.select("inchikey", F.explode("pos").alias("p")).join(common, "p").groupBy("inchikey").agg(F.avg("c").alias("common"))
    bits = array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(N_BITS - 1)), lambda i: F.array_contains("pos", i).cast("double")))
    data = roles.join(shared, "inchikey").withColumn("bits", bits).withColumn("n_on", F.col("n_on").cast("double"))
    data = cut(VectorAssembler(inputCols=["bits", "n_on", "common"], outputCol="features").transform(data).select(*EBY, "key", "inchikey", "role", "y", "features"))
    told = models.forest_predict(data.filter("role = 'fit'"), data.filter("role <> 'fit'"))
    fit = data.filter("role = 'fit'").select("inchikey").distinct()
    links = pairs.union(pairs.select("b", "a", "similarity")).union(fit.select("inchikey", "inchikey", F.lit(1.0))).toDF("inchikey", "other", "similarity")
    near = links.join(fit.withColumnRenamed("inchikey", "other"), "other", "left_semi").groupBy("inchikey").agg(F.max("similarity").alias("nn"))
    p = cut(data.filter("role <> 'fit'").drop("features").join(told, "key").join(near, "inchikey", "left").withColumn("nn", F.coalesce("nn", F.lit(0.0))))
    r = report.result_rows(metrics.fold_result(cut(conformal.normalised(p, by=EBY)), by=EBY), metrics.coverage_strata(cut(conformal.mondrian(p, by=EBY)), by=EBY), by=EBY)
    return r.select(*EBY, *[_r(c, 4) for c in r.columns if c not in EBY])


# ---- sources and sinks, written from the given tables and read again


def _shared(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dump_measurements(spark: SparkSession, d: str) -> DataFrame:
    """measurement as the eight tables of a database dump, landed and read by the dump reader."""
    m = cut(table(spark, d, "measurement").filter("row_id is not null and mol_id is not null and target_chembl_id is not null").dropDuplicates(["row_id"]))
    ids = lambda c, name: m.select(F.col(c).alias("label")).distinct().select(F.xxhash64("label").alias(name), "label")
    targets, molecules = ids("target_chembl_id", "tid"), ids("mol_id", "molregno")
    smiles = m.groupBy("mol_id").agg(F.min(present("smiles")).alias("canonical_smiles"))
    tables = {
        "component_sequences": targets.select(F.col("tid").alias("component_id"), F.col("label").alias("accession")), "target_components": targets.select(F.col("tid").alias("component_id"), "tid"),
        "target_dictionary": targets.select("tid", F.col("label").alias("chembl_id")), "assays": m.select(F.col("row_id").alias("assay_id"), F.xxhash64("target_chembl_id").alias("tid"), F.when(F.col("row_id") % 5 == 0, "F").otherwise("B").alias("assay_type"), F.col("assay_id").alias("chembl_id")),
        "activities": m.select(F.col("row_id").alias("assay_id"), F.xxhash64("mol_id").alias("molregno"), F.when(usable_year("year").isNotNull(), F.col("row_id")).alias("doc_id"), F.col("endpoint").alias("standard_type"), F.when(F.col("row_id") % 7 == 0, ">").otherwise("=").alias("standard_relation"), F.col("pchembl").cast("string").alias("pchembl_value")),
        "compound_structures": smiles.select(F.xxhash64("mol_id").alias("molregno"), "canonical_smiles"), "molecule_dictionary": molecules.select("molregno", F.col("label").alias("chembl_id")),
        "docs": m.filter(usable_year("year").isNotNull()).select(F.col("row_id").alias("doc_id"), "year"),
    }
    folder = _shared(spark, "dump")
    for name, t in tables.items():
        sinks.write_table(t, f"{folder}/{name}.parquet")
    out = dump.dump_measurements(dump.read_dump(spark, folder=folder), "IC50", FAMILY)
    return out.groupBy("gene", "year").agg(F.count("*").alias("n"), F.round(F.avg("pchembl"), 6).alias("mean"), F.count("assay_id").alias("n_assays"))


def csv_directory(spark: SparkSession, d: str) -> DataFrame:
    """measurement as one CSV folder a gene, read by the reader of export folders."""
    m = table(spark, d, "measurement").filter(F.col("gene").rlike("^KRZ[A-Z]$"))
    cells = m.select("gene", present("smiles").alias("Smiles"), F.col("endpoint").alias("Standard Type"), F.when(F.col("row_id") % 6 == 0, ">").otherwise("'='").alias("Standard Relation"), F.col("pchembl").cast("string").alias("pChEMBL Value"), F.col("year").cast("string").alias("Document Year"))
    path = _shared(spark, "exports")
    cells.write.partitionBy("gene").option("sep", ";").option("header", True).csv(path)
    rows = delimited.read_export_folder(spark, path, "IC50")
    return rows.groupBy("gene").agg(F.count("*").alias("n"), F.round(F.sum("pchembl"), 4).alias("total"), F.count("year").alias("n_year"))


def results_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The counts of every endpoint written as result files by the report sink, and read again by their pattern."""
    n = cut(_merged(spark, d).groupBy("endpoint", "gene").agg(F.count("*").alias("n")))
    folder = _shared(spark, "results")
    n.filter("endpoint is not null").write.partitionBy("endpoint").option("header", True).csv(folder)
    back = spark.read.option("header", True).schema("gene string, n bigint, endpoint string").csv(folder)
    return back.select("endpoint", "gene", "n")


#: Names in the order of the pipeline.
NAMES = """scan_measurements dump_join_chain relation_filter exact_value_guard first_match_columns tsv_tolerant_scan replicate_agg replicate_unique_check union_sources provenance harmonise_merge
overlap_report gene_counts distinct_counts fill_defaults fp_binarise tanimoto_pairs nn_tanimoto tanimoto_range_join cluster_sphere cluster_invariants split_random split_time split_grouped
split_grouped_smallest calibration_split exact_dupes scaffold_straddle leakage_audit logo_distinct knn_predict conformal_normalised conformal_mondrian point_metrics spearman coverage_strata
evaluate_split seed_summary gap_verdict worst_split overcoverage panel_a panel_b panel_c panel_d evaluate_cluster rf_predict_sigma
endpoint_choice endpoint_results endpoint_audit endpoint_overcoverage pipeline_results pipeline_audit pipeline_invariants logo_evaluate rf_evaluate dump_measurements csv_directory results_roundtrip""".split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}
