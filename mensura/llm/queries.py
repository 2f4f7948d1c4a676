"""Queries of the numbered problems of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.functions.keys import usable_year, with_molecule, with_target
from mensura.llm import clusters, fusion, leakage, neighbours, oracle, overlap, packing, quality, splits
from mensura.session import cut
from mensura.sources.tables import table


def _fused(spark: SparkSession, folder: str) -> fusion.Fusion:
    return fusion.fuse_records(table(spark, folder, "compound_target"), table(spark, folder, "target_dictionary"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.duplicate_pairs(cut(_fused(spark, folder).members))


def p1_best(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder).survivors


def p1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder).quality


def p1_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and records, and surviving years that no record of the group states (none)."""
    f = _fused(spark, folder)
    members, survivors = cut(f.members), cut(f.survivors)
    stated = table(spark, folder, "compound_target").select("rec_id", usable_year("year").alias("year")).join(members, "rec_id").select("group_id", "year").distinct()
    made_up = survivors.filter("year is not null").join(stated, ["group_id", "year"], "left_anti").agg(F.count("*").alias("n_made_up"))
    return survivors.agg(F.count("*").alias("n_groups"), F.sum("n_records").cast("long").alias("n_records"), F.count("year").alias("n_year")).join(made_up, F.lit(True))


def _overlap(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlapping_records(*(table(spark, folder, t) for t in ("split_member", "compound_target", "fingerprint")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlap(spark, folder).select("split_name", "rec_id")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_overlap(spark, folder), table(spark, folder, "split_member"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and near counts of the leak report per split and source."""
    return p2_report(spark, folder).select("split_name", "source", "n_overlapping", "exact_dupe_keys", "near_dupes")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.neighbour_pairs(table(spark, folder, "fingerprint"))
    return pairs.select(F.col("id_a").alias("vec_id_a"), F.col("id_b").alias("vec_id_b"))


def p4_split(spark: SparkSession, folder: str) -> DataFrame:
    """By molecule and scaffold."""
    records = with_molecule(table(spark, folder, "compound_target").select("rec_id", "inchikey", "std_smiles", "scaffold"))
    return splits.assign_splits(records, [F.col("molecule"), splits.scaffold_key()])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    assigned = p4_split(spark, folder)
    return assigned.filter("group_size > 1 and id <> group_id").select(F.col("group_id").alias("first_rec_id"), F.col("id").alias("rec_id"))


def p4_split_year(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(table(spark, folder, "compound_target").select("rec_id", "year"), [usable_year("year")])


def p4_split_gene(spark: SparkSession, folder: str) -> DataFrame:
    records = with_target(table(spark, folder, "compound_target").select("rec_id", "gene", "target_chembl_id"), table(spark, folder, "target_dictionary"))
    return splits.assign_splits(records, [F.col("target")])


def p4_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of key: records, keys, keys that stand in two splits, and whether keyed records reach valid and test."""
    t = table(spark, folder, "compound_target")
    records = with_target(with_molecule(t.select("rec_id", "inchikey", "std_smiles", "scaffold", "year", "gene", "target_chembl_id")), table(spark, folder, "target_dictionary"))
    keyed = {"molecule": (p4_split, F.col("molecule")), "scaffold": (p4_split, splits.scaffold_key()), "year": (p4_split_year, usable_year("year").cast("string")), "gene": (p4_split_gene, F.col("target"))}
    out, assigned = None, {}
    for name, (query, key) in keyed.items():
        if query not in assigned:
            assigned[query] = cut(query(spark, folder).select("id", "split"))
        rows = records.select(F.col("rec_id").alias("id"), key.alias("key")).join(assigned[query], "id")
        per_key = rows.filter("key is not null").groupBy("key").agg(F.countDistinct("split").alias("n"), F.max((F.col("split") == "valid").cast("int")).alias("v"), F.max((F.col("split") == "test").cast("int")).alias("t"))
        figures = per_key.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_torn"), (F.max("v") == 1).alias("in_valid"), (F.max("t") == 1).alias("in_test"))
        part = rows.agg(F.countDistinct("id").alias("n_records")).join(figures, F.lit(True)).withColumn("kind", F.lit(name))  # two rows of one
        out = part if out is None else out.unionByName(part)
    return out


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    members = clusters.similar_groups(table(spark, folder, "fingerprint"))
    return members.filter("vec <> cluster").select(F.col("cluster").alias("first_vec_id"), F.col("vec").alias("vec_id"))


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Dense clusters, each with its size and most typical members."""
    return clusters.describe(clusters.similar_groups(table(spark, folder, "fingerprint"), apart=True))


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors, the sum of the clusters' sizes, and vectors whose dense cluster reaches out of their group (none)."""
    vectors = table(spark, folder, "fingerprint")
    dense = cut(clusters.similar_groups(vectors, apart=True).select("vec", F.col("cluster").alias("dense")))
    groups = cut(clusters.similar_groups(vectors).select("vec", "cluster"))
    out = dense.join(groups, "vec").groupBy("dense").agg(F.countDistinct("cluster").alias("n"), F.count("*").alias("size"))
    return out.agg(F.sum("size").cast("long").alias("n_vectors"), F.count_if(F.col("n") > 1).alias("n_reaching_out"))


def p8_pack_2048(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), 2048)


def p8_pack_8192(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), 8192)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(cut(p8_pack_2048(spark, folder)), 2048).unionByName(packing.fill_report(cut(p8_pack_8192(spark, folder)), 8192))


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: documents packed, sequences that hold too much, documents cut without need, tokens that lie over each other (none)."""
    out = None
    for capacity, query in ((2048, p8_pack_2048), (8192, p8_pack_8192)):
        p = cut(query(spark, folder))
        seqs = p.groupBy("sequence").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("to"))
        docs = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.countDistinct("start").alias("starts"))
        a = seqs.agg(F.count_if(F.col("n") > capacity).alias("n_over"), F.count_if(F.col("to") != F.col("n")).alias("n_lapping"))
        b = docs.agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("n_cut"))
        part = a.join(b, F.lit(True)).withColumn("capacity", F.lit(capacity))  # two rows of one
        out = part if out is None else out.unionByName(part)
    return out


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def p9_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks among them that repeat twelve words or more of the item verbatim."""
    return _leaks(spark, folder).filter("longest >= 12").select("doc_id", "item_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold no held-out passage, with their text."""
    docs = table(spark, folder, "documents")
    return leakage.without_leaks(docs.select("doc_id", "text", "lang", "source"), cut(_leaks(spark, folder).select("doc_id")))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_statistics(table(spark, folder, "documents"))


def p10_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words and their characters of every document."""
    counted = quality.text_counts(table(spark, folder, "documents"))
    return counted.select("doc_id", *[F.col("counts")[quality.AT[n]].cast("long").alias(n) for n in ("words", "word_chars")]).distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_statistics(spark, folder).filter("text_kind <> 'prose'").select("doc_id", "text_kind")


def queries() -> dict:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
