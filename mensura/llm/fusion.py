"""One record per group of duplicates, by a latent two-sided quality model of the sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.functions.keys import compact, finite, molecule_key, present, trimmed, usable_year, with_molecule, with_target
from mensura.session import cut

#: Fields that a record states once.
SINGLE = ("pchembl", "year", "std_smiles")


@dataclass
class Fusion:
    """members: rec_id, group_id (smallest rec_id), n_agreeing; survivors: one row per group; quality: field, source, sensitivity, specificity."""

    members: DataFrame
    survivors: DataFrame
    quality: DataFrame


def source_quality(facts: DataFrame, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """Expectation-maximisation over facts: (posterior per pattern, quality per field and source).

    ``facts`` has field and pattern, an array of (source, claimed) over the sources that say anything
    about the fact's group and field. A fact is true or not, with the field's prevalence; a source claims a
    true one with its sensitivity and a false one with one minus its specificity. All three are estimated
    in every round. Facts of one pattern share their posterior, so the facts are folded to pattern counts
    once and all rounds run on those.
    """
    patterns = cut(facts.groupBy("field", "pattern").agg(F.count("*").cast("double").alias("n")).withColumn("pid", F.xxhash64("field", F.to_json("pattern"))))
    votes = patterns.select("pid", "field", "n", F.inline("pattern"))
    # a vote's first posterior: the share of the heard sources that claim the fact
    post = patterns.select("pid", "field", "n", "pattern", F.expr("(aggregate(pattern, 0D, (a, x) -> a + x.claimed) + 0.5) / (size(pattern) + 1)").alias("p"))
    quality = None
    for r in range(rounds):
        v = post.select("pid", "field", "n", "p", F.inline("pattern"))
        w, t = F.col("n"), F.col("p")
        quality = v.groupBy("field", "source").agg(
            ((F.sum(w * t * F.col("claimed")) + 8) / (F.sum(w * t) + 10)).alias("sensitivity"),
            ((F.sum(w * (1 - t) * (1 - F.col("claimed"))) + 8) / (F.sum(w * (1 - t)) + 10)).alias("specificity"),
        )
        odds = F.when(F.col("claimed") == 1, F.log(F.col("sensitivity") / (1 - F.col("specificity")))).otherwise(F.log((1 - F.col("sensitivity")) / F.col("specificity")))
        share = (F.sum(w * t) + 1) / (F.sum(w) + 2)  # of true facts
        prior = post.select("field", "n", "p").groupBy("field").agg(F.log(share / (1 - share)).alias("prior"))
        heard = votes.join(quality, ["field", "source"]).groupBy("pid", "field").agg(F.sum(odds).alias("heard"))
        belief = heard.join(prior, "field").select("pid", (1 / (1 + F.exp(-(F.col("heard") + F.col("prior"))))).alias("p"))
        post = patterns.join(belief, "pid").select("pid", "field", "n", "pattern", "p")
        if r % 3 == 2 or r == rounds - 1:
            post = cut(post)
    return post.select("pid", "p"), quality


def patterned(said: DataFrame) -> DataFrame:
    """Facts (group_id, field, value, n, at, pattern, pid) of what ``said`` (group_id, field, value, source, n, at) states, with the claims of all sources that are heard on the group and field."""
    facts = said.groupBy("group_id", "field", "value").agg(F.collect_set("source").alias("claiming"), F.sum("n").alias("n"), F.max("at").alias("at"))
    heard = said.groupBy("group_id", "field").agg(F.collect_set("source").alias("heard"))  # bounded by the number of sources
    pattern = F.transform(F.sort_array("heard"), lambda s: F.struct(s.alias("source"), F.array_contains("claiming", s).cast("int").alias("claimed")))
    facts = facts.join(heard, ["group_id", "field"]).withColumn("pattern", pattern).withColumn("pid", F.xxhash64("field", F.to_json("pattern")))
    return cut(facts.select("group_id", "field", "value", "n", "at", "pattern", "pid"))


def named_molecules(records: DataFrame, rounds: int = 8) -> DataFrame:
    """``records`` with ``molecule``; where records without a key have a text for which others state several keys, the model judges which one is true.

    A text that states one key takes it. Of several, each is a fact of that text, claimed by the sources
    that state it: the highest posterior wins, then the key that more records state, then the smallest.
    """
    records = cut(records)
    keyed = records.withColumn("__key", molecule_key("inchikey")).withColumn("__text", present("std_smiles"))
    lost = keyed.filter("__key is null and __text is not null").select("__text").distinct()
    stated = keyed.filter("__key is not null").join(lost, "__text", "left_semi").groupBy("__text", "__key", F.coalesce(F.lower(present("source")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    several = cut(stated.groupBy("__text").agg(F.countDistinct("__key").alias("k")).filter("k > 1").select("__text"))
    plain = with_molecule(records)
    if several.isEmpty():
        return plain
    said = stated.join(several, "__text").select(F.col("__text").alias("group_id"), F.lit("inchikey").alias("field"), F.col("__key").alias("value"), "source", "n", F.lit(None).cast("timestamp").alias("at"))
    facts = patterned(said)
    post, _ = source_quality(facts, rounds)
    judged = facts.join(post, "pid").groupBy(F.col("group_id").alias("__text")).agg(F.min_by("value", F.struct((-F.round("p", 9)).alias("p"), (-F.col("n")).alias("n"), "value")).alias("__best"))
    bare = plain.withColumn("__text", F.when(molecule_key("inchikey").isNull(), present("std_smiles")))
    return bare.join(judged, "__text", "left").withColumn("molecule", F.coalesce("__best", "molecule")).drop("__text", "__best")


def fuse_records(records: DataFrame, targets: DataFrame, rounds: int = 8) -> Fusion:
    """Fuse the records that report the same molecule, target and endpoint.

    A group's facts are the values its records state per field: pchembl (0 to 14, two decimals), year
    (1970 to 2026), std_smiles (no outer blanks) and each member of sources (separators and case do not
    count). Of a single-valued field the value with the highest posterior survives, then the one more
    records state, then the later year or smaller text; of ``sources`` every value judged true (posterior
    at least 0.5), or the best one if none is. Values no record states stay null. Records without
    molecule, target or endpoint belong to no group and appear nowhere. Repeated rows (same rec_id)
    count once. Extra columns are ignored. Everything is keyed aggregation; a group's records are
    never gathered.
    """
    own = records.select("rec_id", "inchikey", "gene", "endpoint", "std_smiles", "pchembl", "year", "target_chembl_id", "source", "sources", "updated_at")
    clean = with_target(named_molecules(own.filter("rec_id is not null").dropDuplicates(["rec_id"]), rounds), targets).withColumn("endpoint_key", compact("endpoint"))
    clean = clean.filter("molecule is not null and target is not null and endpoint_key is not null")
    clean = clean.select(
        "rec_id", "molecule", "target", "endpoint_key",
        F.coalesce(F.lower(present("source")), F.lit("unknown")).alias("source"),
        F.when(finite("pchembl").between(0, 14), F.round("pchembl", 2).cast("string")).alias("pchembl"),
        usable_year("year").cast("string").alias("year"), present("std_smiles").alias("std_smiles"),
        F.split(F.lower(F.coalesce(trimmed("sources"), F.lit(""))), "\\s*[,;|/]\\s*").alias("sources"), F.col("updated_at").alias("at"),
    )
    clean = cut(clean)
    key = ["molecule", "target", "endpoint_key"]
    firsts = clean.groupBy(*key).agg(F.min("rec_id").alias("group_id"), F.count("*").alias("n_records"))
    named = cut(clean.join(firsts.select(*key, "group_id"), key))
    values = F.array(
        *[F.struct(F.lit(f).alias("field"), F.array(F.col(f)).alias("vs")) for f in SINGLE],
        F.struct(F.lit("sources").alias("field"), F.col("sources").alias("vs")),
    )
    said = (
        named.select("group_id", "source", "at", "rec_id", F.inline(values)).select("group_id", "source", "at", "field", F.explode("vs").alias("value"))
        .filter("value is not null and value <> ''")
        .groupBy("group_id", "field", "value", "source").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    )
    facts = patterned(said)
    post, quality = source_quality(facts, rounds)
    judged = facts.join(post, "pid").select("group_id", "field", "value", "n", "p", "at")
    rank = F.struct("p", "n", "at", "value")
    best = judged.groupBy("group_id", "field").agg(F.max_by("value", rank).alias("best"), F.max("p").alias("p"), F.sort_array(F.collect_set(F.when(F.col("p") >= 0.5, F.col("value")))).alias("all_true"))
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    wide = best.groupBy("group_id").agg(
        *[pick(f, "best").alias(f"best_{f}") for f in SINGLE], *[pick(f, "p").alias(f"p_{f}") for f in SINGLE],
        F.concat_ws(",", F.max(F.when(F.col("field") == "sources", F.when(F.size("all_true") > 0, F.col("all_true")).otherwise(F.array("best"))))).alias("sources"),
    )
    survivors = firsts.join(wide, "group_id", "left").select(
        "group_id", *key, "n_records", F.col("best_pchembl").cast("double").alias("pchembl"), F.col("sources"), F.col("best_year").cast("int").alias("year"), F.col("best_std_smiles").alias("std_smiles"),
        *[F.round(f"p_{f}", 6).alias(f"p_{f}") for f in SINGLE],
    )
    agree = lambda f: (F.col(f) == F.col(f"best_{f}")).cast("int")
    members = named.join(wide, "group_id", "left").select("rec_id", "group_id", sum((F.coalesce(agree(f), F.lit(0)) for f in SINGLE), F.lit(0)).alias("n_agreeing"))
    return Fusion(members, survivors, quality)


def duplicate_pairs(members: DataFrame, salts: int = 16, hot: int = 1000) -> DataFrame:
    """Each pair of records of one group, smaller rec_id first (a fixed result form).

    The groups are joined by key; the records of a group of more than ``hot`` are dealt over ``salts`` parts
    on one side and copied to all of them on the other, so that no task holds all pairs of a large group.
    """
    big = members.groupBy("group_id").agg(F.count("*").alias("size")).filter(F.col("size") > hot).select("group_id", F.lit(salts).alias("parts"))
    placed = cut(members.select("group_id", "rec_id").join(big, "group_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1))))
    a = placed.select("group_id", F.pmod(F.xxhash64("rec_id"), F.col("parts")).cast("int").alias("part"), F.col("rec_id").alias("rec_id_a"))
    b = placed.select("group_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rec_id").alias("rec_id_b"))
    return a.join(b, ["group_id", "part"]).filter("rec_id_a < rec_id_b").select("rec_id_a", "rec_id_b")
