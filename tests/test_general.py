"""Filling years and drifting schemas on small inputs; queries against SQL on the smallest tables."""

import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mensura.functions.keys import usable_year
from mensura.operators import fill_missing, schema_drift
from mensura.operators.fill_missing import fill_from_clusters
from mensura.operators.schema_drift import correspondences, schema_changes, unified

DATA = "/root/testdata/sf0.001"


def fill(df):
    return fill_from_clusters(df, usable_year("year"), F.upper(F.trim("assay")), {"x": F.col("x")}, {"g": F.col("g")}, k=3, out="f", method="m")


def test_fill_levels_ties_nulls_and_clashing_names(spark):
    data = [(1, "A1", 2001, 1.0, "u", 0), (2, " a1", 2002, 1.0, "u", 0), (3, "a1 ", None, None, None, 0), (4, None, 9999, 9.0, "v", 0), (5, "B", 2010, 9.0, "v", 0), (6, "B", 2010, 9.1, "v", 0), (7, "B", 2000, 9.1, "v", 0), (8, "B", -1, None, None, 0), (9, "C", None, 1.0, "u", 0)]
    df = spark.createDataFrame(data, "row_id long, assay string, year int, x double, g string, f int")
    got = {r["row_id"]: (r["f"], r["m"]) for r in fill(df).collect()}
    assert len(got) == 9 and got[1] == (2001, "observed") and got[3] == (2001, "entity") and got[8] == (2010, "entity")
    assert got[4][1] in ("cluster", "table") and got[9][0] in (2001, 2002)
    assert fill(df.limit(0)).count() == 0
    assert {r["m"] for r in fill(df.withColumn("year", F.lit(None).cast("int"))).collect()} == {"none"}


def make(spark, files, extra=False):
    f = spark.createDataFrame([(i, s, "G", "f", f"2020-01-{i:02d} 00:00:00") for i, s, _ in files], "file_id long, series_id long, gene string, file_name string, at string").withColumn("exported_at", F.to_timestamp("at"))
    lines = [(i, n + 1, t) for i, _, text in files for n, t in enumerate(text)]
    return f, spark.createDataFrame(lines + lines[:2], "file_id long, line_no long, line_text string")


def test_schema_changes(spark):
    body = [(f"C{i}N{i}(C)", f"MOL{i:07d}", f"{5 + i / 10:.2f}", str(2000 + i), "NA") for i in range(12)]
    one = ["﻿Smiles;Molecule ChEMBL ID;pChEMBL Value;Document Year;Old"] + [";".join(b) for b in body]
    two = ['"SMILES ","Compound Ref","Neg Log Value","Document Year","Extra"'] + [f'"{a}","{b}","{c.replace(".", ",")}","{d}.0","x;{i}"' for i, (a, b, c, d, _) in enumerate(body)]
    three = ["Extra\tDocument Year\tNeg Log Value\tCompound Ref\tSMILES"] + [f'q\t{d}.0\t{float(c):.2e}\t{b}\t{{"smi": "{a}", "v": 0}}' for a, b, c, d, _ in body]
    f, lines = make(spark, [(1, 7, one), (2, 7, two), (3, 7, three), (9, 8, one)])
    got = set(rows(schema_changes(f, lines), "file_id", "change_type", "column_name"))
    assert got == {
        (2, "renamed", "Compound Ref"), (2, "renamed", "Neg Log Value"), (2, "retyped", "Neg Log Value"), (2, "retyped", "Document Year"), (2, "removed", "Old"), (2, "added", "Extra"),
        (3, "retyped", "Neg Log Value"), (3, "retyped", "SMILES"),
    }
    u = unified(f, lines, schema_changes(f, lines))
    assert rows(u.filter("file_id = 3 and line_no = 2"), "smiles", "pchembl", "year", "mol_id") == [("C0N0(C)", 5.0, 2000, "MOL0000000")]
    assert schema_changes(f.limit(0), lines.limit(0)).count() == 0


def test_unified_keeps_every_field_and_line(spark):
    body = [(f"C{i}N{i}(C)", f"{5 + i / 10:.2f}", f"note {i}") for i in range(12)]
    mine = ["Smiles", "Neg Log Value", "Potency", "Score Reported", "pA"]
    files = [(k, 7, [f"Smiles;{'pChEMBL Value' if k == 1 else mine[k - 1]};{'Remark' if k < 4 else 'Assay Note'}"] + [";".join(b) for b in body]) for k in range(1, 6)]
    files[4][2].extend(["NA;NA;NA", "CC;5.5;x;beyond"])
    files.append((6, 8, ["Smiles,Batch,smiles,", "CC,B1,CO,loose"]))
    f, lines = make(spark, files)
    renamed = [(k, "renamed", a.lower(), b.lower()) for k, a, b in [(2, "pChEMBL Value", mine[1]), (3, mine[1], mine[2]), (4, mine[2], mine[3]), (5, mine[3], mine[4]), (4, "Remark", "Assay Note")]]
    changes = spark.createDataFrame(renamed, "file_id long, change_type string, old string, new string")
    got = {(r["file_id"], r["line_no"]): r for r in unified(f, lines, changes).collect()}
    assert len(got) == 5 * 12 + 3
    assert [got[k, 3]["pchembl"] for k in range(1, 6)] == [5.1] * 5
    assert [got[k, 3]["other"] for k in range(1, 6)] == [{"remark": "note 1"}] * 5
    assert got[5, 14]["smiles"] is None and got[5, 14]["other"] == {} and got[5, 15]["other"] == {"remark": "x", "#4": "beyond"}
    assert got[6, 2]["smiles"] == "CC" and got[6, 2]["other"] == {"batch": "B1", "smiles#3": "CO", "#4": "loose"}


def test_equal_names_are_always_one_field():
    col = lambda name, sketch: {"name": name, "header": name, "form": "text", "n": 1, "len": 3.0, "sketch": sketch}
    assert set(correspondences([col("a", [1]), col("b", [2])], [col("b", [1]), col("a", [2])])) == {(0, 1), (1, 0)}
    assert correspondences([], []) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", ["p5_found", "harmonise_merge", "overlap_report", "tanimoto_range_join", "split_grouped", "exact_dupes", "conformal_mondrian", "seed_summary", "dump_join_chain", "tsv_tolerant_scan"])
def test_queries_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    norm = lambda t: tuple("~" if x is None or x != x else str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in t)
    assert sorted(norm(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(norm, want))


def column(name, form="text", values=(), members=()):
    return {"name": name, "header": name, "pos": 0, "form": form, "n": len(values), "len": 5.0, "sketch": list(values), "members": list(members)}


def test_flooding_decides_the_correspondences():
    a = [column("smiles", "text", range(40)), column("pchembl value", "point", range(100, 140)), column("document year", "whole", range(200, 220)), column("batch code", "text", range(300, 310))]
    b = [column("structure", "json", range(5, 45), ["smi", "v"]), column("paffinity", "point", range(110, 150)), column("document year", "date", range(200, 220)), column("activity comment", "text", range(400, 410))]
    assert sorted(schema_drift.correspondences(a, b)) == [(0, 0), (1, 1), (2, 2)]
    assert schema_drift.correspondences(a, b, rounds=0) == []  # without propagation no pair of columns has any score, equal names neither
    once, settled = schema_drift.flood(a, b, rounds=1), schema_drift.flood(a, b)
    assert settled.shape == (4, 4) and settled[2, 2] == 1.0 and (once != settled).any()
    # no values in common: names, types, order and members still find an object's member that is called like the column
    plain, nested = [column("smiles"), column("assay id")], [column("payload", "json", members=["smiles"]), column("assay id")]
    assert schema_drift.correspondences(plain, nested) and (0, 0) in schema_drift.correspondences(plain, nested)
    assert schema_drift.correspondences([], b) == [] and schema_drift.correspondences(a, []) == []


def test_casts_are_learnt_from_the_other_files(spark):
    head = "Smiles;pChEMBL Value;Assay ChEMBL ID;Document Year"
    files = spark.createDataFrame([(i, 1, "AA", f"f{i}", i) for i in range(3)], "file_id long, series_id long, gene string, file_name string, exported_at int")
    rows = [(0, 1, head)] + [(0, 2 + i, f"C{'C' * i}O;{5 + i / 10};XY{i + 1:04d};{2001 + i}") for i in range(12)]
    rows += [(1, 1, "Smiles;pChEMBL Value;Assay ChEMBL ID;Document Year")] + [(1, 2 + i, '"{""a"": ""x%d"", ""mol"": ""C%sO""}";%d;%d;%d' % (i, "C" * i, 5000 + 100 * i, i + 1, 2001 + i)) for i in range(12)]
    lines = spark.createDataFrame(rows, "file_id long, line_no long, line_text string")
    table = schema_drift.unified(files, lines, schema_drift.schema_changes(files, lines))
    got = {(r["file_id"], r["line_no"]): r for r in table.collect()}
    for i in range(12):
        a, b = got[0, 2 + i], got[1, 2 + i]
        assert (a["smiles"], a["pchembl"], a["assay_id"], a["year"]) == (b["smiles"], b["pchembl"], b["assay_id"], b["year"]) == (f"C{'C' * i}O", 5 + i / 10, f"XY{i + 1:04d}", 2001 + i)


def test_clusters_say_more_than_the_table(spark):
    """Three kinds of rows with years of their own; entities know nothing. The cluster's median is near, the table's is not, and a hot entity is filled like others."""
    rng = random.Random(3)
    data = [(i, f"e{i % 7}" if i % 2 else None, 2000 + 10 * (i % 3) + rng.randrange(3), float(i % 3) + rng.random() / 5, "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(data, "row_id long, assay string, year int, x double, g string")
    error = lambda k: {r["level"]: r["mean_error"] for r in fill_missing.held_out_error(df, usable_year("year"), F.lit(None).cast("string"), {"x": F.col("x")}, {"g": F.col("g")}, F.col("row_id"), k=k).collect()}
    found = error(8)
    assert found["cluster"] < 2 < 5 < found["table"] and found["entity"] is None
    assert error(1)["cluster"] > 5  # without clusters nothing is gained
    masked = F.when(F.col("row_id") % 4 > 0, usable_year("year"))
    fill = lambda hot: rows(fill_from_clusters(df, masked, F.col("assay"), {"x": F.col("x")}, {"g": F.col("g")}, k=3, out="f", method="m", hot=hot), "row_id", "f", "m")
    assert fill(5) == fill(100_000)
    kinds = fill_from_clusters(df.withColumn("c", F.when(F.col("row_id") % 5 > 0, F.col("g"))), F.col("c"), F.lit(None).cast("string"), {"x": F.col("x")}, {}, k=12, out="f", method="m", kind="category")
    assert all(r["f"] == r["g"] for r in kinds.collect()) and {r["m"] for r in kinds.select("m").distinct().collect()} == {"observed", "cluster"}
