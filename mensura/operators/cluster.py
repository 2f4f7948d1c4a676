"""Sphere-exclusion clusters: densest free row first, each claims its free neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.session import cut


def sphere_exclusion(ids: DataFrame, pairs: DataFrame, id_col: str = "set_id", max_rounds: int = 1000) -> DataFrame:
    """(id, cluster): cluster is the id of the row that claimed it.

    ``pairs`` (a, b) are the neighbours, each pair once. Rows are ranked by number of neighbours, then
    id. A row that no undecided neighbour precedes becomes a centre and its neighbours are covered; this
    repeats until all are decided, which gives the same clusters as going through the rows one by one.
    A row belongs to the first of the centres next to it. Rows without neighbours are their own.
    """
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j")).union(pairs.select("b", "a"))
    degree = both.groupBy("i").agg(F.count("*").alias("d"))
    rank = lambda d, i: F.struct((-F.col(d)).alias("d"), F.col(i).alias("i"))
    edges = cut(both.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j").select("i", "j", rank("d", "i").alias("pi"), rank("dj", "j").alias("pj")))
    free = edges.select("i").distinct()
    open_edges, centres = edges, None
    for _ in range(max_rounds):
        late = open_edges.filter("pj < pi").select("i").distinct()
        new = cut(free.join(late, "i", "left_anti"))
        if new.isEmpty():
            break
        centres = new if centres is None else centres.union(new)
        covered = open_edges.join(new.withColumnRenamed("i", "j"), "j", "left_semi").select("i").distinct()
        free = cut(free.join(new, "i", "left_anti").join(covered, "i", "left_anti"))
        open_edges = cut(open_edges.join(free, "i", "left_semi").join(free.withColumnRenamed("i", "j"), "j", "left_semi"))
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    alone = ids.select(F.col(id_col).alias("i"))
    if centres is None:
        return alone.select(F.col("i").alias(id_col), F.col("i").alias("cluster"))
    centres = cut(centres)
    claimed = edges.join(centres.withColumnRenamed("i", "j"), "j", "left_semi").join(centres, "i", "left_anti").groupBy("i").agg(F.min_by("j", "pj").alias("c"))
    return alone.join(claimed, "i", "left").select(F.col("i").alias(id_col), F.coalesce("c", "i").alias("cluster"))
