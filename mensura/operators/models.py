"""Predictors with a mean and a difficulty for every row: similar rows, or a forest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.session import cut, ensure_checkpoint_dir

BY = ["split", "seed"]


def knn_predict(roles: DataFrame, pairs: DataFrame, k: int = 5, key: str = "key", entity: str = "inchikey", by: list[str] = BY) -> DataFrame:
    """(split, seed, key, role, y, mu, sigma, nn) of all cal and test rows.

    mu and sigma are mean and population deviation (+ 1e-6) of y over the k most similar fit rows (ties
    by key), of those whose entity is the row's own or stands in ``pairs`` (a, b, similarity); without
    any they are those of all fit rows. ``nn`` is the largest similarity to a fit row, 0 without any.
    An addition to the forest, for checks that need exact numbers.
    """
    sims = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity"))
    targets = roles.filter("role <> 'fit'").select(*by, key, "role", "y", F.col(entity).alias("_e"))
    fit = roles.filter("role = 'fit'").select(*by, F.col(key).alias("_k"), F.col("y").alias("_y"), F.col(entity).alias("_f"))
    near = sims.select(F.col("a").alias("_e"), F.col("b").alias("_f"), "similarity")
    ids = targets.select("_e").distinct()
    near = near.unionByName(ids.select("_e", F.col("_e").alias("_f"), F.lit(1.0).alias("similarity")))
    met = targets.select(*by, key, "_e").join(near, "_e").join(fit, [*by, "_f"])
    ranked = met.withColumn("_r", F.row_number().over(W.partitionBy(*by, key).orderBy(F.desc("similarity"), "_k"))).filter(F.col("_r") <= k)
    local = ranked.groupBy(*by, key).agg(F.avg("_y").alias("_mu"), F.stddev_pop("_y").alias("_sd"), F.max("similarity").alias("_nn"))
    whole = fit.groupBy(*by).agg(F.avg("_y").alias("_gmu"), F.stddev_pop("_y").alias("_gsd"))
    out = targets.join(local, [*by, key], "left").join(whole, by, "left")
    return out.select(*by, key, "role", "y", F.coalesce("_mu", "_gmu").alias("mu"), F.round(F.coalesce("_sd", "_gsd") + 1e-6, 9).alias("sigma"), F.coalesce("_nn", F.lit(0.0)).alias("nn"))


def forest_predict(fit: DataFrame, targets: DataFrame, features: str = "features", label: str = "y", key: str = "key", trees: int = 20, depth: int = 8, seed: int = 1) -> DataFrame:
    """(key, mu, sigma) of a random forest: mean and population deviation (+ 1e-6) over its trees.

    The leaf every row falls into comes from the model's leaf column; the leaves' values come from the
    saved model's table, so the deviation over trees is a join and an aggregation.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    spark = fit.sparkSession
    forest = RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=seed, leafCol="leaves")
    model = forest.fit(fit)
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    flat = nodes.select("treeID", "nodeData.*").filter("leftChild = -1")
    leaf = cut(flat.withColumn("leaf", F.row_number().over(W.partitionBy("treeID").orderBy("id")) - 1).select("treeID", "leaf", "prediction"))
    saved = spark._jvm.org.apache.hadoop.fs.Path(path)
    saved.getFileSystem(spark._jsc.hadoopConfiguration()).delete(saved, True)  # the model's files are read and no longer needed
    placed = model.transform(targets).select(key, F.posexplode(vector_to_array("leaves")).alias("treeID", "at")).withColumn("leaf", F.col("at").cast("int"))
    each = placed.join(leaf, ["treeID", "leaf"])
    return each.groupBy(key).agg(F.avg("prediction").alias("mu"), (F.stddev_pop("prediction") + 1e-6).alias("sigma"))
