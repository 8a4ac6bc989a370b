"""Queries of the iterative methods: evolutionary mining, clustering, principal components. Rows only, no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.plans import evolution
from lagweave.plans.catalogue_pool import pool
from lagweave.plans.catalogue_rules import PARAMS, _panel


def gnp_mine(spark, d):
    items, series = _panel(spark, d)
    return evolution.mine(items, series, PARAMS)


def gnp_pool(spark, d):
    items, series = _panel(spark, d)
    return evolution.merged_pool(evolution.mine(items, series, PARAMS))


def gnp_log(spark, d):
    items, series = _panel(spark, d)
    return evolution.mine(items, series, PARAMS, log=True)


def gnp_trials(spark, d):
    items, series = _panel(spark, d)
    return evolution.trial_statistics(evolution.mine(items, series, PARAMS))


def gnp_tightness(spark, d):
    """The same search by the alternative fitness, which asks for narrow distributions; the pool of all trials."""
    items, series = _panel(spark, d)
    return evolution.merged_pool(evolution.mine(items, series, PARAMS, credit=evolution.tightness_fitness))


CLUSTERED = ["x_mean", "x_sigma", "x2_mean", "x2_sigma", "concentration"]


def _features(spark, d):
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    p = pool(spark, d).dropna(subset=CLUSTERED)
    v = VectorAssembler(inputCols=CLUSTERED, outputCol="raw").transform(p.select("rule_id", *CLUSTERED))
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)


def cluster_rules(spark, d):
    """Cluster sizes and means of the standardized statistics (k = 3, seeded)."""
    from pyspark.ml.clustering import KMeans

    v = _features(spark, d)
    got = KMeans(k=3, seed=7, maxIter=30).fit(v).transform(v)
    return got.groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in CLUSTERED))


def principal_components(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = _features(spark, d)
    got = PCA(k=2, inputCol="features", outputCol="pc").fit(v).transform(v).withColumn("pc", vector_to_array("pc"))
    return got.select("rule_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


QUERIES = {f.__name__: f for f in (gnp_mine, gnp_pool, gnp_log, gnp_trials, gnp_tightness, cluster_rules, principal_components)}
ORACLE: dict[str, str] = {}
