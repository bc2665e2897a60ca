"""Additive attributions of linear models, and attribution fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear_terms(features: list[str], weight: dict, center: dict, scale: dict) -> dict[str, Column]:
    """phi_j = w_j (x_j - E[x_j]) / s_j: the exact interventional Shapley value of a linear margin."""
    return {
        f: F.lit(float(weight[f])) * ((F.col(f) - F.lit(float(center[f]))) / F.lit(float(scale[f]))) for f in features
    }


def linear_margin(features: list[str], weight: dict, center: dict, scale: dict, intercept: float) -> Column:
    return reduce(lambda a, b: a + b, linear_terms(features, weight, center, scale).values(), F.lit(float(intercept)))


def wide_attributions(df: DataFrame, keys: list[str], features: list[str], weight: dict, center: dict, scale: dict, decimals: int = 9) -> DataFrame:
    """(keys, features): every feature replaced by its part of the margin."""
    terms = linear_terms(features, weight, center, scale)
    return df.select(*keys, *[F.round(t, decimals).alias(f) for f, t in terms.items()])


def linear_attributions(
    df: DataFrame, keys: list[str], features: list[str], weight: dict, center: dict, scale: dict, decimals: int = 9
) -> DataFrame:
    """Long (keys, feature, phi), one projection and one unpivot, no shuffle."""
    return wide_attributions(df, keys, features, weight, center, scale, decimals).unpivot(keys, features, "feature", "phi")


def fingerprint(attributions: DataFrame, keys: list[str] = (), decimals: int = 9) -> DataFrame:
    """Per feature mean |phi|, mean phi, population std, count and importance rank (1 = top).

    Ties in importance go to the feature name. The rank window holds at most one row per feature.
    """
    stats = attributions.groupBy(*keys, "feature").agg(
        F.round(F.avg(F.abs("phi")), decimals).alias("mean_abs"),
        F.round(F.avg("phi"), decimals).alias("mean"),
        F.round(F.stddev_pop("phi"), decimals).alias("std"),
        F.count("phi").alias("n"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("mean_abs").desc(), "feature"))
    return stats.withColumn("rank", rank)


def top_features(ranked: DataFrame, score: str, k: int, keys: list[str], name: str) -> DataFrame:
    """Array of the k best features per group, best first; at most k values are ever collected."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "feature")
    best = ranked.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= k)
    return best.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rk", "feature"))), lambda s: s["feature"]).alias(name)
    )


def first_features(flagged: DataFrame, features: list[str], k: int, keys: list[str], name: str) -> DataFrame:
    """Array of the first k flagged features per group, in the order of ``features``."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    found = flagged.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(place.alias("i"), "feature"))).alias("_f"))  # at most all features
    return found.select(*keys, F.transform(F.slice("_f", 1, k), lambda s: s["feature"]).alias(name))


def importance_compare(reference: DataFrame, current: DataFrame, n: int = 15, keys: list[str] = ()) -> DataFrame:
    """Reference and current importance of the n most important reference features."""
    top = reference.filter(F.col("rank") <= n).select(
        "feature", F.col("mean_abs").alias("ref_mean_abs"), F.col("rank").alias("ref_rank")
    )
    cur = current.select(*keys, "feature", F.col("mean_abs").alias("new_mean_abs"), F.col("rank").alias("new_rank"))
    return cur.join(F.broadcast(top), "feature")  # at most n rows broadcast
