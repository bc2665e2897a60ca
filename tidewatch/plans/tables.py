"""Stage tables derived from the given tables: the order cohort, the scored stream, the readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.runtime import stage
from tidewatch.operators.attribution import linear_margin
from tidewatch.operators.cleaning import apply_shift_spec, median_fill
from tidewatch.operators.ordered import grouped_index
from tidewatch.operators.windows import count_windows, phase_split
from tidewatch.plans import model as M


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: line statistics, order and customer columns."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.round(F.avg("l_quantity"), 6).alias("qty_mean"),
            F.round(F.stddev_samp("l_quantity"), 6).alias("qty_std"),
            F.round(F.avg("l_extendedprice"), 6).alias("price_mean"),
            F.round(F.avg("l_discount"), 6).alias("disc_mean"),
            F.round(F.avg("l_tax"), 6).alias("tax_mean"),
            F.count("*").cast("double").alias("n_lines"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"),
            F.min("l_shipdate").alias("arrival"),
        )
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("l_orderkey").alias("entity_id"),
            "arrival",
            "qty_mean",
            "qty_std",
            "price_mean",
            "disc_mean",
            "tax_mean",
            "n_lines",
            F.col("o_totalprice").alias("total_price"),
            F.col("c_acctbal").alias("acct_bal"),
            "y",
            F.col("c_mktsegment").alias("grp"),
            F.col("o_orderpriority").alias("prio"),
            (F.col("o_custkey") % 2).cast("int").alias("gender"),
            (18 + F.col("o_custkey") % 80).cast("double").alias("age"),
        )
    )


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """The order cohort in arrival order with its phase."""
    return stage(spark, ("cohort", sf), lambda: phase_split(order_rows(spark, sf), ["arrival", "entity_id"]))


def scored_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The cohort after the shift specification, filled with phase 1 medians, with its score ``p``."""

    def build():
        base = cohort(spark, sf)
        moved = apply_shift_spec(base, M.SHIFTS, M.FEATURES, label="y", flip=M.FLIP)
        filled = median_fill(moved, base.filter("phase = 'phase1'"), M.FEATURES)
        margin = linear_margin(M.FEATURES, M.WEIGHT, M.CENTER, M.SCALE, M.INTERCEPT)
        return filled.withColumn("p", F.round(1 / (1 + F.exp(-margin)), 6))

    return stage(spark, ("stream", sf), build)


def reference_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scored_stream(spark, sf).filter("phase = 'phase1'")


def cut_windows(rows: DataFrame) -> DataFrame:
    return count_windows(rows, M.WINDOW_SIZE, M.WINDOW_STEP)


def window_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cut_windows(scored_stream(spark, sf))


def to_long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Long (keys, feature, value); pruned to the needed columns before the rows multiply."""
    return df.select(*keys, *features).unpivot(keys, features, "feature", "value")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sparse hourly readings: one column per event type, an hour counter per user."""

    def build():
        events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
        numbered = grouped_index(events, ["user_id"], ["ts", "event_id"], "hour")
        return numbered.select(
            "event_id",
            "user_id",
            "ts",
            "hour",
            *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in M.READING_KINDS],
            (F.col("event_type") == "error").cast("int").alias("label"),
            "value",
        )

    return stage(spark, ("readings", sf), build)


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a length based score, for the quality and subgroup metrics."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"), "toxic")
    p = F.least(F.greatest(F.col("n_chars") / F.lit(4000.0), F.lit(0.01)), F.lit(0.99))
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "y", "toxic", F.round(p, 6).alias("p"))
