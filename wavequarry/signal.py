"""Bindings from stored tables to the signal relation ``(channel, n, x)``.

A signal is a long-form DataFrame; ``n`` is the 0-based sample index inside a
channel. Every binding has a SQL twin used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_channel() -> F.Column:
    t = F.col("event_type")
    return (
        F.when(t == "click", "FL").when(t == "view", "FR").when(t == "purchase", "C")
        .when(t == "signup", "LFE").otherwise("SL")
    )


def numbered(df: DataFrame, key: str, bucket: F.Column, order: list[str]) -> DataFrame:
    """``df`` with ``n``, each row's place within its ``key``, ordered by ``bucket`` and, in it, by ``order``.

    Buckets are sorted apart, and the sums of their sizes are added to the places within them: a key
    with most of the rows spreads over its buckets. ``bucket`` must rise with ``order``.
    """
    rows = df.withColumn("bucket", bucket)
    sizes = rows.groupBy(key, "bucket").agg(F.count("*").alias("size"))
    before = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(key, "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(W.partitionBy(key, "bucket").orderBy(*order)) - 1
    return rows.withColumn("n", within).join(starts, [key, "bucket"]).withColumn("n", (F.col("n") + F.col("start")).cast("bigint")).drop("bucket", "start")


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as samples: one channel per event type, ordered by time; numbered by the hour."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return numbered(events, "event_type", F.date_trunc("hour", "ts"), ["ts", "event_id"]).select(
        event_channel().alias("channel"), "n", (F.col("value") / F.lit(500e0)).alias("x"))


#: The SQL twin of ``event_signal``.
SIG_SQL = """sig AS (
  SELECT CASE event_type WHEN 'click' THEN 'FL' WHEN 'view' THEN 'FR' WHEN 'purchase' THEN 'C'
              WHEN 'signup' THEN 'LFE' ELSE 'SL' END AS channel,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS n,
         value / 500e0 AS x
  FROM events)"""


def stereo_pair(signal: DataFrame) -> DataFrame:
    """Samples where both front channels exist: ``(n, l, r)``."""
    sides = signal.where(F.col("channel").isin("FL", "FR"))
    return (
        sides.groupBy("n")
        .agg(F.max(F.when(F.col("channel") == "FL", F.col("x"))).alias("l"),
             F.max(F.when(F.col("channel") == "FR", F.col("x"))).alias("r"))
        .where("l IS NOT NULL AND r IS NOT NULL")
    )


PAIR_SQL = """pair AS (
  SELECT a.n AS n, a.x AS l, b.x AS r FROM sig a JOIN sig b ON a.n = b.n
  WHERE a.channel = 'FL' AND b.channel = 'FR')"""
