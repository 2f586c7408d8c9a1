"""Sharding by longest processing time: groups that stay together go to the least-loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.llm.common import discard, materialise, parts_for, table

ROWS_PER_BUCKET = 65_536


def lpt_classes(classes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """``(size, number of groups)`` to the number of that size's groups that each shard gets.

    Longest processing time: sizes fall, each group goes to the least-loaded shard (ties
    by number). Groups of one size are interchangeable, so only their numbers matter: what
    the heap would hand out while all loads stay at or below a level is handed out at once.
    """
    loads = [0] * shards
    out = {}
    for size, count in sorted(classes, reverse=True):
        given = [0] * shards
        if count > 4 * shards:
            low, high = min(loads), max(loads) + size * count
            while low < high:  # the highest level at which no more than ``count`` groups find a place
                level = (low + high + 1) // 2
                if sum(max(0, (level - x) // size + 1) for x in loads) <= count:
                    low = level
                else:
                    high = level - 1
            given = [max(0, (low - x) // size + 1) for x in loads]
            if sum(given) > count:
                given = [0] * shards
        heap = [(x + g * size, k) for k, (x, g) in enumerate(zip(loads, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            given[k] += 1
        loads = [x + g * size for x, g in zip(loads, given, strict=True)]
        out[size] = given
    return out


def ranked(items: DataFrame, within: str, order: list[str], buckets: int, weight: str | None = None) -> DataFrame:
    """``items`` with ``rank``, gapless from 0 within each value of ``within``: the sum of the weights before (1 each without).

    Items are ordered by a bucket (a hash of ``order``) and then by ``order``, so that no task
    numbers all items of one value.
    """
    w = F.col(weight) if weight else F.lit(1)
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(within, "bucket").agg(F.sum(w).alias("c"))
    before = W.partitionBy(within).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(within, "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    own = W.partitionBy(within, "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (dealt.withColumn("k", F.coalesce(F.sum(w).over(own), F.lit(0))).join(starts, [within, "bucket"])
            .withColumn("rank", F.col("start") + F.col("k")).drop("bucket", "k", "start"))


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                  per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row; equal texts share a shard.

    A group is all rows of one text; its size is the sum of its rows' sizes (UTF-8 bytes
    plus 1; a null text counts as empty). The driver gets the histogram of group sizes:
    distinct sizes that sum to at most the input's, so no more than the root of twice the
    input's bytes. Groups of one size are ranked by hash and dealt to shards by rank.

    Slots are gapless per shard, by hash bucket and row. Wholly equal rows are counted
    before they are shuffled and stand side by side. Null ids get slots of their own; an
    empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("hash"),
    ).select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.unhex(F.substring("hash", 1, 32)).alias("grp"))
    rows = materialise(rows.groupBy("doc_id", "size", "text_crc32", "grp").agg(F.count("*").alias("c")), "shard-rows")
    groups = materialise(rows.groupBy("grp").agg(F.sum(F.col("size") * F.col("c")).alias("load")), "shard-groups")
    histogram = [(r["load"], r["c"]) for r in groups.groupBy("load").agg(F.count("*").alias("c")).toLocalIterator()]
    plan = [(size, [sum(given[:k + 1]) for k in range(shards)]) for size, given in lpt_classes(histogram, shards).items()]
    cuts = spark.createDataFrame(plan, "load bigint, cuts array<bigint>")
    n = sum(c for _, c in histogram)
    placed = (ranked(groups, "load", ["grp"], parts_for(n, per_bucket, 8)).join(cuts, "load")
              .select("grp", F.size(F.filter("cuts", lambda x: x <= F.col("rank"))).alias("shard")))
    pieces = materialise(rows.join(placed, "grp").select(
        "doc_id", "size", "text_crc32", "shard", "c", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / per_bucket))).alias("piece"))
        .select("doc_id", "size", "text_crc32", "shard", "piece", F.least(F.lit(per_bucket), F.col("c") - F.col("piece") * per_bucket).alias("c")), "shard-pieces")
    discard(rows, groups)
    total = pieces.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    slots = ranked(pieces, "shard", ["doc_id", "text_crc32", "size", "piece"], parts_for(total, per_bucket, 8), "c")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("c") - 1)).alias("slot"))


def op3_shards(spark, sf_dir):
    """All documents into 8 shards under the law ``bytes``."""
    out = assign_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
