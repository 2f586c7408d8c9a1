"""What the training-data operators share: shared-folder tables, row ids, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, it is a temporary one in local mode, where all share it, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wavequarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    The table outlives lost executors; it stays until ``discard`` or until the folder is
    emptied. Shuffle files of what was written before, and that nothing refers to any
    more, are let go first.
    """
    let_go(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/wavequarry-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out), path)
    return out


def let_go(spark: SparkSession) -> None:
    """Spark's cleaner learns of unused shuffle files from a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_tables: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote. Only for those that nothing unwritten reads."""
    for t in tables:
        ref, path = _tables.pop(id(t), (None, None))
        if ref is not None and ref() is t:
            spark = t.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that other columns can't clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions that grow with the rows."""
    return max(least, -(-rows // per_part))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: the label is the component's least node.

    Alternating large-star and small-star contraction: a logarithmic number of
    rounds, each two aggregations and two joins over the edges, whose number
    never grows. A hub's edges are split by the skew join; no neighbour list is
    gathered. Each round is written to the shared folder, and the one before it deleted.
    """
    spark = edges.sparkSession
    cur = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        mark = tuple(cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        old, cur = cur, materialise(small, "cc")
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    labels = cur.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.union(roots)
