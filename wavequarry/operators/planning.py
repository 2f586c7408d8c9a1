"""Jobs, manifests, plans and cache keys as relations (J*, C*, K*, A15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_source(candidates: DataFrame) -> DataFrame:
    """Of ``candidates(prio, ...)`` those of the first priority that has any."""
    best = candidates.agg(F.min("prio").alias("prio"))
    return candidates.join(F.broadcast(best), "prio")


def expand_template(template: Column, **fields: Column) -> Column:
    """``{name}`` replaced by its field; a field that isn't known is an error."""
    out = template
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    left = F.regexp_extract(out, r"\{(\w+)\}", 1)
    return F.when(left == "", out).otherwise(F.raise_error(F.concat(F.lit("unknown field "), left)).cast("string"))


def duplicates(jobs: DataFrame, output: str = "output") -> DataFrame:
    """Jobs that share an output; counted first, so that no output's jobs are gathered."""
    twice = jobs.groupBy(output).agg(F.count("*").alias("jobs")).where("jobs > 1")
    return jobs.join(twice, output)


def upsert(state: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The latest row of each key."""
    both = state.unionByName(changes)
    rest = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
    return latest.select(key, "r.*")


def canonical_json(pairs: Column) -> Column:
    """Compact JSON of a map of strings with sorted keys."""
    entry = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"'))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), entry), ","), F.lit("}"))


def deep_merge(base: DataFrame, override: DataFrame) -> DataFrame:
    """C1 over path rows ``([doc,] path, value)``: an override wins, and a leaf in it removes what the base has below or above it, in its document."""
    own = [c for c in ("doc",) if c in base.columns]
    steps = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda k: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), k), "."))
    # every prefix of a path is a key, so the tree test is two equi-joins
    below = base.select(*own, "path", F.explode(steps("path")).alias("p")).join(override.select(*own, F.col("path").alias("p")).distinct(), [*own, "p"], "left_semi").select(*own, "path")
    above = override.select(*own, F.explode(steps("path")).alias("path")).distinct()
    return base.join(below.union(above).distinct(), [*own, "path"], "left_anti").select(*own, "path", "value").unionByName(override.select(*own, "path", "value"))


def ordered_distinct(items: DataFrame, value: str, pos: str) -> DataFrame:
    """K2: each value at its first place."""
    return items.groupBy(value).agg(F.min(pos).alias(pos))


def cache_key(*parts: Column) -> Column:
    """C11: the first 20 hex digits of the parts' hash."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def can_upmix(layouts: DataFrame) -> DataFrame:
    """``(input, output, ok)``: all labels of the input are in the output, which has more."""
    ins, outs = layouts.where("direction = 'in'"), layouts.where("direction = 'out'")
    size_in = ins.groupBy(F.col("layout").alias("input")).agg(F.count("*").alias("n_in"))
    size_out = outs.groupBy(F.col("layout").alias("output")).agg(F.count("*").alias("n_out"))
    common = (ins.select(F.col("layout").alias("input"), "label").join(outs.select(F.col("layout").alias("output"), "label"), "label")
              .groupBy("input", "output").agg(F.count("*").alias("both")))
    grid = size_in.join(F.broadcast(size_out))  # eight by six layouts
    return grid.join(common, ["input", "output"], "left").select(
        "input", "output", ((F.coalesce("both", F.lit(0)) == F.col("n_in")) & (F.col("n_out") > F.col("n_in"))).alias("ok"))


def latest_rank(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("rk", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rk = 1").drop("rk")
