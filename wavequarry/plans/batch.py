"""Batches: identities, resuming, running with isolated failures, reports, and the downmix sidecar (J7, J10, J11, A15, IO13, IO15, IO16)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.operators import mastering, planning, routing
from wavequarry.sources.wav import atomic_path, encode_assets


def input_identity(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``(path, size, modified)`` of the files below ``path`` whose name fits ``pattern``; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).distinct()


def output_rate(asked: F.Column, packaged: F.Column, source: F.Column) -> F.Column:
    """The rate that is asked for, else 48 kHz for a packaged bed, else the source's."""
    return F.coalesce(asked, F.when(packaged, F.lit(48_000)), source)


SUFFIXES = ("wav", "flac")


def listing(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """``(path, relative)`` of the audio files below ``folder``, or of those that fit ``pattern``, each once, ordered by relative path."""
    files = input_identity(spark, folder, pattern or "*", recursive).select("path")
    return relative_listing(files, folder, None if pattern else SUFFIXES)


def relative_path(path: F.Column, folder: str) -> F.Column:
    """What of a path, or of a file's address, comes after the folder."""
    inside = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "%20", " ")
    return F.ltrim(F.substring(inside, len(folder.rstrip("/")) + 1, 1 << 20), F.lit("/"))


def relative_listing(files: DataFrame, folder: str, suffixes: tuple[str, ...] | None = SUFFIXES) -> DataFrame:
    """The order and the suffixes of ``listing`` over ``files(path)``."""
    found = files.select("path", relative_path(F.col("path"), folder).alias("relative")).distinct()
    if suffixes:
        found = found.where(F.lower(F.substring_index("path", ".", -1)).isin(*suffixes))
    return found.orderBy("relative")


def output_inside(output: F.Column, folder: str) -> F.Column:
    """``folder/output`` with its dots resolved; one that leaves the folder is an error."""
    parts = F.split(F.regexp_replace(output, "/+", "/"), "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
                        lambda a, p: F.struct((a["now"] + F.when(p == "..", -1).when(p.isin(".", ""), 0).otherwise(1)).alias("now"),
                                              F.least(a["least"], a["now"] + F.when(p == "..", -1).when(p.isin(".", ""), 0).otherwise(1)).alias("least")))
    leaves = output.startswith("/") | (depth["least"] < 0)
    return F.when(leaves, F.raise_error(F.concat(F.lit("output leaves its folder: "), output)).cast("string")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), output))


BED_LAYOUTS = ("5.1", "7.1", "5.1.2", "7.1.2", "5.1.4", "7.1.4")


def preflight(jobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each job with ``layout``, ``rate_out``, ``channels_out`` and ``reason``, the first rule that it breaks, or null.

    ``jobs(input, output, format, kind, subtype, asked_rate, override)``: kind is ``wav`` or ``bed``; ``metadata(path, rate, channels, error)``
    is that of the files which are there. The rules, in order: the input is there, is another file than the output, and can be read;
    its layout is the one given, if that is known and has as many channels, or that of its number of channels; the output layout has all
    of it and more; a bed has 48 or 96 kHz, 24 bits, and the suffix wav.
    """
    spark, c = jobs.sparkSession, F.col
    by_count = spark.createDataFrame(list(catalog.DETECTED.items()), "channels int, detected string")
    by_name = spark.createDataFrame([(n, len(x.split())) for n, x in catalog.INPUT_LAYOUTS.items()], "override string, override_channels int")
    by_output = spark.createDataFrame([(n, len(x.split())) for n, x in catalog.OUTPUT_LAYOUTS.items()], "format string, channels_out int")
    allowed = planning.can_upmix(catalog.layouts(spark)).select(c("input").alias("layout"), c("output").alias("format"), "ok")
    known = (jobs.join(metadata.select(c("path").alias("input"), "rate", "channels", "error", F.lit(True).alias("there")), "input", "left")
             .join(by_count, "channels", "left").join(by_name, "override", "left").join(by_output, "format", "left")
             .withColumn("layout", F.when(c("override").isNotNull(), c("override")).otherwise(c("detected")))
             .join(allowed, ["layout", "format"], "left").withColumn("rate_out", output_rate(c("asked_rate"), c("kind") == "bed", c("rate"))))
    bed = c("kind") == "bed"
    reason = (F.when(c("there").isNull(), "missing").when(c("input") == c("output"), "same path").when(c("error").isNotNull(), "unreadable")
              .when(c("override").isNotNull() & c("override_channels").isNull(), "unknown layout").when(c("override_channels") != c("channels"), "channels differ")
              .when(c("layout").isNull(), "no layout").when(c("channels_out").isNull(), "unknown output layout").when(~F.coalesce("ok", F.lit(False)), "cannot upmix")
              .when(bed & ~c("rate_out").isin(48_000, 96_000), "bed rate").when(bed & (c("subtype") != "PCM_24"), "bed bits").when(bed & (F.lower(F.substring_index("output", ".", -1)) != "wav"), "bed suffix"))
    return known.select(*jobs.columns, "layout", "rate_out", "channels_out", reason.alias("reason"))


def resume(jobs: DataFrame, state: DataFrame, outputs: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """The jobs that are done already and those to run.

    ``jobs`` and ``state`` have (output, size, modified, config_hash): a job is done if its input and
    configuration are those of the state, and the output is there. Where ``state`` and ``outputs`` have (rate, channels, frames) as
    well, the output must be the file that was written, by these. One whose output is there for another reason is an error unless it may be overwritten.
    """
    written = [k for k in ("rate", "channels", "frames") if k in state.columns and k in outputs.columns]
    there = outputs.select("output").distinct()
    trusted = state.join(outputs.select("output", *written).distinct(), ["output", *written], "left_semi")
    done = jobs.join(trusted.select("output", "size", "modified", "config_hash"), ["output", "size", "modified", "config_hash"], "left_semi")
    todo = jobs.join(done.select("output"), "output", "left_anti")
    if not overwrite:
        taken = todo.join(there, "output", "left_semi").select("output").limit(1).collect()
        if taken:
            raise FileExistsError(f"{taken[0]['output']} is there and may not be overwritten")
    return done, todo


def run_batch(jobs: DataFrame, work: Callable[[dict], dict], key: str = "output") -> DataFrame:
    """``(key, status, error, result)`` per job: ``work`` on its row, in tasks by key; a failure is recorded and stops no other job.

    The result is what ``work`` returns, as JSON. Work must be repeatable: a lost task runs its jobs again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for job in pdf.to_dict("records"):
                try:
                    rows.append((job[key], "ok", None, json.dumps(work(job), sort_keys=True, default=str)))
                except Exception as e:  # noqa: BLE001  any failure belongs to its job alone
                    rows.append((job[key], "failed", f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=[key, "status", "error", "result"])

    return jobs.repartition(key).mapInPandas(run, f"`{key}` string, status string, error string, result string")


def totals(results: DataFrame, skipped: int = 0) -> dict[str, int]:
    """A15."""
    r = results.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed")).first()
    return {"total": r["n"] + skipped, "succeeded": r["ok"], "failed": r["failed"], "skipped": skipped}


def results_json(results: DataFrame) -> DataFrame:
    """IO16: one JSON document per row, nulls kept."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_report(document: dict, path: str) -> None:
    """IO15: a JSON file with sorted keys that is there whole or not at all."""
    with atomic_path(path) as temporary, open(temporary, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2, sort_keys=True)


def held_downmix(signal: DataFrame, rate: int, peak: float = -1.0, surround: float = routing.HALF_POWER) -> DataFrame:
    """IO13: ``(asset, channel, n, x)``: the stereo downmix, turned down where its true peak exceeds ``peak`` dB."""
    stereo = routing.downmix(signal, surround)
    sides = stereo.select("asset", "n", F.explode(F.create_map(F.lit("FL"), F.col("l"), F.lit("FR"), F.col("r"))).alias("channel", "x")).select("asset", "channel", "n", "x")
    gain = mastering.loudness(sides, rate).select("asset", F.pow(F.lit(10e0), F.least(F.lit(0e0), F.lit(peak) - F.col("dbtp")) / 20).alias("gain"))
    return sides.join(gain, "asset").select("asset", "channel", "n", (F.col("x") * F.col("gain")).alias("x"))


def downmix_sidecar(signal: DataFrame, rate: int, peak: float = -1.0, bits: int = 24) -> DataFrame:
    """IO13: ``(asset, wav)``: the held downmix as a file's bytes."""
    return encode_assets(held_downmix(signal, rate, peak), ["FL", "FR"], rate, bits)
