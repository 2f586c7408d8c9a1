"""Files in, files of a larger layout out: what the command line runs, as one call over a folder.

Files of one layout and rate go through together; a file that a rule rejects has its reason and stops no other.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.operators import chunks, derive, mastering, spatial, stem_router, upmix
from wavequarry.operators.routing import HALF_POWER
from wavequarry.plans import batch, stems
from wavequarry.sources import blocks, flac, wav


@dataclass
class Settings:
    """What a run may be told; the defaults are the reference points of the layouts, gains and masters here."""

    layout: str = "5.1"
    kind: str = "wav"
    bits: int = 24
    rate: int | None = None
    input_layout: str | None = None
    routing: upmix.Routing = field(default_factory=upmix.Routing)
    frame: int | None = None
    linked: bool = True
    plan: bool = True
    profile: str = "auto"
    intensity: float = 1.0
    loudness: bool = True
    target: float = -18.0
    eq: str | None = None
    compressor: str | None = None
    bass: str | None = None
    limit: float = 0.95
    preview: float | None = None
    preview_start: float | None = None
    stems: str | None = None
    reference: str | None = None
    match_strength: float = 0.7
    match_db: float = 12.0
    match_spectrum: bool = True
    match_level: bool = True
    downmix: bool = False
    downmix_surround: float = HALF_POWER
    recursive: bool = False
    overwrite: bool = False

    def __post_init__(self) -> None:
        if self.layout not in catalog.OUTPUT_LAYOUTS:
            raise ValueError(f"unknown output layout {self.layout!r}; known are {', '.join(catalog.OUTPUT_LAYOUTS)}")
        if self.input_layout is not None and self.input_layout not in catalog.INPUT_LAYOUTS:
            raise ValueError(f"unknown input layout {self.input_layout!r}; known are {', '.join(catalog.INPUT_LAYOUTS)}")
        if self.kind not in ("wav", "bed"):
            raise ValueError("a kind is wav or bed")
        if self.bits not in (16, 24, 32):
            raise ValueError("16, 24 or 32 bits")
        self.intensity, self.match_strength = (min(1.0, max(0.0, v)) for v in (self.intensity, self.match_strength))
        if self.stems is not None:
            stems.plan(self.stem_names)

    @property
    def stem_names(self) -> list[str]:
        """Of ``stems``, names with commas between; none means the six primary ones."""
        return [s.strip() for s in (self.stems or "").split(",") if s.strip()]


def frame_size(rate: int) -> int:
    """The least power of two that resolves some 10.8 Hz."""
    size = 1
    while size < int(rate / 10.8):
        size *= 2
    return min(size, 16384)


def inspect(spark: SparkSession, folder: str, out: str, settings: Settings) -> DataFrame:
    """A row for each audio file below ``folder`` with its output, layout, rates and the reason why it can't be done, if there is one. Writes nothing."""
    found = wav.read_metadata(spark, folder).drop("duration").unionByName(flac.read_metadata(spark, folder))
    if not settings.recursive:
        found = found.where(~batch.relative_path(F.col("path"), folder).contains("/"))
    relative = batch.relative_path(F.col("path"), folder)
    stem = F.regexp_replace(relative, r"\.[^.]*$", "")
    lit = lambda v, kind: F.lit(v).cast(kind)
    jobs = found.select(F.col("path").alias("input"), stem.alias("asset"), batch.output_inside(F.concat(stem, F.lit(".wav")), out).alias("output"), F.lit(settings.layout).alias("format"),
                        F.lit(settings.kind).alias("kind"), F.lit(f"PCM_{settings.bits}").alias("subtype"), lit(settings.rate, "int").alias("asked_rate"), lit(settings.input_layout, "string").alias("override"))
    known = batch.preflight(jobs, found.select("path", "rate", "channels", "error")).join(found.select(F.col("path").alias("input"), "rate", "frames"), "input")
    if settings.stems is not None:
        known = known.withColumn("reason", F.coalesce("reason", F.when(~F.col("layout").isin("mono", "stereo"), "stems of more than two channels")))
    return known


def as_loud(out: DataFrame, source: DataFrame) -> DataFrame:
    """``out`` with the energy of ``source``, asset by asset; silence stays."""
    power = lambda df: df.groupBy("asset").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    scale = power(source).join(power(out).withColumnRenamed("e", "o"), "asset").select("asset", F.when((F.col("o") > 1e-20) & (F.col("e") > 1e-20), F.sqrt(F.col("e") / F.col("o"))).otherwise(1.0).alias("scale"))
    return out.join(scale, "asset").select("asset", "channel", "n", (F.col("x") * F.col("scale")).alias("x"))


def by_stems(pair: DataFrame, rate: int, settings: Settings, separator: stems.Separator = stems.band_split) -> DataFrame:
    """C8, C9, A19, JN1 to JN4: ``(asset, channel, n, x)`` of the output layout, from the stems of ``pair(asset, n, l, r)``.

    Stages are kept in the shared folder while they are read. The stems' own features move their gains.
    """
    spark = pair.sparkSession
    sides = pair.select("asset", "n", F.inline(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(k).alias("x")) for k in "lr"))))
    sides = chunks.settled(sides)
    kept, drop = stems.separate_staged(sides, stems.plan(settings.stem_names), rate, spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir(), separator)
    try:
        side = lambda k: F.max(F.when(F.col("channel") == k, F.col("x"))).alias(k)
        both = kept.groupBy("asset", "stem", "n").agg(side("l"), side("r"))
        features = stems.stem_features(both, rate) if settings.routing.content else None
        return chunks.settled(stem_router.route(both, rate, settings.layout, settings.routing, features=features))
    finally:
        drop()


def reference_at(spark: SparkSession, path: str, rate: int) -> DataFrame:
    """``(k, n, x)`` of a reference file, at ``rate``; one that isn't there or can't be read is an error."""
    source = flac if path.lower().endswith(".flac") else wav
    try:
        meta = source.read_metadata(spark, path).first()
    except AnalysisException as e:
        raise ValueError(f"the reference {path} isn't there") from e
    if meta is None or meta["error"] is not None:
        raise ValueError(f"the reference {path} can't be read")
    x = source.read_signal(spark, path)
    x = mastering.resample(x, meta["rate"], rate) if meta["rate"] != rate else x
    return chunks.settled(x.select(F.col("channel").cast("int").alias("k"), "n", "x"))


def upmixed(signal: DataFrame, source: str, rate: int, settings: Settings, separator: stems.Separator = stems.band_split) -> DataFrame:
    """``(asset, channel, n, x)`` in the output layout, mastered, from samples of the layout ``source``."""
    signal = chunks.settled(signal)
    have = catalog.INPUT_LAYOUTS[source].split()
    sides = ("C", "C") if source == "mono" else ("FL", "FR")
    side = lambda c: F.max(F.when(F.col("channel") == c, F.col("x")))
    pair = signal.where(F.col("channel").isin(*sides)).groupBy("asset", "n").agg(side(sides[0]).alias("l"), side(sides[1]).alias("r"))
    staged = settings.stems is not None
    controls = chunks.settled(spatial.controls(pair, rate, settings.profile, settings.intensity)) if settings.plan and not staged else None
    if staged:
        out = by_stems(pair, rate, settings, separator)
        out = as_loud(out, signal) if settings.linked else out
    elif source in ("mono", "stereo"):
        out = upmix.upmix(pair, rate, settings.frame or frame_size(rate), settings.layout, settings.routing, settings.linked, controls=controls, control_hop=spatial.hop_of(rate))
    else:
        out = derive.derive(signal, settings.layout, set(have), rate, controls=controls, hop=spatial.hop_of(rate))
        out = as_loud(chunks.settled(out), signal) if settings.linked else out
    target = settings.rate or (48_000 if settings.kind == "bed" else rate)
    if target != rate:
        out = mastering.resample(out, rate, target)
    reference = reference_at(signal.sparkSession, settings.reference, target) if settings.reference else None
    out = chunks.settled(out) if reference is not None else out  # its levels are read before it is matched
    chain = mastering.Chain(target, settings.eq or [], settings.compressor, settings.limit, settings.target if settings.loudness else None, settings.bass, reference,
                            settings.match_strength, settings.match_db, settings.match_spectrum, settings.match_level)
    return chain.apply(out)


def excerpt(frames: Column, rate: int, settings: Settings) -> tuple[Column, Column]:
    """The first sample that a preview takes of a file and the one after its last, so that no other is read; nulls without a preview."""
    if not settings.preview:
        return F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    length = int(settings.preview * rate)
    asked = F.lit(int(settings.preview_start * rate)) if settings.preview_start is not None else F.floor(frames / 2) - length // 2
    first = F.least(F.greatest(F.lit(0), asked), F.greatest(F.lit(0), frames - length)).cast("bigint")
    return first, first + length


RESULT = ("tracks", "frames", "bytes")


def sidecar(output: str) -> str:
    """IO13: where an output's stereo downmix goes."""
    return os.path.splitext(output)[0] + ".downmix.wav"


def run(spark: SparkSession, folder: str, out: str, settings: Settings = Settings(), separator: stems.Separator = stems.band_split) -> DataFrame:
    """``(asset, status, reason, path, tracks, frames, bytes, downmix)`` for each audio file below ``folder``, whose files below ``out`` are there whole or not at all.

    ``out`` is on a file system that all executors share. A file that is there already is an error unless it may be overwritten. With stems, files of more than two
    channels are rejected; ``separator`` makes them.
    """
    jobs = inspect(spark, folder, out, settings).persist()
    try:
        if not settings.overwrite:
            names = [r["output"] for r in jobs.where("reason IS NULL").select("output").collect()]
            taken = [p for n in names for p in (n, *([sidecar(n)] if settings.downmix else [])) if os.path.exists(p)]
            if taken:
                raise FileExistsError(f"{taken[0]} is there and may not be overwritten")
        nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
        done = jobs.where("reason IS NOT NULL").select("asset", F.lit("rejected").alias("status"), "reason", *nothing("string", "path"), *nothing("bigint", *RESULT), *nothing("string", "downmix"))
        for group in jobs.where("reason IS NULL").select("layout", "rate", "rate_out").distinct().collect():  # a few layouts and rates
            own = jobs.where((F.col("reason").isNull()) & (F.col("layout") == group["layout"]) & (F.col("rate") == group["rate"]))
            first, last = excerpt(F.col("frames"), group["rate"], settings)
            labels, named = catalog.INPUT_LAYOUTS[group["layout"]].split(), own.select(F.col("input").alias("path"), F.col("asset").alias("named"), first.alias("first"), last.alias("last"))
            signal = wav.read_signal(spark, folder, labels, named).unionByName(flac.read_signal(spark, folder, labels, named=named))
            if settings.preview:
                signal = signal.join(named.select(F.col("named").alias("asset"), "first"), "asset").select("asset", "channel", (F.col("n") - F.col("first")).alias("n"), "x")
            master = upmixed(signal, group["layout"], group["rate"], settings, separator)
            if settings.kind == "bed" or settings.downmix:
                master = chunks.settled(master)  # measured or mixed, and written
            if settings.kind == "bed":
                written = blocks.write_beds(master, settings.layout, group["rate_out"], out, mastering.loudness(master, group["rate_out"]))
            else:
                written = blocks.write_waves(master, catalog.OUTPUT_LAYOUTS[settings.layout].split(), group["rate_out"], out, settings.bits)
            written = written.select("asset", "path", *RESULT)
            if settings.downmix:
                mixed = batch.held_downmix(master, group["rate_out"], surround=settings.downmix_surround).withColumn("asset", F.concat("asset", F.lit(".downmix")))
                beside = blocks.write_waves(mixed, ["FL", "FR"], group["rate_out"], out, settings.bits)
                written = written.join(beside.select(F.regexp_replace("asset", "[.]downmix$", "").alias("asset"), F.col("path").alias("downmix")), "asset", "left")
            else:
                written = written.select("*", *nothing("string", "downmix"))
            done = done.unionByName(written.select("asset", F.lit("ok").alias("status"), *nothing("string", "reason"), "path", *RESULT, "downmix"))
        return spark.createDataFrame(done.collect(), done.schema)  # a row for each file
    finally:
        jobs.unpersist()


def settings_from(config: dict[str, object]) -> Settings:
    """C4: settings from flat keys, those of the routing among them; an unknown key is warned about and left out, a value that doesn't fit is an error."""
    import warnings

    own = {f.name: f.type for f in fields(Settings) if f.name != "routing"}
    gains = {f.name for f in fields(upmix.Routing)}
    out: dict[str, object] = {}
    routing: dict[str, float] = {}
    for key, value in config.items():
        if key in gains:
            routing[key] = int(value) if key == "lfe_order" else float(value)  # type: ignore[call-overload]
        elif key in own:
            kind = str(own[key]).split(" ")[0]
            out[key] = value if value is None else {"int": int, "float": float, "bool": bool, "str": str}[kind](value)  # type: ignore[operator]
        else:
            warnings.warn(f"unknown setting {key!r}", stacklevel=2)
    return Settings(**out, routing=upmix.Routing(**routing))  # type: ignore[arg-type]


__all__ = ["Settings", "frame_size", "inspect", "run", "settings_from", "upmixed"]
