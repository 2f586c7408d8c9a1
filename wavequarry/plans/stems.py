"""Stem plans, a pluggable separator, and a cache of what it made (C8 to C13, IO4)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.functions import dsp
from wavequarry.operators import windows

# The names a request may use, and what each stage makes.
VOCABULARY = {
    "vocals": "Vocals", "bass": "Bass", "drums": "Drums", "guitar": "Guitar", "piano": "Piano", "other": "Other", "kick": "Kick", "snare": "Snare",
    "toms": "Toms", "hi-hat": "Hi-Hat", "ride": "Ride", "crash": "Crash", "crowd": "Crowd", "backing-vocals": "Backing Vocals",
}
PRIMARY = ("Vocals", "Bass", "Drums", "Guitar", "Piano", "Other")
DRUM_PARTS = ("Kick", "Snare", "Toms", "Hi-Hat", "Ride", "Crash")
VOICES = ("Vocals", "Backing Vocals")


@dataclass(frozen=True)
class Task:
    """A stage reads the source or an earlier stem, and some of what it makes is kept."""

    name: str
    source: str
    makes: tuple[str, ...]
    keeps: tuple[str, ...]


def normalised(stems: list[str]) -> list[str]:
    """K2: the vocabulary's names, first of repeats; one that it lacks is an error."""
    known = VOCABULARY | {v: v for v in VOCABULARY.values()}
    found = [known.get(s) or known.get(s.lower()) for s in stems]
    if None in found:
        raise ValueError(f"unknown stem {stems[found.index(None)]!r}; known are {', '.join(sorted(VOCABULARY))}")
    return list(dict.fromkeys(found))


def requested(stems: list[str]) -> list[str]:
    """The stems that a plan leaves: the six primary ones if none is named; drums give way to their parts."""
    wanted = normalised(stems) or list(PRIMARY)
    return [s for s in wanted if s != "Drums"] if set(wanted) & set(DRUM_PARTS) else wanted


def plan(stems: list[str]) -> list[Task]:
    """Crowd first, then the primary split of what remains, then the drums' parts and the backing vocals, each only where it is asked for."""
    wanted = requested(stems)
    among = lambda names: tuple(s for s in names if s in wanted)
    tasks, source = [], "input"
    if "Crowd" in wanted:
        tasks.append(Task("crowd", source, ("Crowd", "Without Crowd"), ("Crowd",)))
        source = "Without Crowd"
    if among(PRIMARY) or among(DRUM_PARTS) or "Backing Vocals" in wanted:
        tasks.append(Task("primary", source, PRIMARY, among(PRIMARY)))
    if among(DRUM_PARTS):
        tasks.append(Task("drums", "Drums", DRUM_PARTS, among(DRUM_PARTS)))
    if "Backing Vocals" in wanted:
        tasks.append(Task("voices", "Vocals", VOICES, among(VOICES)))
    return tasks


def _short_hash(parts: list[str]) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:20]


def stems_hash(stems: list[str]) -> str:
    """K3, C11: of the stems that the plan leaves, the same for any order."""
    return _short_hash(sorted(requested(stems)))


def inference_hash(stems: list[str], models: dict[str, str] | None = None) -> str:
    """Of the stages' models (their names, where none is given) and sources, whatever is kept."""
    return _short_hash([f"{(models or {}).get(t.name, t.name)}:{t.source}" for t in plan(stems)])


def band_split(x: np.ndarray, rate: int, makes: tuple[str, ...]) -> dict[str, np.ndarray]:
    """A stand-in for a model: neighbouring bands that sum to the input."""
    edges, rest, out = np.geomspace(120, rate / 4, max(1, len(makes) - 1)), x, {}
    for name, hz in zip(makes[:-1], edges, strict=False):
        low = dsp.sos_filter(dsp.butterworth(2, float(hz), rate), rest)[0]
        out[name], rest = low, rest - low
    out[makes[-1]] = rest
    return out


def stem_name(file: F.Column, tags: dict[str, str], overrides: dict[str, str] | None = None) -> F.Column:
    """The stem that a separated file's name says: of the known tags in brackets the one that stands last, in any case; at one place a model's own tags come first. Without one, null."""
    name = F.lower(F.substring_index(file, "/", -1))
    known = [(t.lower(), s, 1) for t, s in (overrides or {}).items()] + [(t.lower(), s, 0) for t, s in tags.items()]
    # where the last "(tag)" begins: what follows the tag's last place is cut off
    at = lambda t: F.char_length(name) - F.instr(F.reverse(name), f"({t})"[::-1]) - len(t) - 1
    found = [F.when(F.contains(name, F.lit(f"({t})")), F.struct(at(t).alias("at"), F.lit(p).alias("first"), F.lit(-k).alias("k"), F.lit(s).alias("stem"))) for k, (t, s, p) in enumerate(known)]
    return F.array_max(F.array(*found))["stem"]


Separator = Callable[[np.ndarray, int, tuple[str, ...]], dict[str, np.ndarray]]


def separate(signal: DataFrame, tasks: list[Task], rate: int, separator: Separator = band_split) -> DataFrame:
    """``(asset, channel, stem, n, x)`` of the kept stems; a stage whose source was never made is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        have, kept = {"input": pdf["x"].to_numpy(np.float64)}, {}
        for t in tasks:
            if t.source not in have:
                raise ValueError(f"{t.name} needs {t.source}, which no earlier stage makes")
            made = separator(have[t.source], rate, t.makes)
            have |= made
            kept |= {k: made[k] for k in t.keeps}
        out = [pd.DataFrame({"asset": pdf["asset"], "channel": pdf["channel"], "stem": k, "n": pdf["n"], "x": v}) for k, v in kept.items()]
        return pd.concat(out) if out else pd.DataFrame(columns=["asset", "channel", "stem", "n", "x"])

    return signal.select("asset", "channel", "n", "x").groupBy("asset", "channel").applyInPandas(run, "asset string, channel string, stem string, n bigint, x double")


def separate_active(signal: DataFrame, spans: DataFrame, tasks: list[Task], rate: int, separator: Separator = band_split, fade: int = 480) -> DataFrame:
    """As ``separate``, but only the samples inside ``spans(asset, channel, s, e)`` go through the separator, each span apart.

    Spans are faded at both ends and laid back; of overlapping ones the later stands. Outside them every kept stem is silent.
    """
    inside = windows.in_spans(signal, spans)
    part = F.concat_ws("\x1f", "asset", F.col("s").cast("string"), F.col("e").cast("string"))
    made = separate(inside.select(part.alias("asset"), "channel", "n", "x"), tasks, rate, separator)
    edge = F.split("asset", "\x1f")
    laid = made.select(edge[0].alias("asset"), "channel", "stem", "n", "x", edge[1].cast("bigint").alias("s"), edge[2].cast("bigint").alias("e"))
    f = F.least(F.lit(fade), F.expr("(e - s) div 2"))
    gain = F.when(f > 1, F.least(F.lit(1e0), (F.col("n") - F.col("s")) / (f - 1), (F.col("e") - 1 - F.col("n")) / (f - 1))).otherwise(1e0)
    stitched = laid.withColumn("y", F.col("x") * gain).groupBy("asset", "channel", "stem", "n").agg(F.max_by("y", "s").alias("y"))
    kept = list(dict.fromkeys(k for t in tasks for k in t.keeps))
    grid = signal.select("asset", "channel", "n", F.explode(F.array(*map(F.lit, kept))).alias("stem"))
    return grid.join(stitched, ["asset", "channel", "stem", "n"], "left").select("asset", "channel", "stem", "n", F.coalesce("y", F.lit(0e0)).alias("x"))


# Corners of the low and high band in Hz, and what a silent stem has.
LOW_HZ, HIGH_HZ, MOST_SECONDS = 250.0, 4000.0, 60
FEATURES = "asset string, stem string, width double, hf double, lf double, transient double"


def stem_features(stems: DataFrame, rate: int, size: int = 2048) -> DataFrame:
    """Width, high and low band shares and share of onset frames of each ``stems(asset, stem, n, l, r)``.

    At most a minute of each, from three windows evenly apart, is gathered: that bounds a task.
    """
    some = windows.three_windows(stems, ["asset", "stem"], rate * MOST_SECONDS)

    def analyse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        l, r = pdf["l"].to_numpy(np.float64), pdf["r"].to_numpy(np.float64)
        ll, rr = float(l @ l), float(r @ r)
        both = ll > 1e-12 and rr > 1e-12
        width = float(np.clip(1 - (l @ r) / (ll * rr) ** 0.5, 0, 1)) if both else 1.0 if max(ll, rr) > 1e-12 else 0.5
        f, power = dsp.welch((l + r) / 2, rate, size)
        total = power.sum() + 1e-20
        frames = np.abs(dsp.stft((l + r) / 2, size, size // 4))
        flux = np.maximum(0, np.diff(frames, axis=0)).sum(axis=1)
        onset = float((flux > 1.5 * np.percentile(flux, 75)).mean()) if len(flux) else 0.0
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "stem": [pdf["stem"].iloc[0]], "width": [width], "hf": [float(power[f >= HIGH_HZ].sum() / total)],
                             "lf": [float(power[f < LOW_HZ].sum() / total)], "transient": [onset]})

    return some.select("asset", "stem", "n", "l", "r").groupBy("asset", "stem").applyInPandas(analyse, FEATURES)


def separate_staged(signal: DataFrame, tasks: list[Task], rate: int, folder: str, separator: Separator = band_split) -> tuple[DataFrame, Callable[[], None]]:
    """As ``separate``, with what each stage makes written below ``folder``, which all executors share.

    A stage reads only its source, and only stems that are kept or that a later stage reads are written; a table goes when its last reader is done.
    A lost executor costs the stage that it was in. Gives the kept stems and what deletes them.
    """
    spark = signal.sparkSession
    base = f"{folder.rstrip('/')}/stems-{uuid.uuid4().hex}"
    made: dict[str, str] = {}
    readers = {t.source: k for k, t in enumerate(tasks)}  # the last one of each source

    def drop(path: str) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    kept: dict[str, str] = {}
    for k, t in enumerate(tasks):
        if t.source != "input" and t.source not in made:
            raise ValueError(f"{t.name} needs {t.source}, which no earlier stage makes")
        source = signal.select("asset", "channel", "n", "x") if t.source == "input" else spark.read.parquet(made[t.source])
        later = {s for s, last in readers.items() if last > k}
        wanted = tuple(s for s in t.makes if s in t.keeps or s in later)
        out = separate(source, [Task(t.name, "input", t.makes, wanted)], rate, separator)
        path = f"{base}/{k}-{t.name}"
        out.write.partitionBy("stem").parquet(path)
        for s in wanted:
            made[s] = f"{path}/stem={quote(s, safe=' -')}"
        kept |= {s: made[s] for s in t.keeps}
        if t.source != "input" and readers[t.source] == k and t.source not in kept:
            drop(made[t.source])
    parts = [spark.read.parquet(p).select("asset", "channel", F.lit(s).alias("stem"), "n", "x") for s, p in kept.items()]
    if not parts:
        return signal.select("asset", "channel", F.lit("").alias("stem"), "n", "x").where("false"), lambda: drop(base)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found, lambda: drop(base)


TOLERANCE = 2.0


def cache_hits(requests: DataFrame, entries: DataFrame, files: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """JN11: each request with the entry that serves it: ``(id, hit, via)``, via ``new``, ``legacy`` or ``miss``.

    ``requests(id, key, legacy, modified)``; ``entries(key, modified, stems)``, those whose mark is there; ``files(key, stem)``. The
    new key's entry decides if there is one, else the old one's; it serves if its input was modified at the same time but for
    ``tolerance`` seconds, and all of its stems' files, one at least, are there. All joins are equi-joins on keys.
    """
    c = F.col
    listed = entries.select("key", F.explode("stems").alias("stem"))
    whole = (listed.join(files.select("key", "stem", F.lit(1).alias("there")).distinct(), ["key", "stem"], "left")
             .groupBy("key").agg(F.bool_and(c("there").isNotNull()).alias("whole")))
    state = entries.select("key", c("modified").alias("was")).join(whole, "key", "left")
    side = lambda name: state.select(c("key").alias(name), c("was").alias(f"{name}_was"), c("whole").alias(f"{name}_whole"), F.lit(True).alias(f"{name}_there"))
    both = requests.join(side("key"), "key", "left").join(side("legacy"), "legacy", "left")
    first = c("key_there").isNotNull()
    pick = lambda x: F.when(first, c(f"key_{x}")).otherwise(c(f"legacy_{x}"))
    serves = F.coalesce((F.abs(pick("was") - c("modified")) <= tolerance) & pick("whole"), F.lit(False))
    return both.select("id", F.when(serves, F.when(first, c("key")).otherwise(c("legacy"))).alias("hit"),
                       F.when(serves, F.when(first, "new").otherwise("legacy")).otherwise("miss").alias("via"))


class StemCache:
    """C12, JN11: stems under a key, whose mark is written last; a key without its mark is a miss."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def save(self, key: str, stems: DataFrame, preview: bool = False, modified: float = 0.0) -> None:
        """Each stem is committed apart, by the rename of what was written beside it, and the mark after all of them; a preview is never kept."""
        if preview:
            return
        names = sorted(r["stem"] for r in stems.select("stem").distinct().collect())  # a plan has some twenty at most
        self._drop(f"{self._folder}/{key}/mark")
        for name in names:
            at, beside = f"{self._folder}/{key}/stems/{quote(name, safe='')}", f"{self._folder}/{key}/writing-{uuid.uuid4().hex}"
            stems.where(F.col("stem") == name).write.parquet(beside)
            self._drop(at)
            self._move(beside, at)
        self._spark.createDataFrame([(key, float(modified), names)], "key string, modified double, stems array<string>").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{self._folder}/{key}/mark")

    def load(self, *keys: str, modified: float | None = None) -> DataFrame | None:
        """The entry of the first key that has one, if its mark is whole, its input was modified at ``modified`` (where given) but for two seconds, and every stem is there."""
        for key in keys:
            if not self._exists(f"{self._folder}/{key}"):
                continue
            if not self._exists(f"{self._folder}/{key}/mark/_SUCCESS"):
                return None
            mark = self._spark.read.schema("key string, modified double, stems array<string>").json(f"{self._folder}/{key}/mark").first()
            paths = [f"{self._folder}/{key}/stems/{quote(n, safe='')}" for n in mark["stems"] or []]
            stale = modified is not None and abs(mark["modified"] - modified) > TOLERANCE
            if stale or not paths or not all(self._exists(f"{p}/_SUCCESS") for p in paths):
                return None
            return self._spark.read.parquet(*paths)
        return None

    def _fs(self, path: str):
        p = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def _drop(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _move(self, source: str, target: str) -> None:
        (a, fs), (b, _) = self._fs(source), self._fs(target)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"{source} could not take the place of {target}")
