"""Files of many tracks written by blocks in parallel, read again and published by rename (IO3 to IO6, IO11).

Where each block of a file stands is known before any sample is: a header's length and the frames before it say so. So each
block is encoded in a task of its own and written at its place in a file beside the target, on the file system
that driver and executors share; a task that runs again writes the same bytes at the same place. When all blocks are there, each
is read back and held against its checksum, the header is parsed again, and a rename publishes the file. No task holds more than a block of all tracks.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.catalog import OUTPUT_LAYOUTS
from wavequarry.functions import dsp
from wavequarry.operators import chunks
from wavequarry.operators.upmix import Routing
from wavequarry.plans.batch import BED_LAYOUTS
from wavequarry.sources import adm
from wavequarry.sources.wav import WavError, chunk, encode_pcm, format_chunk, parse_header

#: Frames of a block.
BLOCK = 262_144
#: A RIFF file's size is a number of 32 bits.
MOST_BYTES = 0xFFFFFFFF

#: What a file is: its beds as JSON, ``[[name, [label, ...]], ...]``, and its loudness; a plain file has one unnamed bed.
PLAN = "asset string, beds string, frames bigint, lkfs double, dbtp double"


def layout_of(beds: list, frames: int, rate: int, bits: int, packaged: bool, lkfs: float | None, dbtp: float | None) -> tuple[bytes, bytes]:
    """What comes before the samples and what comes after them; more than 4 GiB in all is an error."""
    tracks = sum(len(own) for _, own in beds)
    size = frames * tracks * bits // 8
    before, after = format_chunk(tracks, rate, bits), b"\0" * (size & 1)
    if packaged:
        if len(beds) > adm.MOST_BEDS or tracks > adm.MOST_TRACKS:
            raise WavError("at most 64 beds and 128 tracks")
        before += chunk(b"bext", adm.bext_body(lkfs, dbtp))
        after += chunk(b"axml", adm.axml_body([(n, own) for n, own in beds], frames / rate, rate, bits)) + chunk(b"chna", adm.chna_body([own for _, own in beds])) + chunk(b"dbmd", struct.pack("<IHH", 1, 1, 0))
    whole = 4 + len(before) + 8 + size + len(after)
    if whole > MOST_BYTES:
        raise WavError(f"{whole} bytes are more than a RIFF file's 4 GiB")
    return b"RIFF" + whole.to_bytes(4, "little") + b"WAVE" + before + b"data" + size.to_bytes(4, "little"), after


def target_of(folder: str, asset: str) -> str:
    """The asset's file, which must be inside the folder."""
    path = os.path.normpath(os.path.join(folder, f"{asset}.wav"))
    if not path.startswith(os.path.normpath(folder) + os.sep):
        raise WavError(f"{asset} leaves the output folder")
    return path


def _beside(path: str, run: str) -> str:
    return os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{run}.part")


def write_files(rows: DataFrame, plans: DataFrame, rate: int, folder: str, bits: int = 24, packaged: bool = False, size: int = BLOCK) -> DataFrame:
    """``(asset, path, tracks, frames, bytes)`` of the published files.

    ``rows(asset, channel, chunk, x)`` are chunk rows of ``size`` frames whose channel is the number of the track; one that ends before the
    asset's ``frames`` is padded with silence. ``plans`` has a row of ``PLAN`` for each asset. ``folder`` is on a file system that all executors share. If
    anything fails, nothing is published and what was written beside the targets is removed.
    """
    spark, run = plans.sparkSession, uuid.uuid4().hex
    plans = plans.select(*(c.split()[0] for c in PLAN.split(", ")))
    parts = lambda pdf: ((a, json.loads(b), int(n), None if l is None or np.isnan(l) else l, None if t is None or np.isnan(t) else t)
                         for a, b, n, l, t in zip(*(pdf[c.split()[0]] for c in PLAN.split(", ")), strict=True))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for asset, beds, frames, lkfs, dbtp in parts(pdf):
                path, tracks = target_of(folder, asset), sum(len(own) for _, own in beds)
                head, tail = layout_of(beds, frames, rate, bits, packaged, lkfs, dbtp)
                data = frames * tracks * bits // 8
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(_beside(path, run), "wb") as f:
                    f.write(head)
                    f.seek(len(head) + data)
                    f.write(tail)
                    f.truncate(len(head) + data + len(tail))
                out.append((asset, len(head), tracks, frames))
            yield pd.DataFrame(out, columns=["asset", "start", "tracks", "frames"])

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asset, k = key
        start, tracks, frames = (int(pdf[c].iloc[0]) for c in ("start", "tracks", "frames"))
        x = np.zeros((min(size, frames - k * size), tracks))
        for track, own in zip(pdf["channel"], pdf["x"], strict=True):
            if own is not None and track is not None:
                own = np.asarray(own, np.float64)[:len(x)]
                x[:len(own), int(track)] = own
        raw = encode_pcm(x, bits)
        at = start + k * size * tracks * bits // 8
        with open(_beside(target_of(folder, asset), run), "r+b") as f:
            f.seek(at)
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        return pd.DataFrame({"asset": [asset], "at": [at], "len": [len(raw)], "crc": [zlib.crc32(raw)]})

    def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for asset, at, n, crc in zip(pdf["asset"], pdf["at"], pdf["len"], pdf["crc"], strict=True):
                with open(_beside(target_of(folder, asset), run), "rb") as f:
                    f.seek(at)
                    good.append(zlib.crc32(f.read(n)) == crc)
            yield pd.DataFrame({"asset": pdf["asset"], "len": pdf["len"], "good": good})

    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for asset, tracks, frames in zip(pdf["asset"], pdf["tracks"], pdf["frames"], strict=True):
                path = target_of(folder, asset)
                beside = _beside(path, run)
                if os.path.exists(beside):  # a task that runs again finds it published
                    os.replace(beside, path)
                out.append((asset, path, tracks, frames, os.path.getsize(path)))
            yield pd.DataFrame(out, columns=["asset", "path", "tracks", "frames", "bytes"])

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for asset in pdf["asset"]:
                try:
                    os.unlink(_beside(target_of(folder, asset), run))
                except (FileNotFoundError, WavError):
                    pass
            yield pdf[["asset"]]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wrong = []
            for asset, tracks, frames, done, good in zip(pdf["asset"], pdf["tracks"], pdf["frames"], pdf["done"], pdf["good"], strict=True):
                with open(_beside(target_of(folder, asset), run), "rb") as f:
                    head = f.read(1 << 16)
                    f.seek(0, os.SEEK_END)
                    found = parse_header(head, f.tell())
                same = (found["rate"], found["channels"], found["bits"], found["frames"]) == (rate, tracks, bits, frames)
                wrong.append(None if same and good and done == frames * tracks * bits // 8 else f"{asset}: what was written isn't what was asked for")
            yield pd.DataFrame({"wrong": wrong})

    try:
        begun = chunks.settled(plans.mapInPandas(begin, "asset string, start bigint, tracks bigint, frames bigint"))
        grid = begun.where("frames > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(frames - 1) div {size}"))).alias("chunk"))
        dealt = grid.join(rows.select("asset", "channel", "chunk", "x"), ["asset", "chunk"], "left")
        written = chunks.settled(dealt.groupBy("asset", "chunk").applyInPandas(write, "asset string, at bigint, len bigint, crc bigint"))
        seen = written.mapInPandas(read_back, "asset string, len bigint, good boolean").groupBy("asset").agg(F.sum("len").alias("done"), F.bool_and("good").alias("good"))
        state = begun.join(seen, "asset", "left").na.fill({"done": 0, "good": True})
        wrong = state.select("asset", "tracks", "frames", "done", "good").mapInPandas(check, "wrong string").where("wrong IS NOT NULL").limit(1).collect()
        if wrong:
            raise WavError(wrong[0]["wrong"])
        return spark.createDataFrame(begun.mapInPandas(publish, "asset string, path string, tracks bigint, frames bigint, bytes bigint").toPandas())  # a row for each asset
    except BaseException:
        plans.select("asset").mapInPandas(remove, "asset string").count()
        raise


def _frames(rows: DataFrame, size: int) -> DataFrame:
    """Each channel's frames."""
    return rows.groupBy("asset", "channel").agg((F.max("chunk") * size + F.max_by(F.size("x"), "chunk")).alias("frames"))


def write_beds(signal: DataFrame, layout: str, rate: int, folder: str, measured: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """IO5: a packaged file of one bed for each asset of ``signal(asset, channel, n, x)``, 24 bits, 48 or 96 kHz, with the loudness of ``measured(asset, lkfs, dbtp)`` in it.

    Channels of the layout that are missing or differ in length are an error; others are left out.
    """
    _packageable(layout, rate)
    return _one_bed(signal, OUTPUT_LAYOUTS[layout].split(), layout, rate, folder, 24, True, measured, size)


def write_waves(signal: DataFrame, order: list[str], rate: int, folder: str, bits: int = 24, size: int = BLOCK) -> DataFrame:
    """IO3: a plain file for each asset, its channels in ``order``; channels that are missing or differ in length are an error."""
    return _one_bed(signal, order, "", rate, folder, bits, False, None, size)


def _packageable(layout: str, rate: int) -> None:
    if layout not in BED_LAYOUTS:
        raise WavError(f"{layout} is no bed; beds are {', '.join(BED_LAYOUTS)}")
    if rate not in (48_000, 96_000):
        raise WavError("a bed has 48 or 96 kHz")


def _one_bed(signal: DataFrame, order: list[str], name: str, rate: int, folder: str, bits: int, packaged: bool, measured: DataFrame | None, size: int) -> DataFrame:
    spark = signal.sparkSession
    packed = chunks.settled(chunks.pack(signal.where(F.col("channel").isin(*order)), size))
    each = _frames(packed, size).groupBy("asset").agg(F.count("*").alias("k"), F.min("frames").alias("least"), F.max("frames").alias("frames"))
    each = signal.select("asset").distinct().join(each, "asset", "left")
    bad = each.where(f"k IS NULL OR k <> {len(order)} OR least <> frames").limit(1).collect()
    if bad:
        raise WavError(f"{bad[0]['asset']}: each channel of {' '.join(order)} needs the same samples")
    plans = each.select("asset", F.lit(json.dumps([[name, order]])).alias("beds"), "frames")
    plans = plans.join(measured.select("asset", "lkfs", "dbtp"), "asset", "left") if measured is not None else plans.select("*", F.lit(None).cast("double").alias("lkfs"), F.lit(None).cast("double").alias("dbtp"))
    tracks = spark.createDataFrame([(c, str(k)) for k, c in enumerate(order)], "channel string, track string")
    rows = packed.join(F.broadcast(tracks), "channel").select("asset", F.col("track").alias("channel"), "chunk", "x")  # at most 128 tracks
    return write_files(rows, plans, rate, folder, bits, packaged, size)


def write_stem_beds(stems: DataFrame, routes: DataFrame, layout: str, rate: int, folder: str, passthrough: DataFrame | None = None, r: Routing = Routing(), size: int = BLOCK) -> DataFrame:
    """IO6: a bed for each stem of ``stems(asset, stem, n, l, r)`` with a track for each channel of the layout that ``routes(stem, channel, gain)`` name, all in one file for each asset.

    Left channels take the stem's left, right ones its right, the centre its mean, at their gains; the LFE, last of a bed, takes the mean low-passed, where its gain
    is above 0. ``passthrough(asset, channel, n, x)`` becomes a bed of its own, last. Shorter tracks are padded; an asset without a track is an error.
    """
    _packageable(layout, rate)
    have, c = OUTPUT_LAYOUTS[layout].split(), F.col
    side = lambda ch: F.when(ch.isin("C", "LFE"), "M").otherwise(F.substring(ch, -1, 1))
    key = lambda s: F.concat("stem", F.lit(f"\x1f{s}"))
    long = stems.select("asset", "n", F.inline(F.array(*(F.struct(key(s).alias("channel"), v.alias("x")) for s, v in (("L", c("l")), ("R", c("r")), ("M", (c("l") + c("r")) / 2))))))
    packed = chunks.pack(long, size)
    wanted = routes.where(c("channel").isin(*have) & ((c("channel") != "LFE") | (c("gain") > 0))).select("stem", "channel", "gain", side(c("channel")).alias("side"))
    split = F.split("channel", "\x1f")
    sources = packed.select("asset", split[0].alias("stem"), split[1].alias("side"), "chunk", "x")
    routed = sources.join(wanted, ["stem", "side"]).select("asset", "stem", "channel", "chunk", F.transform("x", lambda v: v * c("gain")).alias("x"))
    named = routed.select("asset", F.concat("stem", F.lit("\x1f"), "channel").alias("channel"), "chunk", "x")
    low = c("channel").endswith("\x1fLFE")
    bus = chunks.series(dsp.butterworth(r.lfe_order, r.lfe_hz, rate), out=lambda y, _: r.lfe * y)
    rows = named.where(~low).unionByName(chunks.linear(named.where(low), bus, size))
    if passthrough is not None:
        passed = chunks.pack(passthrough.where(c("channel").isin(*have)), size)
        rows = rows.unionByName(passed.select("asset", F.concat(F.lit("\x1f"), "channel").alias("channel"), "chunk", "x"))
    order = {ch: k for k, ch in enumerate(have)}

    def number(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The beds of an asset, stems by name and then what is passed through, and the number of each track."""
        own = sorted(((s == "", s, ch == "LFE" and s != "", ch if s == "" else order[ch], ch) for s, ch in (x.split("\x1f") for x in pdf["channel"])))
        beds: dict[str, list[str]] = {}
        for _, s, _, _, ch in own:
            beds.setdefault(s, []).append(ch)
        listed = [["Passthrough" if not s else s.replace("@", " (") + ")" * ("@" in s), labels] for s, labels in beds.items()]
        names = [f"{s}\x1f{ch}" for s, labels in beds.items() for ch in labels]
        return pd.DataFrame({"asset": key[0], "channel": names, "track": [str(k) for k in range(len(names))], "beds": json.dumps(listed), "frames": int(pdf["frames"].max())})

    rows = chunks.settled(rows)
    numbered = chunks.settled(_frames(rows, size).groupBy("asset").applyInPandas(number, "asset string, channel string, track string, beds string, frames bigint"))
    silent = stems.select("asset").distinct().join(numbered.select("asset"), "asset", "left_anti").limit(1).collect()
    if silent:
        raise WavError(f"{silent[0]['asset']}: no stem has a route")
    plans = numbered.select("asset", "beds", "frames").distinct().select("*", F.lit(None).cast("double").alias("lkfs"), F.lit(None).cast("double").alias("dbtp"))
    placed = rows.join(numbered.select("asset", "channel", "track"), ["asset", "channel"]).select("asset", c("track").alias("channel"), "chunk", "x")
    return write_files(placed, plans, rate, folder, 24, True, size)

