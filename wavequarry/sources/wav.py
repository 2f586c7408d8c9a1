"""PCM WAV files, integer and real, as a Spark source, and writers (IO1 to IO5, IO7, IO11, IO12)."""

from __future__ import annotations

import io
import os
import struct
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequarry.sources import ranges

#: Frames of a block that one read takes.
FRAMES = 65_536


class WavError(ValueError):
    """Not a PCM WAV file."""


def parse_header(data: bytes, length: int | None = None) -> dict:
    """IO2: rate, channels, bits, frames and where the samples start, without decoding; ``data`` may be only the beginning of a file of ``length`` bytes."""
    return read_header(io.BytesIO(data), len(data) if length is None else length)


def read_header(f: IO[bytes], length: int) -> dict:
    """IO2: as ``parse_header``, from an open file of ``length`` bytes; of chunks before the samples only their heads are read. Files of over 4 GiB say their size in a chunk of 64-bit numbers."""
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise WavError("not a WAV file")
    at, fmt, long = 12, None, None
    while len(head := f.read(8)) == 8:
        tag, size = head[:4], int.from_bytes(head[4:], "little")
        if tag == b"ds64":
            long = int.from_bytes(f.read(16)[8:], "little")
        elif tag == b"fmt ":
            body = f.read(min(size, 40))
            if len(body) < 16:
                raise WavError("the format ends too soon")
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", body)
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack_from("<H", body, 24)[0]
            if (kind, bits) not in ((1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
                raise WavError(f"format {kind} with {bits} bits isn't supported")
            if not channels or align != channels * bits // 8:
                raise WavError(f"{channels} channels of {bits} bits don't take {align} bytes")
            fmt = {"rate": rate, "channels": channels, "bits": bits, "align": align, "real": kind == 3}
        elif tag == b"data":
            if fmt is None:
                raise WavError("samples before their format")
            size = long if long is not None and size == 0xFFFFFFFF else size
            return fmt | {"frames": min(size, length - at - 8) // fmt["align"], "start": at + 8}
        at += 8 + size + (size & 1)
        f.seek(at)
    raise WavError("no samples")


def decode_pcm(raw: bytes, bits: int, channels: int, real: bool = False) -> np.ndarray:
    """Samples as doubles, integers in [-1, 1) and real ones as they are, shape (frames, channels)."""
    if real:
        return np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64).reshape(-1, channels)
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        v = (b[:, 0].astype(np.int32) << 8 | b[:, 1].astype(np.int32) << 16 | b[:, 2].astype(np.int32) << 24) >> 8
    else:
        v = np.frombuffer(raw, f"<i{bits // 8}")
    return (v.astype(np.float64) / 2 ** (bits - 1)).reshape(-1, channels)


def encode_pcm(x: np.ndarray, bits: int) -> bytes:
    """IO12: clipped, scaled, rounded half to even, little-endian."""
    v = np.rint(np.clip(x, -1.0, 1.0) * (2 ** (bits - 1) - 1)).astype("<i4").ravel()
    if bits == 24:
        return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return v.astype(f"<i{bits // 8}").tobytes()


def chunk(tag: bytes, body: bytes) -> bytes:
    """IO11: a RIFF chunk, padded to even length."""
    return tag + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def format_chunk(channels: int, rate: int, bits: int) -> bytes:
    """IO7."""
    align = channels * bits // 8
    return chunk(b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * align, align, bits))


def wav_bytes(x: np.ndarray, rate: int, bits: int = 24, extra: tuple[tuple[bytes, bytes], ...] = ()) -> bytes:
    """IO3, IO5: a whole file; ``extra`` chunks follow the format."""
    x = np.atleast_2d(np.asarray(x, np.float64).T).T
    body = format_chunk(x.shape[1], rate, bits) + b"".join(chunk(t, b) for t, b in extra) + chunk(b"data", encode_pcm(x, bits))
    if len(body) + 4 >= 1 << 32:
        raise WavError("a WAV file ends at 4 GiB")
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WAVE" + body


@contextmanager
def atomic_path(path: str):
    """IO4: a sibling file that takes the place of ``path`` when all went well, and goes away otherwise."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=os.path.splitext(path)[1])
    os.close(handle)
    try:
        yield temporary
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def probed(files: DataFrame, header: Callable[[IO[bytes], int], dict], keys: tuple[str, ...]) -> DataFrame:
    """``files(path, length, ...)`` with the header's ``keys`` as numbers, and ``error`` where it can't be read. Only headers are read."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[dict] = []
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                try:
                    with ranges.opened(path) as f:
                        found = header(f, int(length))
                    rows.append({k: int(found[k]) for k in keys} | {"error": None})
                except WavError as e:
                    rows.append(dict.fromkeys(keys) | {"error": str(e)})
            own = pd.DataFrame(rows, columns=[*keys, "error"], index=pdf.index)
            yield pdf.assign(**{k: own[k].astype("Int64") for k in keys}, error=own["error"].astype(object))

    return files.mapInPandas(probe, T.StructType([*files.schema.fields, *(T.StructField(k, T.LongType()) for k in keys), T.StructField("error", T.StringType())]))


def described(files: DataFrame) -> DataFrame:
    """IO2: what a user is told of probed files."""
    return files.select("path", "length", *(F.col(k).cast("int").alias(k) for k in ("rate", "channels", "bits")), "frames", "error")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """IO2: ``(path, length, rate, channels, bits, frames, error, duration)`` of the files below ``path``, whose samples aren't read."""
    found = probed(ranges.listed(spark, path, "*.wav"), read_header, ("rate", "channels", "bits", "frames"))
    return described(found).withColumn("duration", F.col("frames") / F.col("rate"))


def chosen(files: DataFrame, named: DataFrame | None) -> DataFrame:
    """``(path, length, asset, first, last)``: the files to read, what they are called, and the samples that are wanted, ``last`` not among them.

    ``named(path, named[, first, last])`` says so; a null there is the file's beginning or end. Without it all files are read, as a whole, and called by their paths.
    """
    if named is None:
        return files.select("path", "length", F.col("path").alias("asset"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))
    bound = lambda c: (F.col(c) if c in named.columns else F.lit(None)).cast("bigint").alias(c)
    return files.join(named.select("path", F.col("named").alias("asset"), bound("first"), bound("last")), "path").select("path", "length", "asset", "first", "last")


def read_signal(spark: SparkSession, path: str, labels: list[str] | None = None, named: DataFrame | None = None, size: int = FRAMES) -> DataFrame:
    """IO1: ``(asset, channel, n, x)`` of the files below ``path``; channels are named by ``labels`` or their number.

    With ``named(path, named[, first, last])`` only those files, under the names that it gives, and of them only those samples. Files are read by
    blocks of ``size`` frames, each in the task that decodes it, so a long file is as many tasks' work as its bytes are worth, and samples that aren't wanted aren't read.
    A file whose header can't be read is an error.
    """
    keys = ("start", "align", "bits", "channels", "real", "frames")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if isinstance(row.error, str):
                    raise WavError(f"{row.path}: {row.error}")
                begin, end = max(row.block * size, row.begin), min((row.block + 1) * size, row.end)
                if begin >= end:
                    continue
                x = decode_pcm(ranges.read_part(row.path, row.start + begin * row.align, row.start + end * row.align), row.bits, row.channels, bool(row.real))
                for c in range(row.channels):
                    yield pd.DataFrame({"asset": row.asset, "channel": labels[c] if labels else str(c), "n": np.arange(begin, begin + len(x)), "x": x[:, c]})

    files = chosen(ranges.listed(spark, path, "*.wav"), named)
    begin, end = F.greatest(F.coalesce("first", F.lit(0)), F.lit(0)), F.least(F.coalesce("last", "frames"), "frames")
    heads = probed(files, read_header, keys).withColumn("begin", begin).withColumn("end", end)
    # a file that can't be read keeps one row, which says so
    blocks = heads.withColumn("block", F.explode(F.when(F.col("error").isNotNull(), F.array(F.lit(0).cast("bigint"))).when(F.col("begin") < F.col("end"), F.sequence(F.expr(f"begin div {size}"), F.expr(f"(end - 1) div {size}")))))
    wanted = blocks.select("path", "asset", "error", "block", *(F.coalesce(k, F.lit(0)).alias(k) for k in (*keys, "begin", "end")))
    return ranges.dealt(wanted, files, "path", "block").mapInPandas(decode, "asset string, channel string, n bigint, x double")


def encode_assets(signal: DataFrame, order: list[str], rate: int, bits: int = 24) -> DataFrame:
    """IO3: ``(asset, wav)``: each asset's file, its channels in ``order``; one that lacks a channel is an error. Chunks go through one task per asset."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="n", columns="channel", values="x").sort_index()
        missing = [c for c in order if c not in wide]
        if missing:
            raise WavError(f"channels are missing: {missing}")
        data = wav_bytes(wide[order].to_numpy(), rate, bits)
        back = parse_header(data)
        assert (back["rate"], back["channels"]) == (rate, len(order))
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "wav": [data]})

    return signal.select("asset", "channel", "n", "x").groupBy("asset").applyInPandas(build, "asset string, wav binary")


def chunks_of(data: bytes) -> list[tuple[str, int]]:
    """Tags and sizes of a file's chunks."""
    out, f = [], io.BytesIO(data)
    f.seek(12)
    while len(head := f.read(8)) == 8:
        size = int.from_bytes(head[4:], "little")
        out.append((head[:4].decode("ascii", "replace"), size))
        f.seek(size + (size & 1), 1)
    return out
