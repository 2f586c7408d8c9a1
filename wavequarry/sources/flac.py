"""FLAC decoding, and reads of a file split by ranges of frames (IO1, IO2).

A file's header is read, and its bytes are searched for frames by spans, each in a task of its own: a frame's sync code,
confirmed by the checksum of its header. What is found, a few numbers for each frame, is chained file by file by the number that each frame must have. Ranges of
frames are then dealt to tasks, each of which reads its own bytes and decodes them. A frame says itself what it is, so
nothing goes from one to the next, and no task holds a file's bytes.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.sources import ranges
from wavequarry.sources.wav import WavError, chosen, described, probed

#: Frames that are read and decoded together.
RANGE = 64
#: Bytes in which frames are searched for together, and the most that a frame's header takes.
SPAN, HEADER = 1 << 22, 16
_SYNC = re.compile(rb"\xff[\xf8\xf9]")
# Fixed values of the format: rates and sizes by code, and what each channel assignment has as its second kind of channel.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        v = b << (bits - 8)
        for _ in range(8):
            v = ((v << 1) ^ poly if v & top else v << 1) & mask
        out.append(v)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    v = 0
    for b in data:
        v = _CRC8[v ^ b]
    return v


def crc16(data: bytes) -> int:
    v = 0
    for b in data:
        v = (v << 8 & 0xFF00) ^ _CRC16[v >> 8 ^ b]
    return v


def parse_header(data: bytes) -> dict:
    """IO2: rate, channels, bits, frames (samples of a channel), the largest block, and where the first frame begins."""
    return read_header(io.BytesIO(data), len(data))


def read_header(f: IO[bytes], length: int) -> dict:
    """IO2: as ``parse_header``, from an open file; of its metadata only the stream information is read."""
    if f.read(4) != b"fLaC":
        raise WavError("not a FLAC file")
    at, info = 4, None
    while at < length and len(head := f.read(4)) == 4:
        kind, size = head[0], int.from_bytes(head[1:], "big")
        if kind & 0x7F == 0:
            body = f.read(18)
            v = int.from_bytes(body[10:], "big")
            info = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "frames": v & (1 << 36) - 1,
                    "least": int.from_bytes(body[:2], "big"), "block": int.from_bytes(body[2:4], "big")}
        at += 4 + size
        if kind & 0x80:
            if info is None:
                raise WavError("no stream information")
            return info | {"start": at}
        f.seek(at)
    raise WavError("a FLAC file without an end of its metadata")


class _Bits:
    """Bits of a frame, read from the left. A run of Rice codes is read with the places of all set bits known."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.bits)
        self.at = 0

    def unsigned(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise WavError("a frame ends too soon")
        v = 0
        for b in self.bits[self.at:self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.unsigned(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def block(self, count: int, n: int) -> np.ndarray:
        """``count`` signed numbers of ``n`` bits."""
        if not n:
            return np.zeros(count, np.int64)
        own = self.bits[self.at:self.at + count * n]
        if len(own) < count * n:
            raise WavError("a frame ends too soon")
        self.at += count * n
        v = own.reshape(count, n).astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
        return np.where(own.reshape(count, n)[:, 0] == 1, v - (1 << n), v)

    def unary(self) -> int:
        k = int(np.searchsorted(self.ones, self.at))
        if k == len(self.ones):
            raise WavError("a frame ends too soon")
        n = int(self.ones[k]) - self.at
        self.at = int(self.ones[k]) + 1
        return n

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` numbers: zeros up to a one say the high part, ``k`` bits the low one, the last bit the sign."""
        ends, at, i, ones, total = [], self.at, int(np.searchsorted(self.ones, self.at)), self.ones, len(self.ones)
        starts = []
        for _ in range(count):
            while i < total and ones[i] < at:
                i += 1
            if i == total:
                raise WavError("a frame ends too soon")
            starts.append(at)
            end = int(ones[i])
            ends.append(end)
            at = end + 1 + k
        self.at = at
        if at > len(self.bits):
            raise WavError("a frame ends too soon")
        end, high = np.array(ends), np.array(ends) - np.array(starts)
        low = np.zeros(count, np.int64)
        for j in range(k):
            low = low << 1 | self.bits[end + 1 + j]
        v = high.astype(np.int64) << k | low
        return v >> 1 ^ -(v & 1)


def frame_header(data: bytes, at: int, info: dict) -> dict | None:
    """The header of the frame at ``at``: its first sample, size, channel assignment, bits and own length; None where there is none."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size_code, rate_code, kind, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if not size_code or rate_code == 15 or kind > 10 or bits_code == 3:
        return None
    p = at + 4
    lead = data[p]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if more == 1 or more > 7 or p + max(more, 1) > len(data):
        return None
    number = lead if not more else lead & (1 << (7 - more)) - 1 if more < 7 else 0
    for b in data[p + 1:p + max(more, 1)]:
        if b & 0xC0 != 0x80:
            return None
        number = number << 6 | b & 0x3F
    p += max(more, 1)
    extra = {6: 1, 7: 2}.get(size_code, 0)
    size = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else 256 << (size_code - 8) if size_code >= 8 else int.from_bytes(data[p:p + extra], "big") + 1
    p += extra + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    variable = data[at + 1] & 1
    return {"first": number if variable else number * info["block"], "size": size, "kind": kind, "bits": BITS.get(bits_code, info["bits"]), "length": p + 1 - at}


def candidates(data: bytes, info: dict, begin: int, end: int) -> list[tuple[int, int, int, int]]:
    """``(byte, first sample, size, header's length)`` of what looks like a frame and begins in ``data[begin:end]``: a sync code whose header has its checksum."""
    found = ((m.start(), frame_header(data, m.start(), info)) for m in _SYNC.finditer(data, begin, min(len(data), end + 1)))
    return [(at, h["first"], h["size"], h["length"]) for at, h in found if h and at < end]


def chained(found: Iterable[tuple[int, int, int, int]], frames: int) -> list[tuple[int, int]]:
    """``(first sample, byte)`` of every frame: of what looks like one, in order, what goes on where the frame before ends. Other than ``frames`` samples in all (if that is known) are an error."""
    out, want, after = [], 0, 0
    for at, first, size, length in found:
        if first == want and at >= after:
            out.append((want, at))
            want, after = want + size, at + length
    if frames and want != frames:
        raise WavError(f"{want} samples were found where the file has {frames}")
    return out


def frame_places(data: bytes, info: dict) -> list[tuple[int, int]]:
    """``(first sample, byte)`` of every frame of a file that is at hand."""
    return chained(candidates(data, info, info["start"], len(data)), info["frames"])


def _subframe(r: _Bits, size: int, bits: int) -> np.ndarray:
    if r.unsigned(1):
        raise WavError("a subframe must begin with a zero")
    kind, wasted = r.unsigned(6), 0
    if r.unsigned(1):
        wasted = r.unary() + 1
    bits -= wasted
    if kind == 0:
        out = np.full(size, r.signed(bits), np.int64)
    elif kind == 1:
        out = r.block(size, bits)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        warm = [r.signed(bits) for _ in range(order)]
        coefficients, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision = r.unsigned(4) + 1
            shift = r.signed(5)
            coefficients = tuple(r.signed(precision) for _ in range(order))
        out = _predicted(warm, coefficients, shift, _residual(r, size, order))
    else:
        raise WavError(f"subframes of kind {kind} are reserved")
    return out << wasted


def _residual(r: _Bits, size: int, order: int) -> np.ndarray:
    method, parts = r.unsigned(2), 1 << r.unsigned(4)
    if method > 1:
        raise WavError("this coding of residuals is reserved")
    width, out = 4 + method, []
    for p in range(parts):
        count = size // parts - (order if p == 0 else 0)
        if count < 0:
            raise WavError("a partition is shorter than its predictor")
        k = r.unsigned(width)
        out.append(r.block(count, r.unsigned(5)) if k == (1 << width) - 1 else r.rice(count, k))
    return np.concatenate(out)


def _predicted(warm: list[int], coefficients: tuple[int, ...], shift: int, residual: np.ndarray) -> np.ndarray:
    """Each sample from the ones before it: the fixed predictors are sums of sums, the others go one by one."""
    order = len(warm)
    if order == 0:
        return residual
    if shift == 0 and coefficients == FIXED[min(order, 4)] and order <= 4:
        levels = [np.diff(np.array(warm, np.int64), n=k)[-1] for k in range(order)]  # the last difference of each order
        x = residual
        for k in reversed(range(order)):
            x = levels[k] + np.cumsum(x)
        return np.concatenate([np.array(warm, np.int64), x])
    x = list(warm)
    back = coefficients[::-1]
    for e in residual.tolist():
        x.append(e + (sum(map(int.__mul__, back, x[-order:])) >> shift))
    return np.array(x, np.int64)


def decode_frame(data: bytes, at: int, info: dict, end: int | None = None) -> tuple[int, np.ndarray]:
    """The first sample and the samples, whole numbers of shape (size, channels), of the frame at ``at``."""
    h = frame_header(data, at, info)
    if h is None:
        raise WavError("no frame where one was found")
    r = _Bits(data[at + h["length"]:end])
    kind, count = h["kind"], h["kind"] + 1 if h["kind"] < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(kind, -1)
    x = [_subframe(r, h["size"], h["bits"] + (c == side)) for c in range(count)]
    used = at + h["length"] + -(-r.at // 8)
    if crc16(data[at:used]) != int.from_bytes(data[used:used + 2], "big"):
        raise WavError("a frame's checksum is wrong")
    if kind == 8:
        x[1] = x[0] - x[1]
    elif kind == 9:
        x[0] = x[0] + x[1]
    elif kind == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [mid + x[1] >> 1, mid - x[1] >> 1]
    return h["first"], np.stack(x, axis=1)


def read_signal(spark: SparkSession, path: str, labels: list[str] | None = None, per_task: int = RANGE, named: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """IO1: ``(asset, channel, n, x)`` of the FLAC files below ``path``, in [-1, 1); channels are named by ``labels`` or their number.

    Frames are searched for in spans of ``span`` bytes and decoded in ranges of ``per_task`` frames, each read where it is decoded.
    With ``named(path, named[, first, last])`` only those files, under the names that it gives, and of them only those samples; frames that hold none aren't decoded.
    A file whose header can't be read, or whose frames don't make up its samples, is an error.
    """
    keys, c = ("start", "bits", "block", "frames"), F.col

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                if isinstance(row.error, str):
                    raise WavError(f"{row.path}: {row.error}")
                begin = row.start + row.span * span
                data = ranges.read_part(row.path, begin, begin + span + HEADER)
                own = candidates(data, {"bits": row.bits, "block": row.block}, 0, span)
                found.append([[v[k] + (begin if k == 0 else 0) for v in own] for k in range(4)])
            yield pdf.drop(columns="error").assign(**{k: [v[j] for v in found] for j, k in enumerate(("at", "n", "size", "head"))})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Ranges of one file's frames; it holds a few numbers for each frame of the file."""
        pdf, one = pdf.sort_values("span"), pdf.iloc[0]
        every = zip(*(np.concatenate([np.asarray(v, np.int64) for v in pdf[k]]).tolist() for k in ("at", "n", "size", "head")), strict=True)
        places = chained(every, int(one["frames"]))
        ends = [*(at for _, at in places[1:]), int(one["length"])]
        stops = [*(n for n, _ in places[1:]), None]
        low = 0 if pd.isna(one["first"]) else one["first"]
        wanted = [(at, end) for (n, at), stop, end in zip(places, stops, ends, strict=True) if (stop is None or stop > low) and (pd.isna(one["last"]) or n < one["last"])]
        parts = [wanted[k:k + per_task] for k in range(0, len(wanted), per_task)]
        same = {k: [one[k]] * len(parts) for k in ("path", "asset", "bits", "block", "first", "last")}
        return pd.DataFrame(same | {"part": range(len(parts)), "at": [[a for a, _ in p] for p in parts], "till": [p[-1][1] for p in parts]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                base, info = int(row.at[0]), {"bits": int(row.bits), "block": int(row.block)}
                data, places = ranges.read_part(row.path, base, int(row.till)), [int(a) - base for a in row.at]
                for a, b in zip(places, [*places[1:], len(data)], strict=True):
                    n, x = decode_frame(data, a, info, b)
                    low = 0 if pd.isna(row.first) else max(0, int(row.first) - n)
                    high = len(x) if pd.isna(row.last) else max(0, int(row.last) - n)
                    for k in range(x.shape[1]):
                        own = x[low:high, k]
                        yield pd.DataFrame({"asset": row.asset, "channel": labels[k] if labels else str(k), "n": np.arange(n + low, n + low + len(own)), "x": own / 2.0 ** (info["bits"] - 1)})

    files = chosen(ranges.listed(spark, path, "*.flac"), named)
    heads = probed(files, read_header, keys)
    zero = F.array(F.lit(0).cast("bigint"))
    spans = heads.withColumn("span", F.explode(F.when(c("error").isNotNull() | (c("start") >= c("length")), zero).otherwise(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1 - start) div {span}")))))
    spans = spans.select("path", "length", "asset", "first", "last", "error", "span", *(F.coalesce(k, F.lit(0)).alias(k) for k in keys))
    numbers = "at array<bigint>, n array<bigint>, size array<bigint>, head array<bigint>"
    found = ranges.dealt(spans, files, "path", "span").mapInPandas(search, f"path string, length bigint, asset string, first bigint, last bigint, span bigint, {', '.join(f'{k} bigint' for k in keys)}, {numbers}")
    parts = found.groupBy("path", "asset").applyInPandas(chain, "path string, asset string, bits bigint, block bigint, first bigint, last bigint, part bigint, at array<bigint>, till bigint")
    return ranges.dealt(parts, files, "path", "part").mapInPandas(decode, "asset string, channel string, n bigint, x double")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """IO2: ``(path, length, rate, channels, bits, frames, error)`` of the FLAC files below ``path``, whose frames aren't read."""
    return described(probed(ranges.listed(spark, path, "*.flac"), read_header, ("rate", "channels", "bits", "frames")))
