"""Object-audio packaging: bed files with track, loudness and format metadata (IO5 to IO11)."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavequarry.catalog import LABELS, OUTPUT_LAYOUTS
from wavequarry.sources.wav import WavError, wav_bytes

# The profile's channel names and speaker labels.
CHANNEL_NAMES = {
    "FL": ("RoomCentricLeft", "RC_L"), "FR": ("RoomCentricRight", "RC_R"), "C": ("RoomCentricCenter", "RC_C"), "LFE": ("RoomCentricLFE", "RC_LFE"),
    "SL": ("RoomCentricLeftSideSurround", "RC_Lss"), "SR": ("RoomCentricRightSideSurround", "RC_Rss"),
    "BL": ("RoomCentricLeftRearSurround", "RC_Lrs"), "BR": ("RoomCentricRightRearSurround", "RC_Rrs"),
    "TFL": ("RoomCentricLeftTopSurround", "RC_Lts"), "TFR": ("RoomCentricRightTopSurround", "RC_Rts"),
    "TBL": ("RoomCentricLeftTopRearSurround", "RC_Ltrs"), "TBR": ("RoomCentricRightTopRearSurround", "RC_Rtrs"),
}
#: The first id that isn't the standard's own.
FIRST_ID = 0x1001
MOST_BEDS, MOST_TRACKS = 64, 128
UNKNOWN_LOUDNESS = 0x7FFF
_PLACE = {label: xyz for label, _, *xyz in LABELS}


def fixed_width(text: str, width: int) -> bytes:
    """IO11: ASCII, padded with zeros; what doesn't fit is an error."""
    raw = text.encode("ascii")
    if len(raw) > width:
        raise WavError(f"{text!r} has more than {width} characters")
    return raw.ljust(width, b"\0")


def clock(seconds: float) -> str:
    """IO11: HH:MM:SS.sssss; negative times are zero."""
    ticks = round(max(0.0, seconds) * 100_000)
    return f"{ticks // 360_000_000:02d}:{ticks // 6_000_000 % 60:02d}:{ticks // 100_000 % 60:02d}.{ticks % 100_000:05d}"


def coordinate(v: float) -> str:
    return f"{v:.6g}"


def loudness_field(v: float | None) -> int:
    """IO8: hundredths in 16 bits."""
    return UNKNOWN_LOUDNESS if v is None else round(min(327.66, max(-327.68, v)) * 100)


def bext_body(lkfs: float | None, dbtp: float | None, when: datetime | None = None, name: str = "wavequarry") -> bytes:
    """IO8: broadcast metadata, version 2: 602 bytes, then a line end."""
    when = when or datetime.now(UTC)
    head = fixed_width(f"Generated by {name}", 256) + fixed_width(name, 32) + bytes(32) + when.strftime("%Y-%m-%d%H:%M:%S").encode() + bytes(8)
    loud = struct.pack("<hHhHH", loudness_field(lkfs), UNKNOWN_LOUDNESS, loudness_field(dbtp), UNKNOWN_LOUDNESS, UNKNOWN_LOUDNESS)
    return (head + struct.pack("<H", 2) + bytes(64) + loud).ljust(602, b"\0") + b"\r\n"


def chna_body(beds: list[list[str]]) -> bytes:
    """IO9: a row per track: number, UID, track format and the pack of its bed."""
    tracks = [(bed, label) for bed, labels in enumerate(beds) for label in labels]
    rows = [struct.pack("<H", k + 1) + fixed_width(f"ATU_{k + 1:08d}", 12) + fixed_width(f"AT_0001{FIRST_ID + k:04X}_01", 14) + fixed_width(f"AP_0001{FIRST_ID + bed:04X}", 11) + b"\0"
            for k, (bed, _) in enumerate(tracks)]
    return struct.pack("<HH", len(rows), len(rows)) + b"".join(rows)


def _add(parent: ET.Element, tag: str, text: str | None = None, **attributes: str) -> ET.Element:
    out = ET.SubElement(parent, tag, attributes)
    out.text = text
    return out


def axml_body(beds: list[tuple[str, list[str]]], seconds: float, rate: int, bits: int, strict: bool = True, system: str = "") -> bytes:
    """IO10: the document that says what each track is; one object and pack a bed, one channel, stream and track format a track."""
    root = ET.Element("audioFormatExtended", version="ITU-R_BS.2076-0" if strict else "ITU-R_BS.2076-2")
    zero, end = clock(0), clock(seconds)
    programme = _add(root, "audioProgramme", audioProgrammeID="APR_1001", audioProgrammeName="Main Programme", start=zero, end=end)
    contents = []
    for b, (name, _) in enumerate(beds):
        _add(programme, "audioContentIDRef", f"ACO_{FIRST_ID + b:04X}")
        content = _add(root, "audioContent", audioContentID=f"ACO_{FIRST_ID + b:04X}", audioContentName=f"{name} Bed")
        _add(content, "audioObjectIDRef", f"AO_{FIRST_ID + b:04X}")
        _add(content, "dialogue", "2", mixedContentKind="0")
        contents.append(content)
    if system and not strict:
        _add(programme, "audioProgrammeLabel", f"ITU-R BS.2051-3 System {system}", language="en")
    k = 0
    numbered: list[tuple[int, int, str]] = []
    for b, (name, labels) in enumerate(beds):
        pack = f"AP_0001{FIRST_ID + b:04X}"
        thing = _add(root, "audioObject", audioObjectID=f"AO_{FIRST_ID + b:04X}", audioObjectName=f"{name} Bed", start=zero, duration=end)
        _add(thing, "audioPackFormatIDRef", pack)
        packed = _add(root, "audioPackFormat", audioPackFormatID=pack, audioPackFormatName=f"{name} Bed", typeLabel="0001", typeDefinition="DirectSpeakers")
        for label in labels:
            _add(thing, "audioTrackUIDRef", f"ATU_{k + 1:08d}")
            _add(packed, "audioChannelFormatIDRef", f"AC_0001{FIRST_ID + k:04X}")
            numbered.append((k, b, label))
            k += 1
    for k, _, label in numbered:
        name, speaker = CHANNEL_NAMES[label]
        channel = _add(root, "audioChannelFormat", audioChannelFormatID=f"AC_0001{FIRST_ID + k:04X}", audioChannelFormatName=name, typeLabel="0001", typeDefinition="DirectSpeakers")
        block = _add(channel, "audioBlockFormat", audioBlockFormatID=f"AB_0001{FIRST_ID + k:04X}_00000001")
        _add(block, "cartesian", "1")
        for axis, v in zip("XYZ", _PLACE[label], strict=True):
            _add(block, "position", coordinate(v), coordinate=axis)
        _add(block, "speakerLabel", speaker)
    for k, b, label in numbered:
        stream = _add(root, "audioStreamFormat", audioStreamFormatID=f"AS_0001{FIRST_ID + k:04X}", audioStreamFormatName=f"PCM_{CHANNEL_NAMES[label][0]}", formatLabel="0001", formatDefinition="PCM")
        _add(stream, "audioChannelFormatIDRef", f"AC_0001{FIRST_ID + k:04X}")
        _add(stream, "audioPackFormatIDRef", f"AP_0001{FIRST_ID + b:04X}")
        _add(stream, "audioTrackFormatIDRef", f"AT_0001{FIRST_ID + k:04X}_01")
    for k, _, label in numbered:
        track = _add(root, "audioTrackFormat", audioTrackFormatID=f"AT_0001{FIRST_ID + k:04X}_01", audioTrackFormatName=f"PCM_{CHANNEL_NAMES[label][0]}", formatLabel="0001", formatDefinition="PCM")
        _add(track, "audioStreamFormatIDRef", f"AS_0001{FIRST_ID + k:04X}")
    for k, b, _ in numbered:
        uid = _add(root, "audioTrackUID", UID=f"ATU_{k + 1:08d}", sampleRate=str(rate), bitDepth=str(bits))
        _add(uid, "audioTrackFormatIDRef", f"AT_0001{FIRST_ID + k:04X}_01")
        _add(uid, "audioPackFormatIDRef", f"AP_0001{FIRST_ID + b:04X}")
    ET.indent(root)
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="utf-8")


def bed_file(x: np.ndarray, beds: list[tuple[str, list[str]]], rate: int, bits: int = 24, lkfs: float | None = None, dbtp: float | None = None) -> bytes:
    """IO5, IO6: samples of all beds' tracks side by side, with their metadata."""
    labels = [label for _, own in beds for label in own]
    if len(beds) > MOST_BEDS or len(labels) > MOST_TRACKS or x.shape[1] != len(labels):
        raise WavError("at most 64 beds and 128 tracks, each with its samples")
    axml = axml_body(beds, len(x) / rate, rate, bits)
    extra = ((b"bext", bext_body(lkfs, dbtp)), (b"axml", axml), (b"chna", chna_body([own for _, own in beds])), (b"dbmd", struct.pack("<IHH", 1, 1, 0)))
    return wav_bytes(x, rate, bits, extra)


def package_beds(signal: DataFrame, layout: str, rate: int, bits: int = 24) -> DataFrame:
    """``(asset, wav)``: one bed of ``layout`` per asset; channels that differ in length or are missing are an error."""
    order = OUTPUT_LAYOUTS[layout].split()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="n", columns="channel", values="x").sort_index()
        if any(c not in wide for c in order) or wide[order].isna().any(axis=None):
            raise WavError("each channel of the layout needs the same samples")
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "wav": [bed_file(wide[order].to_numpy(), [(layout, order)], rate, bits)]})

    return signal.select("asset", "channel", "n", "x").groupBy("asset").applyInPandas(build, "asset string, wav binary")


def package_stems(stems: DataFrame, routing: dict[str, dict[str, float]], rate: int, bits: int = 24) -> DataFrame:
    """IO6: a bed per stem of ``stems(asset, stem, n, l, r)``: gains applied, shorter ones padded, all in one file per asset."""
    left = {"FL", "SL", "BL", "TFL", "TBL"}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        beds, tracks, length = [], [], int(pdf["n"].max()) + 1
        for stem, own in pdf.groupby("stem", sort=True):
            own = own.sort_values("n")
            gains = routing.get(stem, {})
            if not gains:
                continue
            beds.append((stem, list(gains)))
            for label, g in gains.items():
                v = (own["l"] + own["r"]) / 2 if label in ("C", "LFE") else own["l"] if label in left else own["r"]
                out = np.zeros(length)
                out[own["n"].to_numpy()] = np.clip(g * v.to_numpy(), -1, 1)
                tracks.append(out)
        if not beds:
            raise WavError("no stem has a route")
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "wav": [bed_file(np.stack(tracks, 1), beds, rate, bits)]})

    return stems.select("asset", "stem", "n", "l", "r").groupBy("asset").applyInPandas(build, "asset string, wav binary")
