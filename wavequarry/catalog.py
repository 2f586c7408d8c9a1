"""Fixed layouts, channels and profiles as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Channel orders of the layouts, as written and as read.
OUTPUT_LAYOUTS = {
    "5.1": "FL FR C LFE SL SR",
    "7.1": "FL FR C LFE SL SR BL BR",
    "5.1.2": "FL FR C LFE SL SR TFL TFR",
    "5.1.4": "FL FR C LFE SL SR TFL TFR TBL TBR",
    "7.1.2": "FL FR C LFE SL SR BL BR TFL TFR",
    "7.1.4": "FL FR C LFE BL BR SL SR TFL TFR TBL TBR",
}
INPUT_LAYOUTS = {
    "mono": "C",
    "stereo": "FL FR",
    "5.0": "FL FR C SL SR",
    "5.1": "FL FR C LFE SL SR",
    "7.1": "FL FR C LFE BL BR SL SR",
    "5.1.2": "FL FR C LFE SL SR TFL TFR",
    "5.1.4": "FL FR C LFE SL SR TFL TFR TBL TBR",
    "7.1.2": "FL FR C LFE BL BR SL SR TFL TFR",
}
# The layout that a number of channels is taken for.
DETECTED = {1: "mono", 2: "stereo", 5: "5.0", 6: "5.1", 8: "7.1", 10: "7.1.2"}
SYSTEM_CODES = {"5.1": "B", "5.1.2": "C", "5.1.4": "D", "7.1": "I", "7.1.4": "J"}
# Label, class, and where the speaker stands.
LABELS = (
    ("FL", "front", -1.0, 1.0, 0.0), ("FR", "front", 1.0, 1.0, 0.0), ("C", "center", 0.0, 1.0, 0.0), ("LFE", "lfe", -1.0, 1.0, -1.0),
    ("SL", "surround", -1.0, 0.0, 0.0), ("SR", "surround", 1.0, 0.0, 0.0), ("BL", "surround", -1.0, -1.0, 0.0), ("BR", "surround", 1.0, -1.0, 0.0),
    ("TFL", "height", -1.0, 0.0, 1.0), ("TFR", "height", 1.0, 0.0, 1.0), ("TBL", "height", -1.0, -1.0, 1.0), ("TBR", "height", 1.0, -1.0, 1.0),
)
# Threshold dB, ratio, attack ms, release ms, knee dB, makeup dB.
COMPRESSOR_PROFILES = {"transparent": (-22.0, 1.5, 30.0, 300.0, 9.0, 0.0), "glue": (-18.0, 2.0, 20.0, 200.0, 6.0, 0.0), "warm": (-15.0, 2.0, 40.0, 400.0, 12.0, 0.0)}
# Gain in dB by stem.
REBALANCE_PROFILES = {
    "vocal-forward": {"Vocals": 2.5, "Lead Vocals": 2.5, "Drums": -1.0, "Other": -0.5},
    "instrumental": {"Vocals": -3.0, "Lead Vocals": -3.0, "Drums": 1.0, "Bass": 1.0},
    "bass-heavy": {"Bass": 2.0, "Drums": 1.0, "Vocals": -0.5},
    "balanced": {},
}

# Breakpoints (Hz, dB) of the bus EQ and of the stem EQ.
EQ_PROFILES = {
    "spatial-transparent": [(20, 0.0), (20000, 0.0)],
    "spatial-air": [(20, 0.0), (1000, 0.0), (5000, 0.5), (10000, 1.5), (15000, 2.5), (20000, 2.5)],
    "spatial-warm": [(20, 0.0), (100, 1.0), (300, 1.5), (1000, 0.5), (3000, -0.5), (8000, 0.0), (20000, 0.0)],
    "spatial-present": [(20, 0.0), (500, 0.0), (2000, 1.0), (4000, 2.0), (6000, 1.5), (10000, 1.0), (20000, 1.5)],
    "atmos-streaming": [(20, 0.0), (60, 1.0), (100, 0.8), (500, 0.0), (2000, 0.5), (5000, 1.0), (12000, 1.5), (18000, 2.0), (20000, 2.0)],
}
STEM_EQ_PROFILES = {
    "vocal-presence": [(20, 0.0), (800, 0.0), (2000, 0.5), (4000, 2.0), (6000, 1.5), (10000, 1.0), (20000, 1.5)],
    "vocal-warmth": [(20, 0.0), (200, 1.5), (500, 0.8), (2000, 0.0), (4000, -0.5), (8000, 0.0), (20000, 0.0)],
    "bass-warmth": [(20, 0.0), (50, 1.5), (100, 1.0), (200, 0.5), (500, 0.0), (20000, 0.0)],
    "bass-cut": [(20, -2.0), (60, -1.0), (120, 0.0), (400, 0.0), (20000, 0.0)],
    "drums-punch": [(20, 0.0), (80, 1.5), (200, 0.0), (3000, 0.0), (5000, 1.5), (8000, 1.0), (20000, 0.0)],
    "other-air": [(20, 0.0), (1000, 0.0), (8000, 0.5), (14000, 1.5), (20000, 2.0)],
    "flat": [(20, 0.0), (20000, 0.0)],
}

def layouts(spark: SparkSession) -> DataFrame:
    """``(direction, layout, ord, label)``."""
    rows = [(d, name, k, label) for d, all_ in (("out", OUTPUT_LAYOUTS), ("in", INPUT_LAYOUTS)) for name, labels in all_.items() for k, label in enumerate(labels.split())]
    return spark.createDataFrame(rows, "direction string, layout string, ord int, label string")


def labels(spark: SparkSession) -> DataFrame:
    """``(label, class, px, py, pz)``."""
    return spark.createDataFrame(list(LABELS), "label string, class string, px double, py double, pz double")


def layouts_sql() -> str:
    rows = ", ".join(f"('{d}', '{n}', {k}, '{x}')" for d, a in (("out", OUTPUT_LAYOUTS), ("in", INPUT_LAYOUTS)) for n, ls in a.items() for k, x in enumerate(ls.split()))
    return f"layouts AS (SELECT * FROM (VALUES {rows}) t(direction, layout, ord, label))"


def labels_sql() -> str:
    rows = ", ".join(f"('{n}', '{c}', {x}e0, {y}e0, {z}e0)" for n, c, x, y, z in LABELS)
    return f"labels_ AS (SELECT * FROM (VALUES {rows}) t(label, class, px, py, pz))"
