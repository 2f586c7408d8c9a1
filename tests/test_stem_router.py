"""The stem router against plain code over whole stems."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavequarry.catalog import OUTPUT_LAYOUTS
from wavequarry.functions import dsp
from wavequarry.operators import stem_router as sr
from wavequarry.operators.upmix import Routing

RATE = 8000
ZONES = {"front": {"Vocals": {"C": 0.72, "FL": 0.28, "FR": 0.28, "TFL": 0.08}, "Kick": {}}, "surround": {"Bass": {"LFE": 0.2}, "Drums": {"SL": 0.5, "SR": 0.5, "TBL": 0.2}}}
CUSTOM = {"Piano": {"C": 0.0, "SL": 0.4}, "Piano@front": {"FL": 0.9}, "Theremin": {"TFL": 0.3}, "Bass@surround": {}, "Bass": {"FL": 0.11}}


def plain_routes(stem):
    name, _, zone = stem.rpartition("@") if "@" in stem else (stem, "", "")
    base = ZONES[zone][name] if name in ZONES.get(zone, {}) else sr.default_routes().get(name)
    return (base or {}) | (CUSTOM.get(stem) or CUSTOM.get(name) or {})


def test_routes_go_by_precedence(spark):
    stems = ["Vocals", "Vocals@front", "Vocals@surround", "Kick", "Kick@front", "Piano", "Piano@front", "Piano@back", "Theremin", "Theremin@x", "Unknown", "Bass@surround", "a@b@front"]
    got = {s: {} for s in stems}
    for r in sr.effective(spark.createDataFrame([(s,) for s in stems * 2], "stem string"), ZONES, None, CUSTOM).collect():
        assert r["name"] == (r["stem"].rpartition("@")[0] or r["stem"]) and r["channel"] not in got[r["stem"]]
        got[r["stem"]][r["channel"]] = r["gain"]
    assert got == {s: plain_routes(s) for s in stems}
    assert got["Kick@front"] == {} and got["Kick"]["LFE"] == 0.85 and got["Piano@front"]["C"] == 0.18


def plain(stems, layout, r, skip=(), features=None):
    n = max(len(x) for x in stems.values())
    out = {c: np.zeros(n) for c in OUTPUT_LAYOUTS[layout].split() if c not in skip}
    bus = np.zeros(n)

    def late(x, ms):
        k = int(RATE * ms / 1000)
        return 0.45 * x + 0.55 * np.concatenate([np.zeros(k), x])[:len(x)]

    def height(x):
        y = x - (1 - r.low_gain) * dsp.sos_filter(dsp.butterworth(1, r.low_hz, RATE), x)[0]
        return y + (r.shelf_gain - 1) * dsp.sos_filter(dsp.butterworth(2, r.shelf_hz, RATE, "high"), y)[0]

    for stem, x in stems.items():
        routes, l, q = plain_routes(stem), x[:, 0], x[:, 1]
        high = lambda v: dsp.sos_filter(dsp.butterworth(2, r.bass_hz, RATE, "high"), v)[0]
        side = {"SL": late(high(l), 31), "SR": late(high(q), 37), "TFL": late(height(l), 23), "TFR": late(height(q), 29), "FL": l, "FR": q, "C": (l + q) / 2}
        side |= {"BL": side["SL"], "BR": side["SR"], "TBL": side["TFL"], "TBR": side["TFR"]}
        items = []
        for c, g in routes.items():
            if c not in out:
                continue
            g *= {"C": r.center, "S": r.surround, "B": r.back, "T": r.height}.get(c if c == "C" else c[0], 1.0)
            if "C" in skip and c in ("FL", "FR") and stem.split("@")[0] in sr.VOICES:
                g += routes.get("C", 0) / 2
            if features and stem in features:
                w, h, b, t = features[stem]
                s = {"LFE": 1 + 0.5 * (b - 0.2), "C": 1 + 0.35 * (0.5 - w)}.get(c)
                if s is None:
                    s = {"T": 1 + 0.5 * (max(0.6 * h + 0.4 * t, 0.5 * w + 0.5 * (1 - t)) - 0.6), "F": 1 + 0.3 * (0.55 * t + 0.45 * (1 - w) - 0.39)}.get(c[0], 1 + 0.55 * (0.6 * w + 0.4 * (1 - t) - 0.58))
                g *= 1 + r.content * (s - 1)
            if c == "LFE":
                bus[:len(x)] += g * (l + q) / 2
            else:
                items.append((c, g))
        sent = sum(g * g * float(side[c] @ side[c]) for c, g in items)
        scale = np.sqrt(float(l @ l + q @ q) / sent) if sent > 1e-20 else 1.0
        for c, g in items:
            out[c][:len(x)] += scale * g * side[c]
    if "LFE" in out:
        out["LFE"] += r.lfe * dsp.sos_filter(dsp.butterworth(r.lfe_order, r.lfe_hz, RATE), bus)[0]
    return out


def test_routing_equals_plain_code(spark):
    rng = np.random.default_rng(0)
    assets = {"a": {"Vocals": rng.standard_normal((900, 2)), "Bass": rng.standard_normal((900, 2)), "Drums@surround": rng.standard_normal((700, 2)), "Piano": rng.standard_normal((900, 2))},
              "b": {"Vocals@front": rng.standard_normal((300, 2)), "Unknown": rng.standard_normal((650, 2)), "Bass@surround": np.zeros((650, 2)), "Crash": rng.standard_normal((650, 2))}}
    rows = pd.concat([pd.DataFrame({"asset": a, "stem": s, "n": np.arange(len(x)), "l": x[:, 0], "r": x[:, 1]}) for a, own in assets.items() for s, x in own.items()])
    stems = spark.createDataFrame(rows).repartition(3)
    shown = {("a", "Vocals"): (0.9, 0.1, 0.2, 0.3), ("a", "Drums@surround"): (0.2, 0.5, 0.4, 0.8), ("b", "Crash"): (0.5, 0.9, 0.0, 0.6)}
    features = spark.createDataFrame([(*k, *v) for k, v in shown.items()], "asset string, stem string, width double, hf double, lf double, transient double")
    r = Routing(shelf_hz=1500.0, content=0.7)
    for layout, skip, with_features, size in (("7.1.4", (), True, 256), ("5.1", ("C", "LFE"), False, 1000), ("5.1.2", ("C",), True, 300)):
        got = sr.route(stems, RATE, layout, r, ZONES, None, CUSTOM, skip, features if with_features else None, size).toPandas()
        for a, own in assets.items():
            want = plain(own, layout, r, skip, {s: v for (x, s), v in shown.items() if x == a} if with_features else None)
            mine = got[got["asset"] == a]
            assert set(mine["channel"]) == set(want)
            for c, x in want.items():
                y = mine[mine["channel"] == c].sort_values("n")["x"].to_numpy()
                assert len(y) == len(x) and np.abs(y - x).max() < 1e-9, (layout, a, c)


def test_constant_power_holds_per_stem(spark):
    energy = spark.createDataFrame([("a", "s", "dry", "L", 3.0), ("a", "s", "dry", "R", 1.0), ("a", "s", "dry", "M", 2.0), ("a", "s", "surround", "L", 0.5), ("a", "t", "dry", "L", 0.0), ("a", "t", "dry", "R", 0.0), ("a", "t", "dry", "M", 0.0)],
                                   "asset string, stem string, kind string, side string, e double")
    sent = spark.createDataFrame([("a", "s", "FL", 0.5), ("a", "s", "C", 0.3), ("a", "s", "SL", 0.4), ("a", "s", "LFE", 0.9), ("a", "t", "FR", 0.7)], "asset string, stem string, channel string, gain double")
    got = {(r["stem"], r["channel"]): r["gain"] for r in sr.constant_power(sent, energy).collect()}
    scale = (4.0 / (0.25 * 3 + 0.09 * 2 + 0.16 * 0.5)) ** 0.5
    assert np.isclose(got["s", "FL"], 0.5 * scale) and np.isclose(got["s", "SL"], 0.4 * scale) and got["s", "LFE"] == 0.9 and got["t", "FR"] == 0.7
    out = sr.constant_power(sent, energy).join(energy, ["asset", "stem", "kind", "side"]).where("channel <> 'LFE' AND stem = 's'").agg(F.sum(F.col("gain") * F.col("gain") * F.col("e"))).first()[0]
    assert np.isclose(out, 4.0)
