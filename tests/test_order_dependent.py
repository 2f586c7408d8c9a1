"""Queries whose recursion picks its coefficient by its own output, against their SQL on samples that sf0.001 doesn't have."""

import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from wavequarry.operators import frames

SIDES = ("click", "view")


def events(tmp_path, left, right):
    """A folder whose ``events`` have these values on both front channels."""
    rows = [(k * 2 + side, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), kind, float(v)) for side, (kind, values) in enumerate(zip(SIDES, (left, right), strict=True)) for k, v in enumerate(values)]
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value"])
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    frame.to_parquet(tmp_path / "events.parquet", index=False)
    return str(tmp_path)


def both(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return sorted(map(tuple, entry.queries()[name](spark, folder).collect())), sorted(con.execute(entry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize(("left", "right"), [
    ((40, 0, 60, 60, 60), (50, 80, 0, 70, 0)),  # either side silent
    ((0, 0, 30, 20), (0, 10, 0, 0)),  # both, at the start
    ((100003, 100003), (100000, 100000)),  # 0.95 + 0.05 * 1.00003 is a half of the sixth digit
])
def test_energy_controller_equals_sql(spark, tmp_path, left, right):
    got, sql = both(spark, events(tmp_path, left, right), "energy_controller")
    assert got == sql and len(sql) == len(left)


def plain(left, right):
    """The SQL's recursion over one bin, a frame at a time."""
    out, state = [], None
    for l, r in zip(left, right, strict=True):
        if state is None:
            lr, ll, rr = l * r, l * l, r * r
        else:
            lr, ll, rr = state
            near = l * r * lr / (abs(l * r) * abs(lr) + 1e-10) >= math.sqrt(max(0.0, min(1.0, lr * lr / (ll * rr + 1e-10))))
            lr = 0.25 * lr + 0.75 * l * r if near else 0.75 * lr + 0.25 * l * r
            ll, rr = 0.6 * ll + 0.4 * l * l, 0.6 * rr + 0.4 * r * r
        state = lr, ll, rr
        out.append((max(0.0, min(1.0, lr * lr / (ll * rr + 1e-10))), max(0.0, min(1.0, lr / (math.sqrt(ll * rr) + 1e-10)))))
    return out


def spectra(spark):
    """Noise of three bins with a long silence; one that ends with a chunk of 16; one that lacks the frames of whole chunks."""
    rng, made = np.random.default_rng(3), {}
    for asset, places in (("a", range(150)), ("b", range(32)), ("c", [*range(20), *range(70, 90)])):
        l, r = rng.standard_normal((2, len(places), 3))
        l[40:110], r[40:110] = 0, 0
        made[asset] = list(places), l, 0.5 * l + r
    rows = [(a, n, l[k].tolist(), r[k].tolist()) for a, (places, l, r) in made.items() for k, n in enumerate(places)]
    return made, spark.createDataFrame(rows, "asset string, frame bigint, l array<double>, r array<double>").repartition(5)


@pytest.mark.parametrize(("warm", "rounds"), [(4, 0), (4, 1), (0, 3), (16, 3)])
def test_coherence_is_the_same_to_the_bit_however_its_chunks_settle(spark, warm, rounds):
    made, pair = spectra(spark)
    got = {(r["asset"], r["frame"], r["bin"]): (r["gamma"], r["direct"]) for r in frames.coherence_of(pair, 16, warm, rounds).collect()}
    want = {(a, n, b): v for a, (places, l, r) in made.items() for b in range(3) for n, v in zip(places, plain(l[:, b].tolist(), r[:, b].tolist()), strict=True)}
    assert got == want


def test_no_task_holds_an_assets_frames(spark):
    plan = frames.coherence_of(spectra(spark)[1])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert exchanges and all("chunk" in line for line in exchanges)


def test_coherence_equals_sql_over_chunks(spark, tmp_path):
    rng = np.random.default_rng(5)
    left, right = rng.integers(-50_000, 50_000, (2, 3 * frames.FRAMES + 2000)) / 100
    left[500:2500] = right[2000:2600] = 0
    got, sql = both(spark, events(tmp_path, left, right), "coherence")
    assert got == sql and len(sql) == len(left)
