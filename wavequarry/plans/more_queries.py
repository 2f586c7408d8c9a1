"""Spectral routing, stem plans, listings, medians and streams as queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.operators import derive, frames, scalar, stem_router, upmix, windows
from wavequarry.plans import batch, manifest, models, stems
from wavequarry.queries import query
from wavequarry.signal import PAIR_SQL, SIG_SQL, event_signal, stereo_pair, table
from wavequarry.sources import wav


def _sig(body: str) -> str:
    return f"WITH {SIG_SQL} {body}"


def _r(c, name, k=6):
    return F.round(c, k).alias(name)


# ---- spectra: a frame of 64 samples is one row of embeddings ----

_DFT_SQL = ("WITH s AS (SELECT vec_id, unnest(generate_series(0, 63)) AS n, unnest(embedding)::DOUBLE AS v FROM embeddings), k AS (SELECT unnest(range(33)) AS bin) "
            "SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(sqrt(pow(sum(v * cos(2 * pi() * bin * n / 64)), 2) + pow(sum(v * sin(2 * pi() * bin * n / 64)), 2)), 5) AS m FROM s CROSS JOIN k GROUP BY 1, 2")


@query("dft_magnitude", _DFT_SQL)
def dft_magnitude(spark, sf_dir):
    """All 33 bins of a frame of 64 samples."""
    return _dft_magnitude(spark, sf_dir, range(33))


@query("dft_magnitude_full", _DFT_SQL)
def dft_magnitude_full(spark, sf_dir):
    """The same, by its older name."""
    return dft_magnitude(spark, sf_dir)


def _dft_magnitude(spark, sf_dir, which):
    """In the JVM: each bin is two folds over the frame."""
    def part(fn, k):
        terms = F.transform("embedding", lambda v, n: v.cast("double") * fn(F.lit(2) * F.pi() * k * n / 64))
        return F.aggregate(terms, F.lit(0e0), lambda a, x: a + x)

    bin_of = lambda k: F.struct(k.alias("bin"), F.round(F.sqrt(F.pow(part(F.cos, k), F.lit(2)) + F.pow(part(F.sin, k), F.lit(2))), 5).alias("m"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.inline(F.transform(F.array(*map(F.lit, which)), bin_of)))


_FRAME_PAIR = "fp AS (SELECT a.vec_id // 2 AS frame, a.f AS bin, a.m AS l, b.m AS r FROM spec a JOIN spec b ON a.vec_id + 1 = b.vec_id AND a.f = b.f WHERE a.vec_id % 2 = 0)"
_SPEC = "spec AS (SELECT vec_id, unnest(generate_series(0, 63)) AS f, unnest(embedding)::DOUBLE AS m FROM embeddings)"


def _frame_pairs(spark, sf_dir):
    """JN12: even frames are left, odd ones right."""
    e = table(spark, sf_dir, "embeddings")
    side = lambda k, name: e.where(F.col("vec_id") % 2 == k).select(F.floor(F.col("vec_id") / 2).alias("frame"), F.posexplode("embedding").alias("bin", name)).withColumn(name, F.col(name).cast("double"))
    return side(0, "l").join(side(1, "r"), ["frame", "bin"])


@query("frame_pairs", f"WITH {_SPEC}, {_FRAME_PAIR} SELECT frame, bin, round(l, 6) AS l, round(r, 6) AS r FROM fp")
def frame_pairs(spark, sf_dir):
    return _frame_pairs(spark, sf_dir).select("frame", "bin", _r(F.col("l"), "l"), _r(F.col("r"), "r"))


@query("mid_side_center", f"WITH {_SPEC}, {_FRAME_PAIR}, w AS (SELECT *, greatest(0e0, least(1e0, l * r / (sqrt(l * l * r * r) + 1e-12))) * (1 - abs((abs(l) - abs(r)) / (abs(l) + abs(r) + 1e-12))) AS w FROM fp) "
       "SELECT frame, bin, round(85e-2 * w * (l + r) / 2, 6) AS center, round(l * (1 - 25e-2 * w), 6) AS front_l, round(r * (1 - 25e-2 * w), 6) AS front_r, round((l - r) / 2, 6) AS ambient FROM w")
def mid_side_center(spark, sf_dir):
    """One frame's decomposition into centre, front and ambience."""
    l, r = F.col("l"), F.col("r")
    direct = F.greatest(F.lit(0e0), F.least(F.lit(1e0), l * r / (F.sqrt(l * l * r * r) + 1e-12)))
    w = direct * (1 - F.abs((F.abs(l) - F.abs(r)) / (F.abs(l) + F.abs(r) + 1e-12)))
    return _frame_pairs(spark, sf_dir).withColumn("w", w).select(
        "frame", "bin", _r(0.85 * F.col("w") * (l + r) / 2, "center"), _r(l * (1 - 0.25 * F.col("w")), "front_l"), _r(r * (1 - 0.25 * F.col("w")), "front_r"), _r((l - r) / 2, "ambient"))


_ROUTE_SQL = """WITH e AS (SELECT vec_id, unnest(generate_series(0, 31)) AS bin, unnest(embedding[1:32])::DOUBLE AS re, unnest(embedding[33:64])::DOUBLE AS im FROM embeddings),
p AS (SELECT a.vec_id // 2 AS frame, a.bin, a.bin * 125e0 AS f, a.re AS lr, a.im AS li, b.re AS rr, b.im AS ri, sqrt(a.re * a.re + a.im * a.im) AS ml, sqrt(b.re * b.re + b.im * b.im) AS mr
      FROM e a JOIN e b ON a.vec_id + 1 = b.vec_id AND a.bin = b.bin WHERE a.vec_id % 2 = 0),
q AS (SELECT *, greatest(0e0, least(1e0, (lr * rr + li * ri) / (ml * mr + 1e-12))) AS direct, ml / (ml + mr + 1e-12) AS transient, mr / (ml + mr + 1e-12) AS harmonic FROM p),
g AS (SELECT *, direct * direct AS gamma FROM q),
m AS (SELECT *, 1 / (1 + exp(-(f - 250e0) / 625e-1)) AS bass, 1 / (1 + exp(-(f - 4000e0) / 1000e0)) AS air, 1 / sqrt(1 + pow(f / 120e0, 8e0)) AS low,
      (15e-2 + 85e-2 / (1 + exp(-(f - 150e0) / 375e-1))) * (1 + 5e-1 / (1 + exp(-(f - 3000e0) / 500e0))) AS elevation, 1 - abs((ml - mr) / (ml + mr + 1e-10)) AS near FROM g)"""
_ROUTE_OUT = "SELECT frame, CAST(bin AS INTEGER) AS bin, unnest(['FL', 'FR', 'C', 'LFE', 'BL', 'BR', 'SL', 'SR', 'TFL', 'TFR', 'TBL', 'TBR']) AS channel, unnest([{re}]) AS re, unnest([{im}]) AS im FROM {table}"


def _route_columns(weight: str, wide: str, front_height: bool) -> str:
    """Both parts of the twelve channels, from the masks' names."""
    def part(l, r):
        side = f"({l} - {r}) / 2"
        rows = [f"{l} * (1 - {weight} / 4)", f"{r} * (1 - {weight} / 4)", f"85e-2 * 85e-2 * {weight} * ({l} + {r}) / 2", f"31622776601683794e-17 * low * ({l} + {r}) / 2",
                f"55e-2 * {wide} * {side}", f"-55e-2 * {wide} * {side}", f"6e-1 * {wide} * {side}", f"-6e-1 * {wide} * {side}"]
        rows += [f"55e-2 * elevation * {l}", f"55e-2 * elevation * {r}"] if front_height else [f"55e-2 * air * elevation * {wide} * {side}", f"-55e-2 * air * elevation * {wide} * {side}"]
        rows += [f"55e-2 * elevation * {wide} * {side}", f"-55e-2 * elevation * {wide} * {side}"]
        return ", ".join(f"round({x}, 6)" for x in rows)

    return _ROUTE_OUT.format(re=part("lr", "rr"), im=part("li", "ri"), table="w")


def _routed_frames(spark, sf_dir, whole):
    """A row of ``embeddings`` is a spectrum of 32 bins, real parts first; even ones are left, odd ones right."""
    c, e = F.col, table(spark, sf_dir, "embeddings")
    parts = F.arrays_zip(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    side = lambda k, a, b: e.where(c("vec_id") % 2 == k).select(F.floor(c("vec_id") / 2).alias("frame"), F.posexplode(parts).alias("bin", "z")).select("frame", "bin", c("z")["0"].cast("double").alias(a), c("z")["1"].cast("double").alias(b))
    both = side(0, "lr", "li").join(side(1, "rr", "ri"), ["frame", "bin"])
    ml, mr = F.sqrt(c("lr") * c("lr") + c("li") * c("li")), F.sqrt(c("rr") * c("rr") + c("ri") * c("ri"))
    direct = F.greatest(F.lit(0e0), F.least(F.lit(1e0), (c("lr") * c("rr") + c("li") * c("ri")) / (ml * mr + 1e-12)))
    spectra = both.select(F.lit("frames").alias("asset"), "*", direct.alias("direct"), (direct * direct).alias("gamma"), (ml / (ml + mr + 1e-12)).alias("transient"), (mr / (ml + mr + 1e-12)).alias("harmonic"))
    return upmix.route_spectra(spectra, "7.1.4", 125.0, whole=whole).select("frame", "bin", "channel", _r(c("re"), "re"), _r(c("im"), "im"))


@query("frame_route", f"{_ROUTE_SQL}, w AS (SELECT *, direct * near AS weight, bass * (1 - gamma) * (1 - harmonic) * (15e-2 + 85e-2 * (1 - transient)) AS wide FROM m) {_route_columns('weight', 'wide', False)}")
def frame_route(spark, sf_dir):
    """Complex spectra of all frames to twelve channels."""
    return _routed_frames(spark, sf_dir, False)


@query("whole_route", f"{_ROUTE_SQL}, w AS (SELECT *, gamma * near AS weight, bass * (1 - gamma) AS wide FROM m) {_route_columns('weight', 'wide', True)}")
def whole_route(spark, sf_dir):
    """The form for whole signals: the centre by coherence, front heights from the signal itself."""
    return _routed_frames(spark, sf_dir, True)


_MEDIAN_SQL = (
    f"WITH {_SPEC}, w AS (SELECT a.vec_id, a.f, a.m, b.m AS near FROM spec a CROSS JOIN range(-8, 9) t(d) JOIN spec b ON a.vec_id = b.vec_id AND b.f = CASE WHEN a.f + d < 0 THEN -(a.f + d) WHEN a.f + d > 63 THEN 126 - (a.f + d) ELSE a.f + d END) "
    "SELECT vec_id, f AS bin, round(median(near), 6) AS med, round(greatest(0e0, least(1e0, (any_value(m) - median(near)) / (median(near) + 1e-12))), 6) AS mask FROM w GROUP BY 1, 2")


@query("sliding_median", _MEDIAN_SQL)
def sliding_median(spark, sf_dir):
    """W5, R4 for every frame."""
    return _sliding_median(table(spark, sf_dir, "embeddings"))


@query("sliding_median_full", _MEDIAN_SQL)
def sliding_median_full(spark, sf_dir):
    """The same, by its older name."""
    return sliding_median(spark, sf_dir)


def _sliding_median(frames):
    """The median of 17 bins with mirrored edges, folded per row in the JVM."""
    e = frames.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    mirror = lambda i: F.when(i < 0, -i).when(i > 63, 126 - i).otherwise(i)
    med = lambda n: F.element_at(F.array_sort(F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda d: F.element_at(F.col("v"), (mirror(n + d) + 1).cast("int")))), 9)
    each = e.select("vec_id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda n: F.struct(n.alias("bin"), F.element_at(F.col("v"), n + 1).alias("m"), med(n).alias("med")))))
    return each.select("vec_id", "bin", _r(F.col("med"), "med"), _r(F.greatest(F.lit(0e0), F.least(F.lit(1e0), (F.col("m") - F.col("med")) / (F.col("med") + 1e-12))), "mask"))


# ---- coherence and frame energies ----


@query("coherence", f"WITH RECURSIVE {SIG_SQL}, {PAIR_SQL}, f AS (SELECT n, l * r AS lr, l * l AS ll, r * r AS rr FROM pair WHERE n = 0 UNION ALL "
       "SELECT p.n, CASE WHEN p.l * p.r * f.lr / (abs(p.l * p.r) * abs(f.lr) + 1e-10) >= sqrt(greatest(0e0, least(1e0, f.lr * f.lr / (f.ll * f.rr + 1e-10)))) THEN 25e-2 * f.lr + 75e-2 * p.l * p.r ELSE 75e-2 * f.lr + 25e-2 * p.l * p.r END, "
       "6e-1 * f.ll + 4e-1 * p.l * p.l, 6e-1 * f.rr + 4e-1 * p.r * p.r FROM f JOIN pair p ON p.n = f.n + 1) "
       "SELECT n, round(greatest(0e0, least(1e0, lr * lr / (ll * rr + 1e-10))), 6) AS gamma, round(greatest(0e0, least(1e0, lr / (sqrt(ll * rr) + 1e-10))), 6) AS direct FROM f")
def coherence(spark, sf_dir):
    """A pair of samples is a frame of one bin; halves are rounded as in the SQL, after scaling by 10^6."""
    pair = stereo_pair(event_signal(spark, sf_dir)).select(F.lit("a").alias("asset"), F.col("n").alias("frame"), F.array("l").alias("l"), F.array("r").alias("r"))
    return frames.coherence_of(pair).select(F.col("frame").alias("n"), *((F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("gamma", "direct")))


@query("derive_channels", _sig(", e AS (SELECT max(n) AS top FROM sig), f AS (SELECT n, x FROM sig WHERE channel = 'FR'), "
       "t AS (SELECT n + 2 AS n, 27e-2 * x AS x FROM f UNION ALL SELECT n + 5, 33e-2 * x FROM f UNION ALL SELECT 0, 0e0 UNION ALL SELECT 1, 0e0) "
       "SELECT channel, n, round(x, 6) AS x FROM sig UNION ALL SELECT 'SR', n, round(sum(x), 6) FROM t WHERE n <= (SELECT top FROM e) GROUP BY 2"))
def derive_channels(spark, sf_dir):
    """JN8 at 100 samples a second: five channels are there, the right surround is the reflected and delayed front right."""
    sig = event_signal(spark, sf_dir).withColumn("asset", F.lit("events"))
    return derive.derive(sig, "5.1", {"FL", "FR", "C", "LFE", "SL"}, 100).select("channel", "n", _r(F.col("x"), "x"))


_VOICE_SQL = ("stems AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'Vocals' WHEN 1 THEN 'Lead Vocals' WHEN 2 THEN 'Drums' ELSE 'Piano' END || CASE WHEN p_partkey % 3 = 0 THEN '@front' ELSE '' END AS stem FROM part), "
              "base AS (SELECT * FROM (VALUES ('Vocals', 7e-1, 28e-2), ('Lead Vocals', 8e-1, 2e-1), ('Drums', 2e-1, 55e-2), ('Piano', 18e-2, 55e-2)) t(name, c, f))")


@query("center_redirect", f"WITH {_VOICE_SQL} SELECT * FROM (SELECT stem, unnest(['FL', 'FR', 'LFE', 'SL', 'SR']) AS channel, unnest([round(g, 6), round(g, 6), CASE WHEN name = 'Drums' THEN 32e-2 END, "
       "CASE name WHEN 'Drums' THEN 72e-3 WHEN 'Piano' THEN 132e-3 END, CASE name WHEN 'Drums' THEN 72e-3 WHEN 'Piano' THEN 132e-3 END]) AS gain "
       "FROM (SELECT stem, name, f + CASE WHEN name LIKE '%Vocals' THEN c / 2 ELSE 0e0 END AS g FROM stems JOIN base ON name = split_part(stem, '@', 1)) q) z WHERE gain IS NOT NULL")
def center_redirect(spark, sf_dir):
    """JN4: the centre is passed through; half of what a voice would send there goes to each front channel, and of what others would nothing."""
    c = F.col
    name = F.when(c("p_size") % 4 == 0, "Vocals").when(c("p_size") % 4 == 1, "Lead Vocals").when(c("p_size") % 4 == 2, "Drums").otherwise("Piano")
    keys = table(spark, sf_dir, "part").select(F.concat(name, F.when(c("p_partkey") % 3 == 0, "@front").otherwise("")).alias("stem")).distinct()
    return stem_router.gains(stem_router.effective(keys), "5.1", skip=("C",)).select("stem", "channel", _r(c("gain"), "gain"))


@query("envelope_by_class", _sig("SELECT channel, n, round(x * CASE WHEN channel IN ('FL', 'FR', 'C') THEN 1 + n % 10 / 1e2 WHEN channel = 'SL' THEN (1 - n % 10 / 1e2) * (1 + 4125e-4 * (n % 3) / 1e1) ELSE 1e0 END, 12) AS y FROM sig"))
def envelope_by_class(spark, sf_dir):
    """JN7: an envelope per channel class, with a control for every sample."""
    step = F.col("n") % 10 / 100e0
    sig = event_signal(spark, sf_dir).withColumn("asset", F.lit("events"))
    controls = sig.select("asset", "n").distinct().select("asset", F.col("n").alias("k"), (1 + step).alias("front"), (1 - step).alias("surround"), F.lit(1e0).alias("back"), F.lit(1e0).alias("height"), (F.col("n") % 3 / 10e0).alias("detail"))
    return derive.under_envelope(sig, controls, 1).select("channel", "n", _r(F.col("x"), "y", 12))


@query("latency_trim", _sig(", z AS (SELECT channel, count(*) AS len FROM sig GROUP BY 1) SELECT z.channel, t.n, round(coalesce(s.x, 0e0), 6) AS x FROM z, LATERAL (SELECT unnest(range(len)) AS n) t LEFT JOIN sig s ON s.channel = z.channel AND s.n = t.n + 3"))
def latency_trim(spark, sf_dir):
    """The head goes, and the end is padded to the old length."""
    return windows.trim_head(event_signal(spark, sf_dir), 3).select("channel", "n", _r(F.col("x"), "x"))


_BANDS_SQL = "e AS (SELECT i, 20 * pow(200e0, i / 8e0) AS hz FROM range(9) t(i)), b AS (SELECT a.i AS band, a.hz AS lo, z.hz AS hi FROM e a JOIN e z ON z.i = a.i + 1)"


@query("log_bands", f"WITH {_SPEC}, {_BANDS_SQL} SELECT vec_id, CAST(band AS INTEGER) AS band, CAST(min(f) AS INTEGER) AS first, CAST(max(f) AS INTEGER) AS last, round(sum(m * m), 6) AS energy FROM spec JOIN b ON f * 4000e0 / 63 >= lo AND f * 4000e0 / 63 < hi GROUP BY 1, 2")
def log_bands(spark, sf_dir):
    """Each frame's energy in eight bands; a bin's band is looked up, so nothing is compared with a range."""
    ranges, _ = frames.bands_of(8000.0, 64, 8)
    bands = spark.createDataFrame([(k, band) for band, (a, b) in enumerate(ranges) for k in range(a, b)], "bin int, band int")
    bins = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "m")).withColumn("m", F.col("m").cast("double"))
    return bins.join(F.broadcast(bands), "bin").groupBy("vec_id", "band").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), _r(F.sum(F.col("m") * F.col("m")), "energy"))  # 64 bins


@query("sampled_windows", _sig(", z AS (SELECT channel, count(*) AS len FROM sig GROUP BY 1) SELECT channel, n FROM sig JOIN z USING (channel) "
                               "WHERE len <= 60 OR n < 20 OR (n >= (len - 20) // 2 AND n < (len - 20) // 2 + 20) OR n >= len - 20"))
def sampled_windows(spark, sf_dir):
    """All of a short signal, else three windows evenly apart."""
    return windows.three_windows(event_signal(spark, sf_dir), ["channel"], 60).select("channel", "n")


@query("gain_reduction", _sig(", g AS (SELECT channel, CASE WHEN x * 40 - 40 > -18 THEN (1 / 2e0 - 1) * (x * 40 - 22) ELSE 0e0 END AS g FROM sig) SELECT channel, round(max(abs(g)), 6) AS peak, round(avg(abs(g)), 6) AS mean FROM g GROUP BY 1"))
def gain_reduction(spark, sf_dir):
    g = scalar.compressor_gain(F.col("x") * 40 - 40, -18, 2.0, 0)
    return event_signal(spark, sf_dir).groupBy("channel").agg(_r(F.max(F.abs(g)), "peak"), _r(F.avg(F.abs(g)), "mean"))


@query("in_spans", _sig(", sp AS (SELECT channel, unnest(generate_series(0, 900, 300)) AS s FROM (SELECT DISTINCT channel FROM sig) q) SELECT sig.channel, n, CAST(s AS BIGINT) AS s FROM sig JOIN sp ON sig.channel = sp.channel AND n >= s AND n < s + 70"))
def in_spans(spark, sf_dir):
    """JN10."""
    sig = event_signal(spark, sf_dir)
    spans = sig.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(900).cast("bigint"), F.lit(300).cast("bigint"))).alias("s")).withColumn("e", F.col("s") + 70)
    return windows.in_spans(sig, spans).select("channel", "n", "s")


# ---- plans ----

_TASKS_SQL = """WITH r AS (SELECT p_partkey, p_size % 2 = 0 AS crowd, p_size % 3 = 0 AS drums, p_size % 5 = 0 AS voices FROM part)
SELECT p_partkey, unnest(list_filter([CASE WHEN crowd THEN 'crowd' END, 'primary', CASE WHEN drums THEN 'drums' END, CASE WHEN voices THEN 'voices' END], lambda x: x IS NOT NULL)) AS task,
  substr(sha256(array_to_string(list_sort(list_filter(['Vocals', 'Bass', CASE WHEN drums THEN 'Kick' ELSE 'Drums' END, CASE WHEN crowd THEN 'Crowd' END, CASE WHEN voices THEN 'Backing Vocals' END], lambda x: x IS NOT NULL)), '|')), 1, 20) AS hash FROM r"""


@query("stem_plan_tasks", _TASKS_SQL)
def stem_plan_tasks(spark, sf_dir):
    """Tasks in stage order, and a hash of the sorted stems they leave; each of the eight kinds of request is planned once."""
    asked = lambda crowd, drums, voices: ["vocals", "Bass", "drums"] + ["crowd"] * crowd + ["kick"] * drums + ["backing-vocals"] * voices
    kinds = [(c, d, v) for c in (False, True) for d in (False, True) for v in (False, True)]
    rows = [(*k, [t.name for t in stems.plan(asked(*k))], stems.stems_hash(asked(*k))) for k in kinds]
    plans = spark.createDataFrame(rows, "crowd boolean, drums boolean, voices boolean, tasks array<string>, hash string")
    crowd, drums, voices = (F.col("p_size") % k == 0 for k in (2, 3, 5))
    asks = table(spark, sf_dir, "part").select("p_partkey", crowd.alias("crowd"), drums.alias("drums"), voices.alias("voices"))
    return asks.join(F.broadcast(plans), ["crowd", "drums", "voices"]).select("p_partkey", F.explode("tasks").alias("task"), "hash")


@query("block_flatten", "SELECT n_nationkey, 'region' AS bucket, k AS field, v AS value FROM (SELECT n_nationkey, unnest(['nationkey', 'name']) AS k, unnest([CAST(n_nationkey AS VARCHAR), n_name]) AS v FROM nation) q WHERE k <> 'nationkey' OR n_nationkey > 3")
def block_flatten(spark, sf_dir):
    """Fields of a document that the registry knows, in its bucket; empty ones and unknown ones are left out."""
    registry = spark.createDataFrame([("nationkey", "region"), ("name", "region")], "field string, bucket string")
    value = F.when(F.col("n_nationkey") > 3, F.col("n_nationkey").cast("string"))
    doc = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.create_map(F.lit("nationkey"), value, F.lit("name"), F.col("n_name"), F.lit("other"), F.lit("x"))).alias("field", "value"))
    return doc.where("value IS NOT NULL").join(F.broadcast(registry), "field").select("n_nationkey", "bucket", "field", "value")


@query("config_precedence", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'cli' WHEN o_custkey % 3 = 0 THEN 'asset' WHEN o_orderstatus = 'F' THEN 'global' ELSE 'default' END AS v FROM orders")
def config_precedence(spark, sf_dir):
    """C16."""
    pick = F.coalesce(F.when(F.col("o_orderkey") % 4 == 0, "cli"), F.when(F.col("o_custkey") % 3 == 0, "asset"), F.when(F.col("o_orderstatus") == "F", "global"), F.lit("default"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pick.alias("v"))


@query("key_value_pairs", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'type', event_type FROM events")
def key_value_pairs(spark, sf_dir):
    """``K=V,K=V`` parsed to rows."""
    @F.pandas_udf("map<string,string>")
    def parse(text: pd.Series) -> pd.Series:
        return text.map(manifest.key_values)

    text = F.concat(F.lit("k="), F.get_json_object("props", "$.k"), F.lit(",type="), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(parse(text)).alias("key", "value"))


@query("inference_batch", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 2 WHEN p_size >= 12 THEN 4 WHEN p_size >= 8 THEN 2 ELSE 1 END AS batch FROM part")
def inference_batch(spark, sf_dir):
    """By backend and free memory."""
    backend = F.element_at(F.array(F.lit("cpu"), F.lit("mps"), F.lit("cuda")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", models.automatic_batch(backend, F.col("p_size")).alias("batch"))


@query("listing_dedupe", "SELECT DISTINCT 'dir/' || p_brand || '.wav' AS path FROM part WHERE p_type NOT LIKE 'STANDARD%'")
def listing_dedupe(spark, sf_dir):
    """Distinct paths of the wanted suffix."""
    ext = F.when(F.col("p_type").startswith("STANDARD"), ".txt").otherwise(".wav")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("dir/"), "p_brand", ext).alias("path"))
    return batch.relative_listing(files, "dir").select("path")


@query("layout_algebra", f"WITH {catalog.layouts_sql()}, s AS (SELECT layout, list_sort(list(label)) AS l FROM layouts WHERE direction = 'out' GROUP BY 1), "
       "p AS (SELECT p_partkey, list_extract(['5.1', '7.1', '5.1.2', '5.1.4', '7.1.2', '7.1.4'], p_partkey % 6 + 1) AS a, list_extract(['5.1', '7.1', '5.1.2', '5.1.4', '7.1.2', '7.1.4'], p_size % 6 + 1) AS b FROM part) "
       "SELECT p_partkey, p.a, p.b, array_to_string(list_sort(list_intersect(x.l, y.l)), ' ') AS both, array_to_string(list_sort(list_filter(x.l, lambda e: NOT list_contains(y.l, e))), ' ') AS only_a FROM p JOIN s x ON x.layout = p.a JOIN s y ON y.layout = p.b")
def layout_algebra(spark, sf_dir):
    """K5: what two layouts of a part share, and what the first has alone."""
    names = F.array(*map(F.lit, ("5.1", "7.1", "5.1.2", "5.1.4", "7.1.2", "7.1.4")))
    pick = lambda c: F.element_at(names, (F.col(c) % 6 + 1).cast("int"))
    s = catalog.layouts(spark).where("direction = 'out'").groupBy("layout").agg(F.collect_list("label").alias("l"))
    side = lambda name, l: F.broadcast(s.select(F.col("layout").alias(name), F.col("l").alias(l)))  # noqa: E731  six layouts
    pairs = table(spark, sf_dir, "part").select("p_partkey", pick("p_partkey").alias("a"), pick("p_size").alias("b")).join(side("a", "la"), "a").join(side("b", "lb"), "b")
    text = lambda x: F.array_join(F.array_sort(x), " ")
    return pairs.select("p_partkey", "a", "b", text(F.array_intersect("la", "lb")).alias("both"), text(F.array_except("la", "lb")).alias("only_a"))


@query("chunk_sizes", "SELECT p_partkey, CAST(8 + length(p_name) + length(p_name) % 2 AS BIGINT) AS size FROM part")
def chunk_sizes(spark, sf_dir):
    """IO11: header, body and padding to an even length, of the chunk itself."""
    @F.pandas_udf("bigint")
    def size(body: pd.Series) -> pd.Series:
        return body.map(lambda b: len(wav.chunk(b"axml", b.encode())))

    return table(spark, sf_dir, "part").select("p_partkey", size("p_name").alias("size"))


@query("tumbling_energy", "SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, CAST(count(*) AS BIGINT) AS c, round(sum(value * value), 4) AS energy FROM events GROUP BY 1, 2")
def tumbling_energy(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("c"), F.round(F.sum(F.col("value") * F.col("value")), 4).alias("energy"))
    return w.select("event_type", F.col("w.start").alias("start"), "c", "energy")


@query("energy_rollup", _sig("SELECT coalesce(channel, 'all') AS channel, coalesce(n // 100, -1) AS part, round(sum(x * x), 4) AS energy FROM sig GROUP BY ROLLUP (channel, n // 100)"))
def energy_rollup(spark, sf_dir):
    x = F.col("x")
    r = event_signal(spark, sf_dir).withColumn("part", F.expr("n div 100")).rollup("channel", "part").agg(F.round(F.sum(x * x), 4).alias("energy"))
    return r.select(F.coalesce("channel", F.lit("all")).alias("channel"), F.coalesce("part", F.lit(-1)).cast("bigint").alias("part"), "energy")
