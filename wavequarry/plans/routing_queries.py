"""Routing, downmix, loudness and planning queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.functions import dsp
from wavequarry.operators import chunks, loudness, mastering, planning, routing, stem_router
from wavequarry.plans import batch
from wavequarry.plans import stems as stem_plans
from wavequarry.queries import query
from wavequarry.signal import SIG_SQL, event_signal, table

_K = "7071067811865476e-16"


def _sig(body: str) -> str:
    return f"WITH {SIG_SQL} {body}"


def _r(c, name, k=6):
    return F.round(c, k).alias(name)


@query("itu_downmix", _sig(f"SELECT n, round(coalesce(sum(CASE WHEN channel = 'FL' THEN x WHEN channel = 'C' THEN {_K} * x WHEN channel = 'SL' THEN {_K} * x END), 0e0), 6) AS l, "
                           f"round(coalesce(sum(CASE WHEN channel = 'FR' THEN x WHEN channel = 'C' THEN {_K} * x END), 0e0), 6) AS r FROM sig WHERE channel <> 'LFE' GROUP BY 1"))
def itu_downmix(spark, sf_dir):
    return routing.downmix(event_signal(spark, sf_dir)).select("n", _r(F.col("l"), "l"), _r(F.col("r"), "r"))


@query("mono_downmix", _sig(f"SELECT n, round(sum(CASE channel WHEN 'FL' THEN {_K} * x WHEN 'FR' THEN {_K} * x WHEN 'C' THEN x ELSE 5e-1 * x END), 6) AS m FROM sig WHERE channel <> 'LFE' GROUP BY 1"))
def mono_downmix(spark, sf_dir):
    return routing.downmix_mono(event_signal(spark, sf_dir)).select("n", _r(F.col("m"), "m"))


_STEM_SQL = """stem AS (SELECT p_partkey, 'stem' || (p_size % 8) AS stem, 'zone' || (p_partkey % 4) AS zone, p_retailprice / 1000 AS x FROM part),
route AS (SELECT * FROM (VALUES ('default', 'stem0', 'FL', 5e-1), ('default', 'stem0', 'FR', 5e-1), ('default', 'stem1', 'C', 7e-1), ('default', 'stem2', 'SL', 4e-1),
  ('zone0', 'stem0', 'C', 9e-1), ('zone1', 'stem1', 'LFE', 8e-1), ('zone1', 'stem1', 'FL', 3e-1)) t(zone, stem, channel, gain)),
known AS (SELECT * FROM (VALUES ('zone0', 'stem0'), ('zone1', 'stem1'), ('zone2', 'stem2')) t(zone, stem)),
routed AS (SELECT s.p_partkey, s.zone, s.stem, r.channel, r.gain, s.x FROM stem s LEFT JOIN known k ON k.zone = s.zone AND k.stem = s.stem
  JOIN route r ON r.stem = s.stem AND r.zone = CASE WHEN k.zone IS NULL THEN 'default' ELSE s.zone END)"""
# a small example of what a caller passes
_ROUTES = [("default", "stem0", "FL", 0.5), ("default", "stem0", "FR", 0.5), ("default", "stem1", "C", 0.7), ("default", "stem2", "SL", 0.4),
           ("zone0", "stem0", "C", 0.9), ("zone1", "stem1", "LFE", 0.8), ("zone1", "stem1", "FL", 0.3)]


def _routed(spark, sf_dir):
    stems = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("stem"), (F.col("p_size") % 8).cast("string")).alias("stem"),
                                                F.concat(F.lit("zone"), (F.col("p_partkey") % 4).cast("string")).alias("zone"), (F.col("p_retailprice") / 1000).alias("x"))
    routes = spark.createDataFrame(_ROUTES, "zone string, stem string, channel string, gain double")
    known = spark.createDataFrame([("zone0", "stem0"), ("zone1", "stem1"), ("zone2", "stem2")], "zone string, stem string")
    return routing.routes_for(stems, F.broadcast(routes), F.broadcast(known))  # routing tables are small and given


@query("route_fallback", f"WITH {_STEM_SQL} SELECT p_partkey, zone, stem, channel, gain FROM routed")
def route_fallback(spark, sf_dir):
    return _routed(spark, sf_dir).select("p_partkey", "zone", "stem", "channel", "gain")


@query("route_empty_vs_missing", f"WITH {_STEM_SQL} SELECT zone, stem, CAST(count(*) AS BIGINT) AS stems, CAST(count(r.p_partkey) AS BIGINT) AS sends FROM stem s LEFT JOIN (SELECT p_partkey, min(channel) FROM routed GROUP BY 1) r USING (p_partkey) GROUP BY 1, 2")
def route_empty_vs_missing(spark, sf_dir):
    sent = _routed(spark, sf_dir).select("p_partkey").distinct().withColumn("sent", F.lit(1))
    stems = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("stem"), (F.col("p_size") % 8).cast("string")).alias("stem"), F.concat(F.lit("zone"), (F.col("p_partkey") % 4).cast("string")).alias("zone"))
    return stems.join(sent, "p_partkey", "left").groupBy("zone", "stem").agg(F.count("*").alias("stems"), F.count("sent").alias("sends"))


_POWER_SQL = """key AS (SELECT p_size % 3 AS a, list_extract(['Vocals', 'Lead Vocals', 'Bass@surround', 'Kick@front', 'Other@front', 'Crowd', 'Theremin', 'Vocals@front'], p_partkey % 8 + 1) AS stem, p_retailprice / 1000 AS x FROM part),
energy AS (SELECT 'a' || a AS asset, stem, sum(x * x) AS l, sum(25e-2 * x * x) AS r, sum(5625e-4 * x * x) AS m FROM key GROUP BY 1, 2),
base AS (SELECT * FROM (VALUES ('Vocals', 'C', 7e-1), ('Vocals', 'FL', 28e-2), ('Vocals', 'FR', 28e-2), ('Vocals', 'TFL', 12e-2), ('Vocals', 'TFR', 12e-2), ('Lead Vocals', 'C', 8e-1), ('Lead Vocals', 'FL', 2e-1), ('Lead Vocals', 'FR', 2e-1),
  ('Lead Vocals', 'TFL', 8e-2), ('Lead Vocals', 'TFR', 8e-2), ('Bass@surround', 'LFE', 2e-1), ('Other@front', 'FL', 38e-2), ('Other@front', 'SR', 18e-2), ('Crowd', 'SL', 28e-2), ('Crowd', 'SR', 28e-2), ('Crowd', 'TBL', 15e-2), ('Crowd', 'TBR', 15e-2),
  ('Crowd', 'TFL', 6e-2), ('Crowd', 'TFR', 9e-1), ('Theremin', 'TFL', 3e-1), ('Vocals@front', 'C', 72e-2), ('Vocals@front', 'FL', 5e-1)) t(stem, channel, g)),
sent AS (SELECT asset, stem, channel, g * CASE WHEN channel = 'C' THEN 85e-2 WHEN channel IN ('SL', 'SR') THEN 6e-1 WHEN channel LIKE 'T%' THEN 55e-2 ELSE 1e0 END AS g, l + r AS own,
  CASE WHEN channel = 'C' THEN m WHEN channel LIKE '%L' THEN l ELSE r END * CASE WHEN channel LIKE 'S%' THEN 64e-2 WHEN channel LIKE 'T%' THEN 36e-2 ELSE 1e0 END AS e FROM energy JOIN base USING (stem) WHERE channel NOT IN ('TBL', 'TBR')),
scale AS (SELECT asset, stem, sqrt(any_value(own) / sum(g * g * e)) AS s FROM sent WHERE channel <> 'LFE' GROUP BY 1, 2)"""
# what a caller passes: routes by zone (an empty one goes nowhere), and gains over them
_ZONES = {"front": {"Kick": {}, "Other": {"FL": 0.38, "SR": 0.18}, "Vocals": {"C": 0.72, "FL": 0.28}}, "surround": {"Bass": {"LFE": 0.2}}}
_CUSTOM = {"Vocals@front": {"FL": 0.5}, "Crowd": {"TFR": 0.9, "BL": 0.0}, "Theremin": {"TFL": 0.3}, "Other": {}}


@query("route_mix_constant_power", f"WITH {_POWER_SQL} SELECT asset, stem, channel, round(g * CASE WHEN channel = 'LFE' THEN 1e0 ELSE s END, 6) AS gain FROM sent LEFT JOIN scale USING (asset, stem)")
def route_mix_constant_power(spark, sf_dir):
    """JN1, JN3: routes by precedence over 5.1.2; each stem sends out the energy that it has, by the energies of what each channel takes."""
    c, names = F.col, ("Vocals", "Lead Vocals", "Bass@surround", "Kick@front", "Other@front", "Crowd", "Theremin", "Vocals@front")
    stem = F.element_at(F.array(*map(F.lit, names)), (c("p_partkey") % 8 + 1).cast("int"))
    stems = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), (c("p_size") % 3).cast("string")).alias("asset"), stem.alias("stem"), (c("p_retailprice") / 1000).alias("l"))
    # a stem's right is half its left; the sends have 0.8 and 0.6 of its amplitude
    x = {"L": c("l"), "R": c("l") / 2, "M": c("l") * 0.75}
    cases = [("dry", s, x[s]) for s in "LRM"] + [(k, s, x[s] * g) for k, g in (("surround", 0.8), ("height", 0.6)) for s in "LR"]
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("side"), (v * v).alias("e")) for k, s, v in cases))
    energy = stems.select("asset", "stem", F.inline(rows)).groupBy("asset", "stem", "kind", "side").agg(F.sum("e").alias("e"))
    plan = stem_router.gains(stem_router.effective(stems.select("stem"), _ZONES, None, _CUSTOM), "5.1.2")
    powered = stem_router.constant_power(stems.select("asset", "stem").distinct().join(plan, "stem"), energy)
    return powered.select("asset", "stem", "channel", _r(c("gain"), "gain"))


@query("speaker_centroid", f"WITH {catalog.labels_sql()}, g AS (SELECT p_partkey % 50 AS key, label, (p_partkey % 7 + row_number() OVER (PARTITION BY p_partkey ORDER BY label)) / 1e1 AS gain FROM part CROSS JOIN labels_), "
       "s AS (SELECT key, CASE WHEN label = 'C' THEN gain / 2 ELSE gain END AS w, px, py, pz, unnest(CASE WHEN label = 'C' THEN ['left', 'right'] WHEN px < 0 THEN ['left'] ELSE ['right'] END) AS side FROM g JOIN labels_ USING (label) WHERE class <> 'lfe') "
       "SELECT key, side, round(sum(w * px) / sum(w), 6) AS px, round(sum(w * py) / sum(w), 6) AS py, round(sum(w * pz) / sum(w), 6) AS pz FROM s GROUP BY 1, 2")
def speaker_centroid(spark, sf_dir):
    labels = catalog.labels(spark)
    rank = F.row_number().over(W.partitionBy("p_partkey").orderBy("label"))
    gains = table(spark, sf_dir, "part").join(F.broadcast(labels.select("label"))).select((F.col("p_partkey") % 50).alias("key"), "label", ((F.col("p_partkey") % 7 + rank) / 10e0).alias("gain"))
    return routing.centroid(gains, labels).select("key", "side", *(_r(F.col(c), c) for c in ("px", "py", "pz")))


_PHASES = dsp.true_peak_phases()
_DEPTH = _PHASES.shape[1]
_PHASE_SQL = ", ".join("abs(" + " + ".join(f"{h!r}::DOUBLE * t{k}" for k, h in enumerate(row)) + ")" for row in _PHASES.tolist())


def _peak_sql(signal: str) -> str:
    """The greatest interpolated magnitude of each channel, with the eleven samples of silence that flush the filter."""
    return (f"pad AS (SELECT channel, n, x FROM {signal} UNION ALL SELECT channel, top + k, 0e0 FROM (SELECT channel, max(n) AS top FROM {signal} GROUP BY 1) m CROSS JOIN range(1, {_DEPTH}) r(k)), "
            "t AS (SELECT channel, " + ", ".join(f"coalesce(lag(x, {k}) OVER w, 0e0) AS t{k}" for k in range(_DEPTH)) + " FROM pad WINDOW w AS (PARTITION BY channel ORDER BY n)), "
            f"tp AS (SELECT channel, max(greatest({_PHASE_SQL})) AS peak FROM t GROUP BY 1)")


@query("true_peak", _sig(f", {_peak_sql('sig')} SELECT channel, round(20e0 * log10(greatest(peak, 1e-30)), 6) AS dbtp FROM tp"))
def true_peak(spark, sf_dir):
    """By chunks with halos."""
    peaks = chunks.true_peaks(chunks.pack(event_signal(spark, sf_dir)))
    return peaks.select("channel", _r(20e0 * F.log10(F.greatest("peak", F.lit(1e-30))), "dbtp"))


def _gate_sql(signal: str, out: str) -> str:
    """Gated loudness of blocks of 40 at every 10 samples, as one row of ``out``."""
    return (f"{out}_ex AS (SELECT channel, x, unnest(generate_series(greatest(0, (n - 40) // 10 + CASE WHEN n >= 40 THEN 1 ELSE 0 END), n // 10)) AS block FROM {signal}), "
            f"{out}_c AS (SELECT channel, block, CASE WHEN channel = 'SL' THEN 141e-2 ELSE 1e0 END * sum(x * x) / 40 AS ms FROM {out}_ex WHERE channel <> 'LFE' GROUP BY 1, 2 HAVING count(*) = 40), "
            f"{out}_b AS (SELECT block, sum(ms) AS p FROM {out}_c WHERE block < (SELECT min(k) FROM (SELECT count(*) AS k FROM {out}_c GROUP BY channel)) GROUP BY 1), "
            f"{out}_g AS (SELECT p, -691e-3 + 10e0 * log10(greatest(p, 1e-30)) AS lk FROM {out}_b WHERE -691e-3 + 10e0 * log10(greatest(p, 1e-30)) >= -70), "
            f"{out} AS (SELECT coalesce(-691e-3 + 10e0 * log10(greatest(avg(p), 1e-30)), -70e0) AS lkfs FROM {out}_g WHERE lk >= (SELECT -691e-3 + 10e0 * log10(avg(p)) - 10 FROM {out}_g))")


@query("normalize_gain", _sig(f", {_gate_sql('sig', 'pre')}, {_peak_sql('sig')}, "
                              "w AS (SELECT lkfs, least(-8e0 - lkfs, 30e0) AS want, (SELECT 20e0 * log10(max(peak)) FROM tp) AS tp FROM pre), "
                              "gain AS (SELECT *, want - greatest(0e0, tp + want + 1) AS g FROM w), adj AS (SELECT channel, n, x * pow(10e0, g / 20) AS x FROM sig CROSS JOIN gain), "
                              f"{_gate_sql('adj', 'post')} "
                              "SELECT round(gain.lkfs, 6) AS pre_lkfs, round(g, 6) AS gain_db, tp + want > -1 AS tp_limited, round(tp + g, 6) AS dbtp, round(post.lkfs, 6) AS lkfs FROM gain CROSS JOIN post"))
def normalize_gain(spark, sf_dir):
    """The gain to a target loudness, held so that the true peak stays below -1 dB; both are measured again on what comes out."""
    level = lambda rows: loudness.integrated_loudness(rows).select(F.lit("").alias("asset"), "lkfs", "gated_blocks")
    peaks = lambda rows: chunks.true_peaks(rows).groupBy("asset").agg((20e0 * F.log10(F.max("peak"))).alias("dbtp"))
    samples = event_signal(spark, sf_dir)
    gains = mastering.gain_to(level(samples).join(peaks(chunks.pack(samples)), "asset"), -8.0)
    done = samples.join(F.broadcast(gains.select("gain_db"))).select("channel", "n", (F.col("x") * F.pow(F.lit(10.0), F.col("gain_db") / 20)).alias("x"))
    after = level(done).join(peaks(chunks.pack(done)), "asset")
    return gains.join(after, "asset").select(_r(F.col("pre_lkfs"), "pre_lkfs"), _r(F.col("gain_db"), "gain_db"), "tp_limited", _r(F.col("dbtp"), "dbtp"), _r(F.col("lkfs"), "lkfs"))


@query("block_loudness", _sig(", ex AS (SELECT channel, x, unnest(generate_series(greatest(0, (n - 40) // 10 + CASE WHEN n >= 40 THEN 1 ELSE 0 END), n // 10)) AS block FROM sig) "
                              "SELECT channel, CAST(block AS BIGINT) AS block, round(sum(x * x) / 40, 6) AS ms FROM ex GROUP BY 1, 2 HAVING count(*) = 40"))
def block_loudness(spark, sf_dir):
    return loudness.block_energy(event_signal(spark, sf_dir), 40, 10).select("channel", "block", _r(F.col("ms"), "ms"))


# ---- catalog ----


_NAMES_SQL = "list_extract([" + ", ".join(f"'{d}/{n}'" for d, a in (("out", catalog.OUTPUT_LAYOUTS), ("in", catalog.INPUT_LAYOUTS)) for n in a) + "], p_partkey % 14 + 1)"


@query("layout_properties", f"WITH {catalog.layouts_sql()}, {catalog.labels_sql()}, s AS (SELECT direction || '/' || layout AS name, CAST(count(*) AS BIGINT) AS n_channels, CAST(count(*) FILTER (WHERE class = 'height') AS BIGINT) AS n_height, "
       f"bool_or(label = 'BL') AS has_back, string_agg(label, ' ' ORDER BY ord) AS labels FROM layouts JOIN labels_ USING (label) GROUP BY 1) SELECT p_partkey, s.* FROM (SELECT p_partkey, {_NAMES_SQL} AS name FROM part) p JOIN s USING (name)")
def layout_properties(spark, sf_dir):
    """M3, K6: the layout of each part."""
    names = F.array(*(F.lit(f"{d}/{n}") for d, a in (("out", catalog.OUTPUT_LAYOUTS), ("in", catalog.INPUT_LAYOUTS)) for n in a))
    both = catalog.layouts(spark).join(F.broadcast(catalog.labels(spark)), "label").withColumn("name", F.concat_ws("/", "direction", "layout"))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda e: e["label"]), " ")
    known = both.groupBy("name").agg(F.count("*").alias("n_channels"), F.count_if(F.col("class") == "height").alias("n_height"), F.bool_or(F.col("label") == "BL").alias("has_back"), in_order.alias("labels"))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 14 + 1).cast("int")).alias("name")).join(F.broadcast(known), "name")  # fourteen layouts


_IN, _OUT = ", ".join(f"'{n}'" for n in catalog.INPUT_LAYOUTS), ", ".join(f"'{n}'" for n in catalog.OUTPUT_LAYOUTS)


@query("can_upmix_matrix", f"WITH {catalog.layouts_sql()}, i AS (SELECT layout AS input, list(label) AS a FROM layouts WHERE direction = 'in' GROUP BY 1), o AS (SELECT layout AS output, list(label) AS b FROM layouts WHERE direction = 'out' GROUP BY 1) "
       f"SELECT o_orderkey, input, output, list_has_all(b, a) AND len(b) > len(a) AS ok FROM (SELECT o_orderkey, list_extract([{_IN}], o_custkey % 8 + 1) AS input, list_extract([{_OUT}], o_orderkey % 6 + 1) AS output FROM orders) q JOIN i USING (input) JOIN o USING (output)")
def can_upmix_matrix(spark, sf_dir):
    """Whether each order's output layout has all of its input layout, and more."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", pick(catalog.INPUT_LAYOUTS, F.col("o_custkey")).alias("input"), pick(catalog.OUTPUT_LAYOUTS, F.col("o_orderkey")).alias("output"))
    return jobs.join(F.broadcast(planning.can_upmix(catalog.layouts(spark))), ["input", "output"]).select("o_orderkey", "input", "output", "ok")  # 48 pairs


# ---- planning ----


@query("job_priority", "WITH c AS (SELECT 2 AS prio, o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT 3, o_orderkey FROM orders WHERE o_orderpriority LIKE '2%' UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_totalprice < 0) "
                       "SELECT prio, o_orderkey FROM c WHERE prio = (SELECT min(prio) FROM c)")
def job_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pick = lambda k, cond: o.where(cond).select(F.lit(k).alias("prio"), "o_orderkey")
    return planning.first_source(pick(2, "o_orderpriority LIKE '1%'").union(pick(3, "o_orderpriority LIKE '2%'")).union(pick(1, "o_totalprice < 0")))


@query("output_template", "SELECT o_orderkey, 'out/' || o_orderstatus || '/in' || o_orderkey || '_5.1.wav' AS output FROM orders")
def output_template(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = planning.expand_template(F.lit("out/{name}/{stem}_5.1{ext}"), stem=F.concat(F.lit("in"), F.col("o_orderkey").cast("string")), name=F.col("o_orderstatus"), ext=F.lit(".wav"))
    return o.select("o_orderkey", out.alias("output"))


_PREFLIGHT_SQL = """meta AS (SELECT 'in/' || p_partkey || '.wav' AS input, CASE WHEN p_size % 10 = 0 THEN NULL ELSE list_extract([44100, 48000, 96000, 22050], p_size % 4 + 1) END AS rate,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE list_extract([1, 2, 5, 6, 8, 10, 7], p_partkey % 7 + 1) END AS channels, CASE WHEN p_size % 10 = 0 THEN 'bad header' END AS error FROM part),
job AS (SELECT o_orderkey, 'in/' || (o_custkey + 900) || '.wav' AS input, CASE WHEN o_orderkey % 11 = 0 THEN 'in/' || (o_custkey + 900) || '.wav' WHEN o_orderkey % 5 = 0 THEN 'out/x.flac' ELSE 'out/x.wav' END AS output,
  list_extract(['5.1', '7.1', '5.1.2', '5.1.4', '7.1.2', '7.1.4', '9.1'], o_orderkey % 7 + 1) AS format, CASE WHEN o_orderstatus = 'F' THEN 'bed' ELSE 'wav' END AS kind, CASE WHEN o_custkey % 6 = 0 THEN 'PCM_16' ELSE 'PCM_24' END AS subtype,
  CASE WHEN o_custkey % 4 = 0 THEN 44100 END AS asked, CASE WHEN o_custkey % 13 = 0 THEN '5.1.2' WHEN o_custkey % 17 = 0 THEN 'quad' END AS override FROM orders),
ins AS (SELECT layout, list(label) AS a, count(*) AS k FROM layouts WHERE direction = 'in' GROUP BY 1), outs AS (SELECT layout, list(label) AS b FROM layouts WHERE direction = 'out' GROUP BY 1),
j AS (SELECT job.*, meta.input AS there, rate, channels, error, coalesce(override, CASE channels WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 5 THEN '5.0' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' WHEN 10 THEN '7.1.2' END) AS layout,
  coalesce(asked, CASE WHEN kind = 'bed' THEN 48000 END, rate) AS rate_out FROM job LEFT JOIN meta USING (input))"""


@query("preflight_reason", f"WITH {catalog.layouts_sql()}, {_PREFLIGHT_SQL} SELECT o_orderkey, j.layout, CAST(rate_out AS INTEGER) AS rate_out, CASE WHEN there IS NULL THEN 'missing' WHEN input = output THEN 'same path' WHEN error IS NOT NULL THEN 'unreadable' "
       "WHEN override IS NOT NULL AND ov.layout IS NULL THEN 'unknown layout' WHEN ov.k <> channels THEN 'channels differ' WHEN j.layout IS NULL THEN 'no layout' WHEN outs.layout IS NULL THEN 'unknown output layout' "
       "WHEN NOT (list_has_all(b, ins.a) AND len(b) > len(ins.a)) THEN 'cannot upmix' WHEN kind = 'bed' AND rate_out NOT IN (48000, 96000) THEN 'bed rate' WHEN kind = 'bed' AND subtype <> 'PCM_24' THEN 'bed bits' "
       "WHEN kind = 'bed' AND output NOT LIKE '%.wav' THEN 'bed suffix' END AS reason FROM j LEFT JOIN ins ON ins.layout = j.layout LEFT JOIN ins ov ON ov.layout = j.override LEFT JOIN outs ON outs.layout = j.format")
def preflight_reason(spark, sf_dir):
    """The first rule that each job breaks, over the metadata of the files that are there."""
    c = F.col
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    bad = c("p_size") % 10 == 0
    meta = table(spark, sf_dir, "part").select(F.format_string("in/%d.wav", "p_partkey").alias("path"), F.when(~bad, pick((44100, 48000, 96000, 22050), c("p_size"))).alias("rate"),
                                               F.when(~bad, pick((1, 2, 5, 6, 8, 10, 7), c("p_partkey"))).alias("channels"), F.when(bad, "bad header").alias("error"))
    source = F.format_string("in/%d.wav", c("o_custkey") + 900)
    jobs = table(spark, sf_dir, "orders").select(
        "o_orderkey", source.alias("input"), F.when(c("o_orderkey") % 11 == 0, source).when(c("o_orderkey") % 5 == 0, "out/x.flac").otherwise("out/x.wav").alias("output"),
        pick((*catalog.OUTPUT_LAYOUTS, "9.1"), c("o_orderkey")).alias("format"), F.when(c("o_orderstatus") == "F", "bed").otherwise("wav").alias("kind"), F.when(c("o_custkey") % 6 == 0, "PCM_16").otherwise("PCM_24").alias("subtype"),
        F.when(c("o_custkey") % 4 == 0, 44100).alias("asked_rate"), F.when(c("o_custkey") % 13 == 0, "5.1.2").when(c("o_custkey") % 17 == 0, "quad").alias("override"))
    return batch.preflight(jobs, meta).select("o_orderkey", "layout", "rate_out", "reason")


@query("duplicate_outputs", "SELECT o_orderkey, 'out/' || o_custkey AS output, CAST(jobs AS BIGINT) AS jobs FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS jobs FROM orders) q WHERE jobs > 1")
def duplicate_outputs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("out/"), F.col("o_custkey").cast("string")).alias("output"))
    return planning.duplicates(jobs).select("o_orderkey", "output", "jobs")


@query("resume_split", "SELECT 'out/' || o_orderkey AS output, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'skip' ELSE 'plan' END AS action FROM orders")
def resume_split(spark, sf_dir):
    """A job is skipped where the state has its input and configuration, and the file that is there is the one that was written."""
    c = F.col
    all_ = table(spark, sf_dir, "orders").select(F.concat(F.lit("out/"), c("o_orderkey").cast("string")).alias("output"), c("o_totalprice").cast("bigint").alias("size"), c("o_orderkey").alias("modified"), c("o_orderstatus").alias("config_hash"), "o_orderkey", "o_custkey")
    state = all_.where("o_orderkey % 3 = 0").select("output", "size", F.when(c("o_orderkey") % 2 == 0, c("modified")).otherwise(-1).alias("modified"), "config_hash", F.lit(48000).alias("rate"), F.lit(6).alias("channels"), c("o_custkey").alias("frames"))
    files = all_.where("o_orderkey % 7 <> 0").select("output", F.lit(48000).alias("rate"), F.lit(6).alias("channels"), F.when(c("o_custkey") % 5 != 0, c("o_custkey")).otherwise(-1).alias("frames"))
    done, todo = batch.resume(all_.drop("o_orderkey", "o_custkey"), state, files, overwrite=True)
    return done.select("output", F.lit("skip").alias("action")).union(todo.select("output", F.lit("plan").alias("action")))


@query("state_upsert", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def state_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return planning.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey")


@query("config_fingerprint", """SELECT n_nationkey, sha256('{"name":"' || n_name || '","region":"' || n_regionkey || '","zone":"z"}') AS hash FROM nation""")
def config_fingerprint(spark, sf_dir):
    pairs = F.create_map(F.lit("zone"), F.lit("z"), F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2(planning.canonical_json(pairs), 256).alias("hash"))


_DOCS_SQL = """base AS (SELECT p_partkey AS doc, unnest(['a.x', 'a.y', 'b.p', 'b.q.r', 'c.d.e', 'f']) AS path, unnest([CAST(p_size AS VARCHAR), '2', '3', '4', '5', 'scalar']) AS value FROM part),
over AS (SELECT p_partkey AS doc, 'a.x' AS path, '9' AS value FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'b', 'flat' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'f.g', 'new' FROM part WHERE p_size % 5 = 0)"""


@query("deep_merge", f"WITH {_DOCS_SQL} SELECT doc, path, value FROM base b WHERE NOT EXISTS (SELECT 1 FROM over o WHERE o.doc = b.doc AND (o.path = b.path OR starts_with(b.path, o.path || '.') OR starts_with(o.path, b.path || '.'))) UNION ALL SELECT doc, path, value FROM over")
def deep_merge(spark, sf_dir):
    """A document for each part, with what some of them override."""
    c, p = F.col, table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc")
    leaves = {"a.x": c("p_size").cast("string"), "a.y": F.lit("2"), "b.p": F.lit("3"), "b.q.r": F.lit("4"), "c.d.e": F.lit("5"), "f": F.lit("scalar")}
    base = p.select("doc", F.inline(F.array(*(F.struct(F.lit(k).alias("path"), v.alias("value")) for k, v in leaves.items()))))
    set_ = lambda where, path, value: p.where(where).select("doc", F.lit(path).alias("path"), F.lit(value).alias("value"))
    return planning.deep_merge(base, set_("doc % 3 = 0", "a.x", "9").union(set_("doc % 2 = 0", "b", "flat")).union(set_("p_size % 5 = 0", "f.g", "new")))


@query("typed_coerce", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'bad' ELSE 'ok' END AS state FROM events")
def typed_coerce(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k.isNull(), "bad").otherwise("ok").alias("state"))


@query("cache_key", "SELECT p_partkey, substr(sha256(p_name || '|' || p_size || '|' || printf('%.3f', p_retailprice) || '|v2'), 1, 20) AS key FROM part")
def cache_key(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", planning.cache_key(F.col("p_name"), F.col("p_size").cast("string"), F.format_string("%.3f", "p_retailprice"), F.lit("v2")).alias("key"))


@query("cache_lookup", "WITH e AS (SELECT key, part AS owner, was, stems FROM (SELECT 'n' || p_partkey AS key, p_partkey AS part, 100 + p_partkey % 5 AS was, p_size % 4 AS stems FROM part WHERE p_partkey % 3 = 0 UNION ALL "
                       "SELECT 'o' || p_partkey, p_partkey, 100e0, 2 FROM part WHERE p_partkey % 2 = 0) q), "
                       "w AS (SELECT *, stems > 0 AND NOT (key LIKE 'n%' AND stems = 3 AND owner % 7 = 0) AND abs(was - 101) <= 2 AS ok FROM e) "
                       "SELECT p_partkey AS id, CASE WHEN n.key IS NOT NULL AND n.ok THEN n.key WHEN n.key IS NULL AND o.ok THEN o.key END AS hit, CASE WHEN n.key IS NOT NULL AND n.ok THEN 'new' WHEN n.key IS NULL AND o.ok THEN 'legacy' ELSE 'miss' END AS via "
                       "FROM part LEFT JOIN w n ON n.key = 'n' || p_partkey LEFT JOIN w o ON o.key = 'o' || p_partkey")
def cache_lookup(spark, sf_dir):
    """JN11: the new key first, then the old one; an entry serves if its time fits and all of its files are there."""
    c, p = F.col, table(spark, sf_dir, "part")
    key = lambda k: F.concat(F.lit(k), c("p_partkey").cast("string"))
    stems = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (c("p_size") % 4).cast("int"))
    new = p.where("p_partkey % 3 = 0").select(key("n").alias("key"), (100e0 + c("p_partkey") % 5).alias("modified"), stems.alias("stems"), "p_partkey")
    old = p.where("p_partkey % 2 = 0").select(key("o").alias("key"), F.lit(100e0).alias("modified"), F.array(F.lit("a"), F.lit("b")).alias("stems"), "p_partkey")
    entries = new.union(old)
    files = entries.select("key", F.explode("stems").alias("stem"), "p_partkey").where("NOT (key LIKE 'n%' AND stem = 'c' AND p_partkey % 7 = 0)")
    requests = p.select(c("p_partkey").alias("id"), key("n").alias("key"), key("o").alias("legacy"), F.lit(101e0).alias("modified"))
    return stem_plans.cache_hits(requests, entries.drop("p_partkey"), files.select("key", "stem"))


@query("ordered_dedupe", "SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def ordered_dedupe(spark, sf_dir):
    return planning.ordered_distinct(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")


@query("adm_track_ids", f"WITH {catalog.layouts_sql()} SELECT p_partkey, label, printf('ATU_%08d', ord + 1) AS uid, 'AT_0001' || upper(lpad(to_hex(ord + 4097), 4, '0')) || '_01' AS track "
                        f"FROM (SELECT p_partkey, list_extract([{_OUT}], p_partkey % 6 + 1) AS layout FROM part) p JOIN layouts USING (layout) WHERE direction = 'out'")
def adm_track_ids(spark, sf_dir):
    """IO9: the tracks of each part's layout."""
    layout = F.element_at(F.array(*map(F.lit, catalog.OUTPUT_LAYOUTS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    tracks = catalog.layouts(spark).where("direction = 'out'").select("layout", "label", F.format_string("ATU_%08d", F.col("ord") + 1).alias("uid"),
                                                                      F.concat(F.lit("AT_0001"), F.upper(F.lpad(F.hex(F.col("ord") + 4097), 4, "0")), F.lit("_01")).alias("track"))
    return table(spark, sf_dir, "part").select("p_partkey", layout.alias("layout")).join(F.broadcast(tracks), "layout").select("p_partkey", "label", "uid", "track")  # six layouts


_TAGS = {"Vocals": "Vocals", "Steel": "Drums", "Brushed": "Other", "Lead Vocals": "Lead Vocals"}


@query("stem_name_parse", "SELECT p_partkey, CASE WHEN p_type LIKE '%BRUSHED%' THEN CASE WHEN p_size % 2 = 0 THEN 'Piano' ELSE 'Other' END WHEN p_type LIKE '%STEEL' THEN 'Drums' ELSE 'Vocals' END AS stem FROM part")
def stem_name_parse(spark, sf_dir):
    """Of the known tags the one that stands last; a model's own come first."""
    c = F.col
    tag = F.when(c("p_type").contains("BRUSHED"), "Brushed").when(c("p_type").endswith("STEEL"), "STEEL").otherwise("unknown")
    file = F.concat(F.lit("x (Steel)/"), "p_name", F.lit("_(Vocals)_("), tag, F.lit(")_model.wav"))
    own = stem_plans.stem_name(file, _TAGS, {"brushed": "Piano"})
    return table(spark, sf_dir, "part").select("p_partkey", F.when(c("p_size") % 2 == 0, own).otherwise(stem_plans.stem_name(file, _TAGS)).alias("stem"))


@query("stem_key", "SELECT p_partkey, split_part(p_brand || CASE WHEN p_partkey % 2 = 0 THEN '@front' ELSE '' END, '@', 1) AS stem, replace(p_type || '/@x', '/', '_') AS file FROM part")
def stem_key(spark, sf_dir):
    key = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "@front").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.split_part(key, F.lit("@"), F.lit(1)).alias("stem"), F.replace(F.concat("p_type", F.lit("/@x")), F.lit("/"), F.lit("_")).alias("file"))


@query("requested_stems", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 1)")
def requested_stems(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.join(p.where("p_size = 1").select("p_brand").distinct(), "p_brand", "left_semi").select("p_partkey", "p_brand")


@query("batch_totals", "SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS jobs, round(sum(o_totalprice), 2) AS seconds FROM orders GROUP BY 1")
def batch_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"), F.round(F.sum("o_totalprice"), 2).alias("seconds"))


@query("nearest_reference", "SELECT p_partkey, CASE WHEN p_size % 14 <= 1 THEN 1 WHEN p_size % 14 <= 4 THEN 2 WHEN p_size % 14 <= 7 THEN 6 WHEN p_size % 14 <= 10 THEN 8 ELSE 12 END AS k FROM part")
def nearest_reference(spark, sf_dir):
    """K4: of the supported channel counts the nearest, the smaller where two are."""
    n = F.col("p_size") % 14
    best = F.array_min(F.array(*(F.struct(F.abs(n - k).alias("d"), F.lit(k).alias("k")) for k in (1, 2, 6, 8, 12))))
    return table(spark, sf_dir, "part").select("p_partkey", best["k"].alias("k"))


@query("valid_versions", "SELECT event_id, regexp_full_match(v, '[0-9]+\\.[0-9]+(\\.[0-9]+)?') AS ok FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '1.0.' || event_id WHEN 2 THEN 'v1.0' ELSE CAST(event_id AS VARCHAR) END AS v FROM events) q")
def valid_versions(spark, sf_dir):
    e = F.col("event_id")
    v = F.when(e % 4 == 0, "1.0").when(e % 4 == 1, F.concat(F.lit("1.0."), e.cast("string"))).when(e % 4 == 2, "v1.0").otherwise(e.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", v.rlike(r"^\d+\.\d+(\.\d+)?$").alias("ok"))


@query("zone_pairs", _sig(", s AS (SELECT n, CASE WHEN channel IN ('FL', 'FR') THEN 'front' WHEN channel = 'SL' THEN 'surround' END AS zone, channel, x FROM sig) "
                          "SELECT zone, n, round(max(x) FILTER (WHERE channel LIKE '%L'), 6) AS l, round(max(x) FILTER (WHERE channel LIKE '%R'), 6) AS r FROM s WHERE zone IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 2"))
def zone_pairs(spark, sf_dir):
    """P5: pairs of a zone that are complete."""
    zone = F.when(F.col("channel").isin("FL", "FR"), "front").when(F.col("channel") == "SL", "surround")
    s = event_signal(spark, sf_dir).withColumn("zone", zone).where("zone IS NOT NULL")
    side = lambda c: F.round(F.max(F.when(F.endswith("channel", F.lit(c)), F.col("x"))), 6)
    return s.groupBy("zone", "n").agg(F.count("*").alias("c"), side("L").alias("l"), side("R").alias("r")).where("c = 2").drop("c")


@query("mixdown", _sig("SELECT n, round(sum(x), 6) AS y FROM sig GROUP BY 1"))
def mixdown(spark, sf_dir):
    return event_signal(spark, sf_dir).groupBy("n").agg(_r(F.sum("x"), "y"))


@query("ref_rms_gain", _sig(", r AS (SELECT channel, sqrt(avg(x * x) + 1e-20) AS rms FROM sig WHERE channel <> 'LFE' GROUP BY 1) SELECT round(greatest(-6e0, least(6e0, 20 * log10((SELECT avg(rms) FROM r WHERE channel IN ('FL', 'FR')) / (SELECT avg(rms) FROM r)))), 6) AS gain_db"))
def ref_rms_gain(spark, sf_dir):
    """The gain from all channels' mean level to the front pair's, within 6 dB."""
    per = event_signal(spark, sf_dir).where("channel <> 'LFE'").groupBy("channel").agg(F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-20).alias("rms"))
    front = F.avg(F.when(F.col("channel").isin("FL", "FR"), F.col("rms")))
    return per.agg(_r(F.greatest(F.lit(-6e0), F.least(F.lit(6e0), 20 * F.log10(front / F.avg("rms")))), "gain_db"))
