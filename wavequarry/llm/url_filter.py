"""URL filter: rules first, then the log-likelihood ratio of two character models."""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.common import table

#: Rules as (verdict, host, path start); the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters of context at most.
ORDER = 3
_SIGNS = "./-_?=&#%:~+@"
#: Symbols: the start, letters, one for all digits, signs, one for all else. Tables have SYMBOLS ** (ORDER + 1) cells.
SYMBOLS = 1 + 26 + 1 + len(_SIGNS) + 1
#: One row in so many, by hash, calibrates instead of training.
FOLDS = 10
_BIN = 64.0


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.when(F.contains(url, F.lit("://")), F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _symbol_table() -> np.ndarray:
    out = np.full(256, SYMBOLS - 1, np.int64)
    for k, c in enumerate(string.ascii_lowercase):
        out[ord(c)] = out[ord(c.upper())] = 1 + k
    out[ord("0"):ord("9") + 1] = 27
    for k, c in enumerate(_SIGNS):
        out[ord(c)] = 28 + k
    return out


_TABLE = _symbol_table()


def grams(url: str | None) -> np.ndarray:
    """Cell numbers of a URL's characters (bytes), each with the ORDER symbols before it; none for an empty URL."""
    raw = np.frombuffer((url or "").encode(), np.uint8)
    s = np.concatenate([np.zeros(ORDER, np.int64), _TABLE[raw]])
    out = np.zeros(len(raw), np.int64)
    for k in range(ORDER + 1):
        out = out * SYMBOLS + s[k:k + len(raw)]
    return out


def smoothed(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | context) for every cell, from the full-order counts.

    Witten-Bell interpolation from no context up: a context takes over from the
    shorter one as far as its count goes; one that was never seen leaves it all.
    """
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for k in range(ORDER + 1):
        own = counts.reshape(-1, SYMBOLS ** (k + 1)).sum(0).reshape(-1, SYMBOLS).astype(np.float64)
        total, kinds = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
        below = p.reshape(-1, SYMBOLS)
        below = np.tile(below, (own.shape[0] // below.shape[0], 1))
        p = np.where(total > 0, (own + kinds * below) / np.maximum(total + kinds, 1), below)
    return np.log(p.ravel())


@dataclass(frozen=True)
class UrlModel:
    """Ratio of accepted to rejected likelihood per cell, and the threshold on its mean; none: every URL is allowed."""

    ratio: np.ndarray | None
    threshold: float = 0.0

    def score(self, url: str | None) -> float:
        if self.ratio is None:
            return 0.0
        g = grams(url)
        return float(self.ratio[g].mean(dtype=np.float64)) if len(g) else 0.0


def _counted(batches):
    held = {y: np.zeros(SYMBOLS ** (ORDER + 1), np.int64) for y in ("allow", "block")}
    seen = False
    for batch in batches:
        for y, u in zip(batch.column("verdict").to_pylist(), batch.column("url").to_pylist(), strict=True):
            np.add.at(held[y], grams(u), 1)
            seen = True
    for y, c in held.items() if seen else ():
        cells = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([y] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(c[cells], pa.int64())], ["y", "cell", "c"])


def scores(model: UrlModel, spark):
    """A column function: URL to its length-normalised log-likelihood ratio. The table it sends out has a fixed size."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(url: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(u) for u in url], dtype=float)

    return of


def train_url_model(pages: DataFrame, rules=RULES, url_col: str = "url") -> UrlModel:
    """Two character models over all URLs that a rule allows or blocks, calibrated on one in ``FOLDS`` of them.

    The driver gets cell counts, of which there are at most 2 * SYMBOLS ** (ORDER + 1),
    and a histogram. The threshold has the least mean of both error rates; of ties,
    the one nearest 0. Where either class has no URL, nothing is learned.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    labelled = (pages.select(url.alias("url")).withColumn("verdict", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"])
                .where("verdict IS NOT NULL").withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))))
    summed = labelled.where("fold <> 0").select("verdict", "url").mapInArrow(_counted, "y string, cell bigint, c bigint").groupBy("y", "cell").agg(F.sum("c").alias("c"))
    counts = {y: np.zeros(SYMBOLS ** (ORDER + 1), np.int64) for y in ("allow", "block")}
    got = summed.toPandas()
    for y, c in counts.items():
        own = got[got["y"] == y]
        c[own["cell"].to_numpy(np.int64)] = own["c"].to_numpy(np.int64)
    if not all(c.any() for c in counts.values()):
        return UrlModel(None)
    model = UrlModel((smoothed(counts["allow"]) - smoothed(counts["block"])).astype(np.float32))
    held = labelled.where("fold = 0").select("verdict", F.floor(scores(model, spark)("url") * _BIN).alias("bin")).groupBy("bin").pivot("verdict", ["allow", "block"]).count()
    rows = sorted((r["bin"], r["allow"] or 0, r["block"] or 0) for r in held.collect())
    return UrlModel(model.ratio, calibrated(rows))


def calibrated(rows: list[tuple[int, int, int]]) -> float:
    """The threshold of least balanced error, from (bin, allowed, blocked) by rising bin."""
    allowed, blocked = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allowed or not blocked:
        return 0.0
    low_allowed = low_blocked = 0
    tops = [None, *(r[0] + 1 for r in rows)]  # between the last bin below and the first one above, the place nearest 0
    options = []
    for low, (b, a, x) in zip(tops, [*rows, (None, 0, 0)], strict=True):
        at = min(max(0.0, -np.inf if low is None else low / _BIN), np.inf if b is None else b / _BIN)
        options.append((low_allowed / allowed + 1 - low_blocked / blocked, abs(at), at))
        low_allowed, low_blocked = low_allowed + a, low_blocked + x
    return float(min(options)[2])


def judge_urls(pages: DataFrame, model: UrlModel, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and the model's score.

    A null URL is empty: no host, no path, no rule, score 0. Repeated rows and null
    ids are rows of their own. An empty table gives none.
    """
    plain = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    found = plain.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = found.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", scores(model, pages.sparkSession)("url"))
    own = F.when(F.col("score") >= model.threshold, "allow").otherwise("block") if model.ratio is not None else F.lit("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score")


def op7_url_filter(spark, sf_dir):
    """All pages' URLs judged by rules and the model that the rules' URLs train."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, train_url_model(pages))
