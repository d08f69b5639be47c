"""Result tables: means and deviations, last and best runs, stalls, sweeps, paired tests, likeness, bits."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean_sd(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, sd over all, sd of a sample), best mean first by `rank`."""
    out = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    return out.withColumn("rank", F.rank().over(W.orderBy(F.desc("mean"))))  # a row a system


def last_per_run(rows: DataFrame, run: str, order: str, *values: str) -> DataFrame:
    """The last row of each run in order."""
    return rows.groupBy(run).agg(F.max_by(F.struct(order, *values), order).alias("x")).select(run, "x.*")


def checkpoint_choice(evals: DataFrame, run: str, step: str, selected_by: str, judged_by: str) -> DataFrame:
    """(run, best, last, choice): the judged value at the least `selected_by` (the first of equals) and at the last step;
    the better is chosen, the best of equals."""
    out = evals.groupBy(run).agg(F.min_by(judged_by, F.struct(selected_by, step)).alias("best"), F.max_by(judged_by, step).alias("last"))
    return out.withColumn("choice", F.when(F.col("best") <= F.col("last"), "best").otherwise("last"))


def stalled(evals: DataFrame, run: str, step: str, value: str, window: int = 8, eps: float = 0.002) -> DataFrame:
    """(run, n, stalled): whether the least value of the last half window is not at least eps under that of the half before."""
    half = window // 2
    r = evals.withColumn("_back", F.row_number().over(W.partitionBy(run).orderBy(F.desc(step))))
    out = r.groupBy(run).agg(F.count("*").alias("n"), F.min(F.when(F.col("_back") <= half, F.col(value))).alias("new"), F.min(F.when((F.col("_back") > half) & (F.col("_back") <= 2 * half), F.col(value))).alias("old"))
    return out.select(run, "n", ((F.col("n") >= window) & (F.col("new") > F.col("old") - eps)).alias("stalled"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): all rows over number of classes times rows of the class."""
    n = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return n.join(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))  # one row


def label_set(rows: DataFrame, label: str) -> DataFrame:
    return rows.select(label).where(F.col(label).isNotNull()).distinct()


def sweep(rows: DataFrame, system: str, setting: str, value: str) -> DataFrame:
    """(system, best setting, best value, n settings): of equal values the least setting."""
    return rows.groupBy(system).agg(F.max_by(setting, F.struct(F.col(value), -F.col(setting))).alias("best_setting"), F.max(value).alias("best"), F.count("*").alias("n"))


def margin(rows: DataFrame, system: str, value: str, own: str, left_out: list[str], least: int = 8) -> DataFrame:
    """One row: the mean of our system less that of the strongest other one with `least` runs, and its name."""
    m = rows.groupBy(system).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    mine = m.where(F.col(system) == own).agg(F.first("mean").alias("own"))
    other = m.where((F.col(system) != own) & ~F.col(system).isin(*left_out) & (F.col("n") >= least)).agg(F.max_by(system, F.struct("mean", system)).alias("strongest"), F.max("mean").alias("theirs"))
    return mine.join(F.broadcast(other)).select("strongest", (F.col("own") - F.col("theirs")).alias("margin"))  # one row each


def merged_shards(rows: DataFrame, group: str, values: list[str], weight: str = "n") -> DataFrame:
    """Means of shards as means of all their rows, by weight."""
    return rows.groupBy(group).agg(F.sum(weight).alias(weight), *((F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values))


def paired(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """(on..., d): differences of two systems over the keys that both have."""
    return a.select(*on, F.col(value).alias("x")).join(b.select(*on, F.col(value).alias("y")), on).select(*on, (F.col("x") - F.col("y")).alias("d"))


def sign_flip(values: list[float], exact: int = 20, draws: int = 100_000, seed: int = 0) -> float:
    """Two-sided permutation p of paired differences: the share of sign patterns whose mean is at least as far from 0. All
    patterns up to `exact` differences; beyond that whole numbers are still exact, by the distribution of their sums, and
    others are drawn."""
    d = np.asarray(values, float)
    n, seen = len(d), abs(float(np.sum(values)))
    if not n:
        return 1.0
    if n <= exact:
        sums = np.zeros(1)
        for x in d:
            sums = np.concatenate((sums + x, sums - x))
        return float((np.abs(sums) >= seen - 1e-12 * n).mean())
    if np.all(d == np.rint(d)) and np.abs(d).sum() < 1_000_000:
        size = int(np.abs(d).sum())
        share = np.zeros(2 * size + 1)
        share[size] = 1.0
        for x in np.abs(d).astype(int):
            share = (np.roll(share, x) + np.roll(share, -x)) / 2
        return float(share[np.abs(np.arange(-size, size + 1)) >= seen].sum())
    flips = np.random.default_rng(seed).choice([-1.0, 1.0], size=(draws, n))
    return float((np.abs(flips @ d) >= seen - 1e-12 * n).mean())


def t_tail(t: float, freedom: int) -> float:
    """Two-sided tail of Student's distribution: the regularised incomplete beta function at (freedom / 2, 1 / 2), by its
    continued fraction, read from its end."""
    if not math.isfinite(t):
        return 0.0
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    value = 1.0
    for m in range(200, 0, -1):
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + odd / (1 + even / value)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a if 0 < x < 1 else 0.0
    p = front / value
    return min(1.0, max(0.0, 1 - p if swap else p))


def paired_t(values: list[float]) -> tuple[float, float, float]:
    """(t, two-sided p, Cohen's d of the differences); zeros and p 1 without spread."""
    d = np.asarray(values, float)
    sd = d.std(ddof=1) if len(d) > 1 else 0.0
    if not sd:
        return 0.0, 1.0, 0.0
    t = float(d.mean() / (sd / math.sqrt(len(d))))
    return t, t_tail(t, len(d) - 1), float(d.mean() / sd)


_REPORT = "n long, mean double, p double, t double, t_p double, d_z double"


def significance(diffs: DataFrame, *group: str, value: str = "d") -> DataFrame:
    """(group..., n, mean, p, t, t_p, d_z): permutation and t tests of the paired differences of each group, a result
    table of a few rows a group, one group a task."""
    kinds = {f.name: f.dataType.simpleString() for f in diffs.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = sorted(pdf["d"].tolist())
        t, tp, dz = paired_t(d)
        return pd.DataFrame([[*key, len(d), float(np.mean(d)), sign_flip(d), t, tp, dz]], columns=[*group, "n", "mean", "p", "t", "t_p", "d_z"])

    return diffs.select(*group, F.col(value).cast("double").alias("d")).groupBy(*group).applyInPandas(run, ", ".join([*(f"{g} {kinds[g]}" for g in group), _REPORT]))


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution."""
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


def two_shares(rows: DataFrame, k1: str, n1: str, k2: str, n2: str) -> DataFrame:
    """Adds z and its two-sided p for the difference of two shares; z is 0 where nothing varies."""
    k1, n1, k2, n2 = (F.col(c).cast("double") for c in (k1, n1, k2, n2))
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = F.when(se == 0, 0.0).otherwise((k1 / n1 - k2 / n2) / F.when(se == 0, 1.0).otherwise(se))
    return rows.withColumn("z", z).withColumn("p", normal_tail("z"))


def bits_per_char(rows: DataFrame, nll: str, n: str, *group: str) -> DataFrame:
    """(group..., chars, bits): negative log likelihoods in nats, summed, a character, in bits."""
    return rows.groupBy(*group).agg(F.sum(n).alias("chars"), (F.sum(nll) / F.lit(math.log(2)) / F.sum(n)).alias("bits"))


def bare_content(text: Column) -> Column:
    """Final sigma folded; spaces, full stops, middle dots and zeros off."""
    return F.regexp_replace(F.translate(text, "ς", "σ"), r"[ .·0]", "")


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters of two strings; null beside null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def likeness_error(gold: Column, pred: Column) -> Column:
    """1 less the matching ratio of the bare contents, the prediction's cut to the gold's length."""
    g, p = bare_content(gold), bare_content(pred)
    return 1 - matching_ratio(g, F.substring(p, F.lit(1), F.length(g)))


def likeness_report(samples: DataFrame, band: str, gold: str, hyps: str, k: int = 20, cut: str = "raw") -> DataFrame:
    """(band, n, cer, top1, topk) by matching ratio. Ranks compare bare contents of the gold and of hypotheses cut to its
    length: cut="raw" cuts before they are made bare, "bare" after."""
    first = F.coalesce(F.get(F.col(hyps), F.lit(0)), F.lit(""))
    g = bare_content(F.col(gold))
    made = (lambda h: bare_content(F.substring(h, F.lit(1), F.length(gold)))) if cut == "raw" else (lambda h: F.substring(bare_content(h), F.lit(1), F.length(g)))
    s = samples.select(band, likeness_error(F.col(gold), first).alias("cer"), (made(first) == g).cast("int").alias("top1"), F.exists(F.slice(hyps, 1, k), lambda h: made(h) == g).cast("int").alias("topk"))
    return s.groupBy(band).agg(F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg("top1").alias("top1"), F.avg("topk").alias("topk"))


def letters_error(gold: Column, pred: Column) -> Column:
    """Edit distance of two strings without spaces, a letter of the gold."""
    g, p = F.replace(gold, F.lit(" "), F.lit("")), F.replace(pred, F.lit(" "), F.lit(""))
    return F.levenshtein(g, p) / F.greatest(F.length(g), F.lit(1))


def length_band(n: Column, edges: tuple[tuple[int, int], ...] = ((1, 5), (6, 10), (11, 20))) -> Column:
    """Name of the band, low-high, that a length lies in; null outside all."""
    out = F.lit(None).cast("string")
    for low, high in edges:
        out = F.when(n.between(low, high), f"{low}-{high}").otherwise(out)
    return out


def beam(rows: DataFrame, group: str, score: str, tie: str, k: int = 20) -> DataFrame:
    """The k best hypotheses of each sample with their rank; of equal scores the least `tie` first."""
    r = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", r).where(F.col("rank") <= k)


def width_sweep(rows: DataFrame, group: str, width: str, score: str) -> DataFrame:
    """Of each sample's gap widths the one of the best mean score a letter; of equals the narrowest."""
    return rows.groupBy(group).agg(F.max_by(F.struct(width, score), F.struct(F.col(score) / F.greatest(F.col(width), F.lit(1)), -F.col(width))).alias("x")).select(group, "x.*")
