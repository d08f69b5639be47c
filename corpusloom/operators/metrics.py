"""Evaluation: error rates, top-k, F1, balanced accuracy, significance, dependency scores."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reports import significance


def cer(gold: Column, pred: Column) -> Column:
    return F.levenshtein(gold, pred) / F.greatest(F.length(gold), F.lit(1))


def gap_report(samples: DataFrame, band: str, gold: str, hyps: str, k: int = 20) -> DataFrame:
    """Per band: n, mean CER of the first hypothesis, share of gold at rank 1 and within k."""
    first = F.coalesce(F.get(F.col(hyps), 0), F.lit(""))
    s = samples.select(band, cer(F.col(gold), first).alias("cer"), (first == F.col(gold)).cast("int").alias("top1"), F.array_contains(F.slice(hyps, 1, k), F.col(gold)).cast("int").alias("topk"))
    return s.groupBy(band).agg(F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg("top1").alias("top1"), F.avg("topk").alias("topk"))


def macro_micro(per: DataFrame, value: str, weight: str) -> DataFrame:
    """The mean of group means, and the mean over all rows."""
    return per.agg(F.avg(value).alias("macro"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("micro"))


def binary_scores(pairs: DataFrame, gold: str, pred: str, *group: str) -> DataFrame:
    """Counts, precision, recall, F1 and balanced accuracy of 0/1 columns; 0 where undefined."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    c = pairs.groupBy(*group).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*group, "tp", "fp", "fn", "tn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), ((safe(tp, tp + fn) + safe(tn, tn + fp)) / 2).alias("balanced_accuracy"))


def sign_flip_p(diffs: DataFrame, diff: str) -> DataFrame:
    """(n, p): two-sided permutation p of paired differences, the rows of a result table; see reports.sign_flip."""
    one = significance(diffs.withColumn("_all", F.lit(1)), "_all", value=diff)
    return one.select("n", "p")


def two_proportions(k1: int, n1: int, k2: int, n2: int) -> tuple[float, float]:
    """z and two-sided p of a difference of shares; reports.two_shares does it for a table."""
    p = (k1 + k2) / (n1 + n2)
    se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = (k1 / n1 - k2 / n2) / se if se else 0.0
    return z, math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def similarity_error(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """1 less the matching-blocks ratio of two strings, the second cut to the first's length."""
    return pd.Series([1.0 if g is None or p is None else 1 - difflib.SequenceMatcher(None, g, p[: len(g)], autojunk=False).ratio() for g, p in zip(gold, pred, strict=True)])


def attachment_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """UPOS, lemma, UAS, LAS over words aligned by (sent, start, end): n of each side, aligned, correct, F1."""
    on = ["sent", "start", "end"]
    g = gold.select(*on, F.struct("upos", "lemma", "head", "deprel").alias("g"))
    p = pred.select(*on, F.struct("upos", "lemma", "head", "deprel").alias("p"))
    both = g.join(p, on, "full")
    ok = lambda *f: F.count_if(F.expr(" and ".join(f"g.{x} = p.{x}" for x in f)))
    c = both.agg(F.count("g").alias("n_gold"), F.count("p").alias("n_pred"), ok("upos").alias("UPOS"), ok("lemma").alias("Lemmas"), ok("head").alias("UAS"), ok("head", "deprel").alias("LAS"))
    long = c.unpivot(["n_gold", "n_pred"], ["UPOS", "Lemmas", "UAS", "LAS"], "metric", "correct")
    return long.withColumn("f1", 2 * F.col("correct") / F.greatest(F.col("n_gold") + F.col("n_pred"), F.lit(1)))
