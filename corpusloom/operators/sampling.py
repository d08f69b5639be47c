"""Seeded samples, quotas, gaps, offsets and packing. Order is by a hash of id and seed, so a
sample does not depend on partitions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored


def seeded(rid: Column, seed: int) -> Column:
    """A number in [0, 2**32) that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", rid.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long")


def quota(docs: DataFrame, group: str, share: dict[str, int], n: int, seed: int = 1) -> DataFrame:
    """The first round(n * share / 100) rows of each group in seeded order; Spark cuts each
    task's part of a group to its rank limit before the shuffle."""
    want = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, round(n * v / 100))])
    r = F.row_number().over(W.partitionBy(group).orderBy(seeded(F.col("doc_id"), seed), "doc_id"))
    return docs.where(F.col(group).isin(*share)).withColumn("rank", r).where(F.col("rank") <= F.element_at(want, F.col(group)))


def holdout(docs: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    return docs.orderBy(seeded(F.col("doc_id"), seed), "doc_id").limit(n)


def gaps(docs: DataFrame, lengths: list[int], text: str = "text", margin: int = 4, seed: int = 7) -> DataFrame:
    """(doc_id, gap, start, gold): one gap of each length, `margin` characters from the ends."""
    d = docs.select("doc_id", F.col(text).alias("t"), F.explode(F.array(*map(F.lit, lengths))).alias("gap")).where(F.length("t") >= F.col("gap") + 2 * margin + 1)
    at = (margin + F.pmod(seeded(F.concat_ws("-", "doc_id", "gap"), seed), F.length("t") - F.col("gap") - 2 * margin)).cast("int")
    d = d.withColumn("start", at)
    return d.select("doc_id", "gap", "start", F.col("t").substr(F.col("start") + 1, F.col("gap")).alias("gold"))


def offsets(rows: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """`offset`: the lengths of all rows before, in each group. Rows are dealt by ranges of (group, order), so a group that
    holds a third of all rows is in many tasks; each adds the sums of the group's parts before its own."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, group, order).withColumn("_part", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(group, "_part").agg(F.sum(length).alias("_n"))
    before = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a group and part
    own = F.coalesce(F.sum(length).over(W.partitionBy("_part", group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn("_own", own).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.select(*rows.columns, (F.col("_before") + F.col("_own")).alias("offset"))


def greedy_packing(rows: DataFrame, group: str, order: str, length: str, width: int, words: str | None = None, most_words: int | None = None) -> DataFrame:
    """(group, order, row_id, offset): rows in order into lines of `width` (and `most_words`); a line is closed when the
    next does not fit; rows that fit in no line are left out (oversize() counts them). Sequential in a group, streamed in
    batches."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cap = most_words if most_words is not None else 1 << 62

    def run(batches):
        now, row, at, held = None, 0, 0, 0
        for pdf in batches:
            out = []
            for g, o, n, w in zip(pdf["g"], pdf["o"], pdf["n"], pdf["w"], strict=True):
                if g != now:
                    now, row, at, held = g, 0, 0, 0
                if n > width or w > cap:
                    continue
                if at + n > width or held + w > cap:
                    row, at, held = row + 1, 0, 0
                out.append((g, o, row, at))
                at, held = at + int(n), held + int(w)
            yield pd.DataFrame(out, columns=["g", "o", "row_id", "offset"])

    w = F.col(words) if words else F.lit(0)
    s = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(length).alias("n"), w.cast("long").alias("w")).repartition("g").sortWithinPartitions("g", "o")
    return s.mapInPandas(run, f"g {kinds[group]}, o {kinds[order]}, row_id long, offset long").select(F.col("g").alias(group), F.col("o").alias(order), "row_id", "offset")


def oversize(rows: DataFrame, group: str, length: str, width: int) -> DataFrame:
    """(group, skipped): rows that greedy_packing leaves out for their length."""
    return rows.groupBy(group).agg(F.count_if(F.col(length) > width).alias("skipped"))


def verse_windows(verses: DataFrame, work: str, order: str, length: str, most: int, width: int, passes: int = 1, seed: int = 0) -> DataFrame:
    """(work, pass, window, first, last, n): runs of 1 to `most` consecutive verses of a work, at most `width` letters, from
    a seeded start in each pass; a verse longer than that is skipped. Works are read in order, streamed in batches."""
    kinds = {f.name: f.dataType.simpleString() for f in verses.schema.fields}

    def draw(*key) -> int:
        return int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16)

    def cut(work_, rows):
        for p in range(passes):
            i, k = draw(work_, p) % min(most, len(rows)), 0
            while i < len(rows):
                take, total = [], 0
                for o, n in rows[i : i + 1 + draw(work_, p, k) % most]:
                    if total + n > width:
                        break
                    take.append(o)
                    total += n
                if take:
                    yield work_, p, k, take[0], take[-1], total
                    k += 1
                i += max(1, len(take))

    def run(batches):
        held, now = [], None
        for pdf in batches:
            out = []
            for g, o, n in zip(pdf["g"], pdf["o"], pdf["n"], strict=True):
                if g != now and held:
                    out += cut(now, held)
                    held = []
                now = g
                held.append((o, int(n)))
            yield pd.DataFrame(out, columns=["g", "pass", "window", "first", "last", "n"])
        if held:
            yield pd.DataFrame(cut(now, held), columns=["g", "pass", "window", "first", "last", "n"])

    s = verses.select(F.col(work).alias("g"), F.col(order).alias("o"), F.col(length).alias("n")).repartition("g").sortWithinPartitions("g", "o")
    return s.mapInPandas(run, f"g {kinds[work]}, pass int, window int, first {kinds[order]}, last {kinds[order]}, n long").withColumnRenamed("g", work)


def seams(rows: DataFrame, work: str, order: str, stop: str = "stop", boundary: str = "boundary") -> DataFrame:
    """Within a window the last letter of a verse ends a word, not a sentence, unless a stop of a sentence follows it; the
    window's last letter keeps its end. Columns: boundary and stop of each verse's last letter."""
    last = F.lead(order).over(W.partitionBy(work).orderBy(order)).isNull()
    return rows.withColumn(boundary, F.when(last | (F.col(stop) >= 4), F.col(boundary)).otherwise(1))
