"""Zones, eligibility, lists of what is left out, ranges, samples and shards: filters as column expressions.

Lists that come as tables join; their rows are ids or prefixes, and Spark broadcasts them only where small() has counted them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decontam import TEST, TRAIN, VAL, small
from .sampling import seeded


def last_digit(rid: Column) -> Column:
    return F.right(F.trim(rid.cast("string")), F.lit(1))


def digit_split(rid: Column, test: str = "3", val: str = "4") -> Column:
    """test, val or train by the last character of an id."""
    d = last_digit(rid)
    return F.when(d == val, "val").when(d == test, "test").otherwise("train")


def record_zone(source: Column, tier: Column, rid: Column, numbered: tuple[str, ...], rotating: str = "pristine", test: str = "3", val: str = "4") -> Column:
    """The zone before assignment: numbered sources by the digit rule, other records of the rotating tier -1 (to be
    assigned to a bucket with their cluster), all others train."""
    d = last_digit(rid)
    digit = F.when(d == test, TEST).when(d == val, VAL).otherwise(TRAIN)
    return F.when(source.isin(*numbered), digit).when(tier == rotating, -1).otherwise(TRAIN)


def digit_faults(zones: DataFrame, rid: str = "doc_id", zone: str = "zone") -> DataFrame:
    """(zone, wanted, n): rows whose zone is not the one that their id's last character asks for."""
    d = last_digit(F.col(rid))
    wanted = F.when(d == "3", TEST).when(d == "4", VAL).otherwise(TRAIN)
    return zones.withColumn("wanted", wanted).where(F.col(zone) != F.col("wanted")).groupBy(zone, "wanted").agg(F.count("*").alias("n"))


def base_id(rid: Column) -> Column:
    """An id without what follows #, and then without what follows its first underscore."""
    return F.split_part(F.split_part(rid, F.lit("#"), F.lit(1)), F.lit("_"), F.lit(1))


def canonical_zones(docs: DataFrame, numbers: DataFrame, buckets: DataFrame, siblings: DataFrame, numbered: tuple[str, ...]) -> DataFrame:
    """(doc_id, zone, rule): numbered sources by the digit of the number that `numbers` (id, number) has for the id, or
    for its base, else by a hash of the base; rotating records by `buckets` (doc_id, zone); the others by the bucket of
    their work in `siblings` (prefix, zone); train where nothing says more. docs: doc_id, source, tier, prefix."""
    by_id = numbers.select(F.col("id").alias("doc_id"), F.col("number").cast("string").alias("n1"))
    by_base = numbers.select(F.col("id").alias("base"), F.col("number").cast("string").alias("n2"))
    d = docs.withColumn("base", base_id(F.col("doc_id"))).join(by_id, "doc_id", "left").join(by_base, "base", "left")
    d = d.join(buckets.select("doc_id", F.col("zone").alias("bucket")), "doc_id", "left").join(siblings.select("prefix", F.col("zone").alias("sibling")), "prefix", "left")
    number = F.coalesce("n1", "n2", seeded(F.col("base"), 0).cast("string"))
    digit = last_digit(number)
    listed = F.col("source").isin(*numbered)
    zone = F.when(listed, F.when(digit == "3", TEST).when(digit == "4", VAL).otherwise(TRAIN)).otherwise(F.coalesce("bucket", "sibling", F.lit(TRAIN)))
    rule = F.when(listed & F.coalesce("n1", "n2").isNotNull(), "number").when(listed, "hash").when(F.col("bucket").isNotNull(), "bucket").when(F.col("sibling").isNotNull(), "sibling").otherwise("train")
    return d.select("doc_id", zone.cast("int").alias("zone"), rule.alias("rule"))


def prefix_zones(zones: DataFrame, prefix: str, order: str) -> DataFrame:
    """(prefix, zone, conflict): the zone of a work's last record in order, and whether its records have several."""
    return zones.groupBy(prefix).agg(F.max_by("zone", order).alias("zone"), (F.count_distinct("zone") > 1).alias("conflict"))


def script_share(text: Column, inside: str, outside: str) -> Column:
    """Letters of one script as a share of those of two; null without any. Scripts are classes of a regular expression."""
    n = F.length(F.regexp_replace(text, f"[^{inside}]+", ""))
    return F.try_divide(n, n + F.length(F.regexp_replace(text, f"[^{outside}]+", "")))


def length_between(text: Column, low: int, high: int | None = None) -> Column:
    n = F.length(text)
    return (n >= low) & (n <= high) if high is not None else n >= low


def eligible(rows: DataFrame, least_clean: float, most_repeated: float, tier: str | None = None, held_out: int | None = 200, order: str = "ordinal", tier_col: str = "tier") -> DataFrame:
    """Rows clean enough, not too repetitive, of a tier, without every held_out-th one."""
    keep = (F.col("clean") >= least_clean) & (F.col("dup_frac") < most_repeated)
    keep = keep & (F.col(tier_col) == tier) if tier is not None else keep
    keep = keep & (F.col(order) % held_out != 0) if held_out else keep
    return rows.where(keep)


def without_prefixes(rows: DataFrame, rid: str, prefixes: list[str]) -> DataFrame:
    """Rows whose id begins with none of a short list of prefixes."""
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.startswith(F.col(rid), F.lit(p))
    return rows.where(~bad)


def without_sources(rows: DataFrame, sources: list[str], column: str = "source") -> DataFrame:
    return rows.where(~F.col(column).isin(*sources))


def catalogue_flags(catalogue: DataFrame, corpora: list[str], patterns: dict[str, str]) -> DataFrame:
    """Adds `flagged`: entries of the corpora listed, or with a field that its pattern (any case) matches."""
    test = F.col("corpus").isin(*corpora)
    for column, pattern in patterns.items():
        test = test | F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))
    return catalogue.withColumn("flagged", test)


def without_flagged(rows: DataFrame, flagged: DataFrame, rid: str = "id") -> DataFrame:
    """Rows whose id, up to the first colon, is not in flagged (id)."""
    key = F.split_part(F.col(rid), F.lit(":"), F.lit(1))
    return rows.withColumn("_key", key).join(small(flagged.select(F.col("id").alias("_key")).distinct()), "_key", "left_anti").drop("_key")


def without_listed(rows: DataFrame, excluded: DataFrame, *on: str) -> DataFrame:
    """Rows that the list does not name; keys are compared as strings. A list entry with null in a later key names all
    rows of the first."""
    keys = [f"_{c}" for c in on]
    r = rows.withColumns({k: F.col(c).cast("string") for k, c in zip(keys, on, strict=True)})
    e = excluded.select(*(F.col(c).cast("string").alias(k) for k, c in zip(keys, on, strict=True)))
    out = r.join(small(e.dropna().distinct()), keys, "left_anti")
    if len(on) > 1:
        whole = e.where(" and ".join(f"{k} is null" for k in keys[1:])).select(keys[0]).distinct()
        out = out.join(small(whole), keys[0], "left_anti")
    return out.drop(*keys)


def scorable_gap(text: Column, start: Column, length: Column) -> Column:
    """Whether a gap [start, start + length) of a text can be scored: no lost letter, no two spaces, not all space, and no
    space at its edge beside one outside."""
    gap = F.substring(text, start + 1, length)
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    after = F.substring(text, start + length + 1, F.lit(1))
    return ~(F.contains(gap, F.lit("-")) | F.contains(gap, F.lit("  ")) | (F.trim(gap) == "") | ((before == " ") & F.startswith(gap, F.lit(" "))) | ((after == " ") & F.endswith(gap, F.lit(" "))))


def gap_samples(docs: DataFrame, lengths: list[int], n: int, margin: int = 4, seed: int = 7, low: int = 50, high: int = 767) -> DataFrame:
    """(doc_id, gap, start, gold): the first n texts in seeded order, for each length, whose one seeded gap can be scored;
    texts of low to high characters, gaps at least `margin` from both ends."""
    d = docs.where(length_between(F.col("text"), low, high)).select("doc_id", "text", F.explode(F.array(*map(F.lit, lengths))).alias("gap"))
    d = d.where(F.length("text") > F.col("gap") + 2 * margin)
    room = F.length("text") - F.col("gap") - 2 * margin
    d = d.withColumn("start", (margin + F.pmod(seeded(F.concat_ws("-", "doc_id", "gap"), seed), F.greatest(room, F.lit(1)))).cast("int"))
    d = d.where(scorable_gap(F.col("text"), F.col("start"), F.col("gap")))
    rank = F.row_number().over(W.partitionBy("gap").orderBy(seeded(F.col("doc_id"), seed), "doc_id"))
    return d.withColumn("rank", rank).where(F.col("rank") <= n).select("doc_id", "gap", "start", F.expr("substring(text, start + 1, gap)").alias("gold"))


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("rank") <= n).drop("rank")


def mini_corpus(tiers: dict[str, DataFrame], per_source: int, extra: DataFrame) -> DataFrame:
    """The first rows of each source of each tier in order of id, in the order of tiers, and planted rows (the same columns)."""
    parts = [first_per_group(df, "source", "id", per_source).withColumn("tier", F.lit(t)) for t, df in tiers.items()]
    out = extra
    for p in parts:
        out = out.unionByName(p.select(*extra.columns))
    return out


def union_tiers(tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Tables one under the other, with their tier and its rank, which sorts them in that order."""
    out = None
    for rank, (name, df) in enumerate(tiers):
        part = df.withColumn("tier", F.lit(name)).withColumn("tier_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def numbered(rows: DataFrame, order: list[str], within: str | None = None) -> DataFrame:
    """Adds `ordinal`, from 0: in each group, or over the whole table from counts of its range partitions, so no
    task holds all rows."""
    if within is not None:
        return rows.withColumn("ordinal", F.row_number().over(W.partitionBy(within).orderBy(*order)).cast("long") - 1)
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").withColumn("ordinal", F.col("_before") + own - 1).drop("_part", "_before")


def every(rows: DataFrame, k: int, offset: int = 0, ordinal: str = "ordinal") -> DataFrame:
    """Every k-th row of a numbered table: a sample, or the shard `offset` of k."""
    return rows.where(F.col(ordinal) % k == offset)


def tier_mix(rows: DataFrame, weights: dict[str, float], n: int, seed: int = 0) -> DataFrame:
    """(…, pass): n draws from tiers by weight, each tier in seeded order, and once more in another order when it is used
    up: `pass` counts those rounds. Each tier's share is round(n * weight)."""
    total = sum(weights.values())
    quota = {t: round(n * w / total) for t, w in weights.items() if w > 0}
    want = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    sized = rows.where(F.col("tier").isin(*quota)).withColumn("_size", F.count("*").over(W.partitionBy("tier")))
    sized = sized.withColumn("_want", F.element_at(want, F.col("tier")))
    out = sized.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_want") / F.col("_size")) - 1)))
    rank = F.row_number().over(W.partitionBy("tier", "pass").orderBy(seeded(F.concat_ws("/", "doc_id", "pass"), seed), "doc_id"))
    return out.withColumn("_rank", rank).where(F.col("_rank") + F.col("pass") * F.col("_size") <= F.col("_want")).drop("_size", "_want", "_rank")


def record_weights(rows: DataFrame, shares: dict[str, float], length: str = "n_chars") -> DataFrame:
    """(tier, weight): weights of records that give tiers these shares of the characters; they sum to 1."""
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    w = rows.where(F.col("tier").isin(*shares)).groupBy("tier").agg(F.avg(length).alias("mean")).select("tier", (F.element_at(share, F.col("tier")) / F.col("mean")).alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    return w.join(F.broadcast(total)).select("tier", (F.col("w") / F.col("total")).alias("weight"))  # one row


def rank_shard(rows: DataFrame, rank: int, world: int, ordinal: str = "ordinal") -> DataFrame:
    return every(rows, world, rank, ordinal)


def seeded_order(units: DataFrame, size: str, unit: str, seed: int) -> DataFrame:
    """Units by size, the largest first, equal ones in seeded order."""
    return units.orderBy(F.desc(size), seeded(F.col(unit), seed), unit)


def repeated_ids(rows: DataFrame, rid: str = "doc_id") -> DataFrame:
    return rows.groupBy(rid).agg(F.count("*").alias("n")).where("n > 1")
