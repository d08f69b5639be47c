"""Further queries over the driver's tables, each beside its SQL. Stand-ins: languages for tiers, `source` for works and
sources, conversations for sentences of words, benchmark items for held-out records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planes as P
from ..functions import text as T
from ..operators import conll, dedup, folds, marks, metre, noise, reports, sampling, selection, trees, ud
from ..operators.scratch import bounded, fresh, stored
from ..sources import readers
from .registry import grams, query, seed, skel, table, wlist

# --- scans and sinks


@query("select lang as tier, count(*) as n, cast(sum(n_chars) as bigint) as chars, cast(sum(case when doc_id % 50 = 0 then 1 else 0 end) as bigint) as bad from documents where text is not null group by lang")
def jsonl_zst_round_trip(spark, d):
    """Documents as Zstandard JSON lines by language and back, some lines spoiled on the way."""
    path = fresh(spark, "jsonl")
    docs = table(spark, d, "documents").where("text is not null")
    readers.write_jsonl_zst(docs.select("lang", "doc_id", "n_chars", "text"), path, ["lang"])
    back = readers.jsonl_zst(spark, path, "doc_id long, n_chars long, text string", "*")
    lang = docs.select("doc_id", "lang")
    kept = readers.parseable(back).join(lang, "doc_id").groupBy(F.col("lang").alias("tier")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("doc_id") % 50 == 0).alias("bad"))
    return kept


@query("select count(*) as lines, cast(sum(case when doc_id % 50 = 0 then 1 else 0 end) as bigint) as unparseable, cast(sum(case when doc_id % 50 = 0 then 0 else 1 end) as bigint) as filled from documents")
def unparseable_lines(spark, d):
    """Every fiftieth line is cut short; the reader keeps and counts it."""
    path = fresh(spark, "lines")
    line = F.to_json(F.struct("doc_id", "lang"))
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 50 == 0, F.substring(line, 1, 5)).otherwise(line).alias("value")).write.text(path)
    return readers.skipped(readers.jsonl(spark, path, "doc_id long, lang string"))


@query("select source, count(*) as n, cast(0.0 as double) as dup_frac, cast(14 as integer) as region_id, cast(15 as integer) as century_id from documents group by source")
def shard_defaults(spark, d):
    path = fresh(spark, "shards")
    table(spark, d, "documents").select("doc_id", "source").write.parquet(path)
    return readers.shards(spark, path).groupBy("source", "dup_frac", "region_id", "century_id").agg(F.count("*").alias("n")).select("source", "n", "dup_frac", "region_id", "century_id")


@query('select lang, doc_id, n_chars as length, cast(coalesce(sum(n_chars) over (order by lang, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from documents')
def plane_store(spark, d):
    path = fresh(spark, "store")
    readers.write_shards(table(spark, d, "documents").select("lang", "doc_id", F.col("n_chars").cast("long").alias("length")), path, ["lang", "doc_id"])
    return spark.read.parquet(f"{path}/rows")


@query("select doc_id, source, n_chars from documents where source not in ('src1', 'src4')")
def rewritten_store(spark, d):
    path = fresh(spark, "train")
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    docs.write.parquet(path)
    return readers.rewritten(selection.without_sources(spark.read.parquet(path), ["src1", "src4"]), path, 2)


@query("select doc_id, lang from documents")
def tsv_round_trip(spark, d):
    path = fresh(spark, "tsv")
    readers.write_tsv(table(spark, d, "documents").select("doc_id", "lang"), path)
    return spark.read.schema("doc_id long, lang string").option("sep", "\t").option("header", True).csv(path)


@query("select cast(a.doc_id as varchar) as id, 1000 + a.doc_id as tm from documents a where a.doc_id % 3 = 0")
def two_hop_lookup(spark, d):
    docs = table(spark, d, "documents")
    names = lambda folder: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.lit(".xml"))
    a = docs.where("doc_id % 3 = 0").select(names("x/y/").alias("file"), (F.col("doc_id") + 1000).alias("tm"))
    b = docs.select(F.col("doc_id").cast("string").alias("id"), names("").alias("file"))
    return readers.id_lookup(a, b)


@query("""select * from (select cast(doc_id as varchar) as id, source, 'lang-' || lang as tier from (select *, row_number() over (partition by lang, source order by cast(doc_id as varchar)) as r from documents where lang in ('en', 'fr')) where r <= 3)
 union all select 'probe' || item_id, 'planted', 'probe' from benchmark""")
def mini_corpus(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", "lang")
    probes = table(spark, d, "benchmark").select(F.concat(F.lit("probe"), "item_id").alias("id"), F.lit("planted").alias("source"), F.lit("probe").alias("tier"))
    return selection.mini_corpus({f"lang-{x}": docs.where(F.col("lang") == x) for x in ("en", "fr")}, 3, probes)


# --- zones and filters

_LAST = "right(trim(cast(doc_id as varchar)), 1)"


@query(f"select doc_id, cast(case when source in ('src1', 'src2') then case {_LAST} when '3' then 10 when '4' then 11 else 12 end when lang = 'en' then -1 else 12 end as integer) as zone, case {_LAST} when '6' then 'val' when '5' then 'test' else 'train' end as split from documents")
def record_zones(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", selection.record_zone(F.col("source"), F.col("lang"), F.col("doc_id"), ("src1", "src2"), "en").alias("zone"), selection.digit_split(F.col("doc_id"), "5", "6").alias("split"))


_BASE = "split_part(split_part(rid, '#', 1), '_', 1)"


@query(f"""with d as (select doc_id, source, lang, source || '/' || doc_id || case when doc_id % 2 = 0 then '_a' else '' end || '#1' as rid from documents),
 n as (select source || '/' || doc_id as id, cast(doc_id * 7 as varchar) as number from documents where doc_id % 4 < 2),
 b as (select doc_id as bid, cast(doc_id % 10 as integer) as zone from documents where lang = 'en' and doc_id % 3 <> 0),
 s as (select source as prefix, cast(min(doc_id % 10) as integer) as zone from documents where lang = 'en' group by 1 having min(doc_id % 10) < 5),
 j as (select doc_id, source in ('src1', 'src2') as listed, n.number, {seed(_BASE, 0)} as h, b.zone as bucket, s.zone as sibling from d left join n on n.id = {_BASE} left join b on bid = doc_id left join s on s.prefix = source)
 select rid_.doc_id, cast(case when listed then case right(coalesce(number, cast(h as varchar)), 1) when '3' then 10 when '4' then 11 else 12 end else coalesce(bucket, sibling, 12) end as integer) as zone,
 case when listed and number is not null then 'number' when listed then 'hash' when bucket is not null then 'bucket' when sibling is not null then 'sibling' else 'train' end as rule from j rid_""")
def canonical_zones(spark, d):
    docs = table(spark, d, "documents")
    rid = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "_a").otherwise(""), F.lit("#1"))
    keyed = docs.select("doc_id", rid.alias("rid"), "source", F.col("lang").alias("tier"), F.col("source").alias("prefix"))
    numbers = docs.where("doc_id % 4 < 2").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("id"), (F.col("doc_id") * 7).alias("number"))
    en = docs.where("lang = 'en'")
    buckets = en.where("doc_id % 3 <> 0").select(F.col("doc_id"), (F.col("doc_id") % 10).cast("int").alias("zone"))
    siblings = en.groupBy(F.col("source").alias("prefix")).agg(F.min(F.col("doc_id") % 10).cast("int").alias("zone")).where("zone < 5")
    ids = keyed.select("doc_id", F.col("rid"))
    out = selection.canonical_zones(keyed.drop("doc_id").withColumnRenamed("rid", "doc_id"), numbers, buckets.join(ids, "doc_id").select(F.col("rid").alias("doc_id"), "zone"), siblings, ("src1", "src2"))
    return out.join(ids.withColumnRenamed("doc_id", "k"), F.col("rid") == F.col("doc_id")).select(F.col("k").alias("doc_id"), "zone", "rule")


@query("select source, arg_max(doc_id % 10, doc_id) as zone, count(distinct doc_id % 10) > 1 as conflict from documents where doc_id % 11 < 3 group by source")
def prefix_zones(spark, d):
    return selection.prefix_zones(table(spark, d, "documents").where("doc_id % 11 < 3").select("source", "doc_id", (F.col("doc_id") % 10).alias("zone")), "source", "doc_id")


@query(r"select doc_id, case when a + b = 0 then null else round(a / (a + b), 6) end as share, a >= 0.95 * (a + b) and a + b > 0 as kept, length(text) between 200 and 4000 as fits from (select doc_id, text, length(regexp_replace(text, '[^a-zA-Z]+', '', 'g')) as a, length(regexp_replace(text, '[^à-öø-ÿÀ-ÖØ-Þß]+', '', 'g')) as b from documents)")
def script_share(spark, d):
    share = selection.script_share(F.col("text"), "a-zA-Z", "à-öø-ÿÀ-ÖØ-Þß")
    return table(spark, d, "documents").select("doc_id", F.round(share, 6).alias("share"), F.coalesce(share >= 0.95, F.lit(False)).alias("kept"), selection.length_between(F.col("text"), 200, 4000).alias("fits"))


_ORDINAL = "(select doc_id, lang, n_chars, row_number() over (order by doc_id) - 1 as ordinal, (n_chars % 100) / 100.0 as clean, (doc_id % 13) / 13.0 as dup_frac from documents)"


@query(f"select doc_id, ordinal from {_ORDINAL} where clean >= 0.3 and dup_frac < 0.5 and lang = 'en' and ordinal % 200 <> 0")
def eligible_records(spark, d):
    rows = selection.numbered(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"])
    rows = rows.withColumn("clean", (F.col("n_chars") % 100) / 100.0).withColumn("dup_frac", (F.col("doc_id") % 13) / 13.0)
    return selection.eligible(rows, 0.3, 0.5, "en", tier_col="lang").select("doc_id", "ordinal")


@query(f"select doc_id, cast(ordinal % 4 as integer) as shard, ordinal % 25 = 0 as sampled from {_ORDINAL} where ordinal % 4 = 1")
def stride_shard(spark, d):
    rows = selection.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return selection.rank_shard(rows, 1, 4).select("doc_id", F.lit(1).alias("shard"), (F.col("ordinal") % 25 == 0).alias("sampled"))


@query("select page_id from pages where not starts_with(url, 'http://www.a') and not starts_with(url, 'https://www.s') and page_id not in (select page_id from pages where page_id % 5 = 0 and regexp_matches(url, '(?i)[aeiou]{2}'))")
def listed_pages(spark, d):
    """Without prefixes of a list, nor ids flagged by a catalogue."""
    pages = table(spark, d, "pages").select("page_id", "url")
    flags = selection.catalogue_flags(pages.select(F.col("page_id").cast("string").alias("id"), F.lit("none").alias("corpus"), "url"), ["other"], {"url": "[AEIOU]{2}"})
    left = selection.without_prefixes(pages, "url", ["http://www.a", "https://www.s"]).withColumn("id", F.concat_ws(":", "page_id", "url"))
    return selection.without_flagged(left, flags.where("flagged and cast(id as bigint) % 5 = 0").select("id")).select("page_id")


@query("select conv_id, turn from conversations where not (conv_id % 7 = 1 and turn = 2) and conv_id % 11 <> 3")
def listed_turns(spark, d):
    """Without the (conversation, turn) pairs of a list, and whole conversations where it names no turn."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    pairs = c.where("conv_id % 7 = 1 and turn = 2").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"))
    whole = c.where("conv_id % 11 = 3").select(F.col("conv_id").cast("string").alias("conv_id"), F.lit(None).cast("string").alias("turn")).distinct()
    return selection.without_listed(c, pairs.unionByName(whole), "conv_id", "turn")


_GAPS = f"""(select doc_id, t, gap, cast(4 + {seed("cast(doc_id as varchar) || '-' || cast(gap as varchar)", 7)} % (length(t) - gap - 8) as integer) as start from
 (select doc_id, t, unnest([1, 3, 5, 10]) as gap from (select doc_id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') as t from documents) where length(t) between 50 and 767) where length(t) > gap + 8)"""


@query(f"""select doc_id, cast(gap as integer) as gap, start, gold from (select *, row_number() over (partition by gap order by {seed('doc_id', 7)}, doc_id) as r from (select *, substr(t, start + 1, gap) as gold, substr(t, start, 1) as b, substr(t, start + gap + 1, 1) as a from {_GAPS})
 where not contains(gold, '-') and not contains(gold, '  ') and trim(gold) <> '' and not (b = ' ' and starts_with(gold, ' ')) and not (a = ' ' and ends_with(gold, ' '))) where r <= 40""")
def scorable_gaps(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^a-zA-Z ]", "").alias("text"))
    return selection.gap_samples(docs, [1, 3, 5, 10], 40)


# --- joins, groups, windows


@query("select lang as tier, 'x' || source as source, n, forbidden, cast(sampled as bigint) as sampled from (select lang, source, count(*) as n, bool_or(lang = 'en' and source = 'src2' or lang = 'fr' and source = 'src3') as forbidden, count(*) filter (where false) as sampled from documents group by 1, 2)")
def source_census(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("tier"), "source", F.col("doc_id").cast("string").alias("id"), "text")
    out = folds.census(docs.withColumn("text", F.coalesce("text", F.lit(""))), [("en", "src2"), ("fr", "src3")], 25)
    return out.select("tier", F.concat(F.lit("x"), "source").alias("source"), "n", "forbidden", F.lit(0).cast("long").alias("sampled"))


_RUNS_ = "(select 'run' || (doc_id % 9) as run, doc_id as step, n_chars / 1000.0 as bits, (n_chars % 97) / 97.0 as cer from documents)"


def _runs(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("run"), F.col("doc_id") % 9).alias("run"), F.col("doc_id").alias("step"), (F.col("n_chars") / 1000.0).alias("bits"), ((F.col("n_chars") % 97) / 97.0).alias("cer"))


@query(f"select run, n, round(mean, 6) as mean, round(sd_pop, 6) as sd_pop, round(sd, 6) as sd, rank() over (order by mean desc) as rank from (select run, count(*) as n, avg(bits) as mean, stddev_pop(bits) as sd_pop, coalesce(stddev_samp(bits), 0) as sd from {_RUNS_} group by run)")
def run_means(spark, d):
    r = reports.mean_sd(_runs(spark, d), "run", "bits")
    return r.select("run", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd_pop", "sd")), F.col("rank").cast("long").alias("rank"))


@query(f"select run, max(step) as step, arg_max(bits, step) as bits, arg_max(cer, step) as cer from {_RUNS_} group by run")
def last_runs(spark, d):
    return reports.last_per_run(_runs(spark, d), "run", "step", "bits", "cer")


@query(f"select run, best, last, case when best <= last then 'best' else 'last' end as choice from (select run, arg_max(cer, step) as last, first(cer order by bits, step) as best from {_RUNS_} group by run)")
def checkpoint_choice(spark, d):
    return reports.checkpoint_choice(_runs(spark, d), "run", "step", "bits", "cer")


@query(f"select run, count(*) as n, count(*) >= 8 and min(bits) filter (where back <= 4) > min(bits) filter (where back between 5 and 8) - 0.002 as stalled from (select *, row_number() over (partition by run order by step desc) as back from {_RUNS_}) group by run")
def stalled_runs(spark, d):
    return reports.stalled(_runs(spark, d), "run", "step", "bits")


@query("select lang, n, round((select count(*) from documents) / ((select count(distinct lang) from documents) * n), 6) as weight from (select lang, count(*) as n from documents group by lang)")
def class_weights(spark, d):
    return reports.class_weights(table(spark, d, "documents"), "lang").select("lang", "n", F.round("weight", 6).alias("weight"))


@query("select distinct source from documents where source is not null")
def label_set(spark, d):
    return reports.label_set(table(spark, d, "documents"), "source")


@query("select source, arg_max(lang_id, best * 1000 - lang_id) as best_setting, max(best) as best, count(*) as n from (select source, case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end as lang_id, cast(max(n_chars) as bigint) as best from documents group by 1, 2) group by source")
def setting_sweep(spark, d):
    rows = table(spark, d, "documents").groupBy("source", F.expr("case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end").alias("lang_id")).agg(F.max("n_chars").cast("long").alias("v"))
    return reports.sweep(rows, "source", "lang_id", "v")


@query("""with m as (select source, avg(n_chars) as mean, count(*) as n from documents group by source)
 select (select first(source order by mean desc, source desc) from m where source not in ('src0', 'src1') and n >= 8) as strongest, round((select mean from m where source = 'src0') - (select max(mean) from m where source not in ('src0', 'src1') and n >= 8), 6) as margin""")
def strongest_margin(spark, d):
    return reports.margin(table(spark, d, "documents"), "source", "n_chars", "src0", ["src1"], 8).select("strongest", F.round("margin", 6).alias("margin"))


@query("select lang, cast(sum(n) as bigint) as n, round(sum(m * n) / sum(n), 6) as m from (select lang, source, count(*) as n, avg(n_chars) as m from documents group by 1, 2) group by lang")
def merged_shards(spark, d):
    per = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    return reports.merged_shards(per, "lang", ["m"]).select("lang", "n", F.round("m", 6).alias("m"))


@query("""with p as (select source, lang, avg(n_chars) as v from documents group by 1, 2), j as (select a.source, a.v - b.v as d from p a join p b on a.source = b.source and a.lang = 'en' and b.lang = 'fr')
 select count(*) as n, round(avg(d), 5) as mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) as t, round(avg(d) / stddev_samp(d), 5) as d_z from j""")
def paired_sources(spark, d):
    per = table(spark, d, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("v"))
    pairs = reports.paired(per.where("lang = 'en'"), per.where("lang = 'fr'"), ["source"], "v")
    return reports.significance(pairs.withColumn("all", F.lit(1)), "all").select("n", *(F.round(c, 5).alias(c) for c in ("mean", "t", "d_z")))


@query("select lang, cast(sum(n_chars) as bigint) as chars, round(sum(length(source) * 1.5) / ln(2) / sum(n_chars), 9) as bits from documents group by lang")
def bits_per_char(spark, d):
    rows = table(spark, d, "documents").select("lang", "n_chars", (F.length("source") * 1.5).alias("nll"))
    return reports.bits_per_char(rows, "nll", "n_chars", "lang").select("lang", "chars", F.round("bits", 9).alias("bits"))


@query("select source, cast(a as bigint) as a, cast(b as bigint) as b, round((a / n - b / m) / sqrt((a + b) / (n + m) * (1 - (a + b) / (n + m)) * (1 / n + 1 / m)), 6) as z from (select source, sum(quality) as a, count(*) as n, sum(1 - toxic) as b, count(*) + 1 as m from documents join labels using (doc_id) group by source) where a + b > 0 and a + b < n + m")
def two_shares(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("a"), F.count("*").alias("n"), F.sum(1 - F.col("toxic")).alias("b"), (F.count("*") + 1).alias("m"))
    return reports.two_shares(rows.where("a + b > 0 and a + b < n + m"), "a", "n", "b", "m").select("source", "a", "b", F.round("z", 6).alias("z"))


@query("select doc_id, lang, cast(row_number() over (partition by lang order by n_chars desc, doc_id) as integer) as rank from documents qualify row_number() over (partition by lang order by n_chars desc, doc_id) <= 20")
def beam_of_texts(spark, d):
    return reports.beam(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id").select("doc_id", "lang", "rank")


@query("select source, cast(width as integer) as width, cast(score as double) as score from (select source, doc_id % 6 + 1 as width, cast(max(n_chars) as double) as score from documents group by 1, 2) qualify row_number() over (partition by source order by score / width desc, width) = 1")
def width_sweep(spark, d):
    rows = table(spark, d, "documents").groupBy("source", (F.col("doc_id") % 6 + 1).cast("int").alias("width")).agg(F.max("n_chars").cast("double").alias("score"))
    return reports.width_sweep(rows, "source", "width", "score")


@query("select lang as tier, doc_id, cast(case lang when 'en' then 0 when 'fr' then 1 else 2 end as integer) as tier_rank from documents where lang in ('en', 'fr', 'de')")
def tier_union(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return selection.union_tiers([(x, docs.where(F.col("lang") == x).select("doc_id")) for x in ("en", "fr", "de")]).select("tier", "doc_id", "tier_rank")


@query("select n_chars, count(*) as n from documents group by n_chars having count(*) > 1")
def repeated_ids(spark, d):
    return selection.repeated_ids(table(spark, d, "documents"), "n_chars")


@query("""with s as (select lang as tier, count(*) as size, cast(round(60 * case lang when 'en' then 5 when 'fr' then 3 else 2 end / 10.0) as bigint) as want from documents where lang in ('en', 'fr', 'de') group by 1),
 p as (select tier, size, want, unnest(range(cast(ceil(want / size) as bigint))) as pass from s)
 select tier, pass, count(*) as n from (select p.tier, pass, size, want, row_number() over (partition by p.tier, pass order by doc_id) as r from p join documents on lang = p.tier) where r + pass * size <= want group by 1, 2""")
def tier_mix(spark, d):
    """How many rows of each tier a mix of 60 takes, by pass."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("tier"))
    return selection.tier_mix(docs, {"en": 0.5, "fr": 0.3, "de": 0.2}, 60).groupBy("tier", "pass").agg(F.count("*").alias("n"))


@query("with m as (select lang as tier, case lang when 'en' then 0.5 when 'fr' then 0.3 else 0.2 end / avg(n_chars) as w from documents where lang in ('en', 'fr', 'de') group by 1) select tier, round(w / (select sum(w) from m), 9) as weight from m")
def tier_weights(spark, d):
    docs = table(spark, d, "documents").select("n_chars", F.col("lang").alias("tier"))
    return selection.record_weights(docs, {"en": 0.5, "fr": 0.3, "de": 0.2}).select("tier", F.round("weight", 9).alias("weight"))


def _u(name: str) -> str:
    return f"(cast('0x' || substr(md5(cast(doc_id as varchar) || ':{name}:5'), 1, 8) as bigint) / 4294967296.0)"


@query(f"select doc_id, case when {_u('lang')} < 0.3 then 'unk' else lang end as lang, case when {_u('source')} < 0.6 then 'none' else source end as source from documents")
def metadata_dropout(spark, d):
    return noise.drop_metadata(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", {"lang": (0.3, "unk"), "source": (0.6, "none")}, 5)


@query("""with recursive o as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as i from documents where n_chars <= 8192),
 r as (select source, doc_id, i, n_chars, cast(0 as bigint) as row_id, cast(0 as bigint) as "offset" from o where i = 1
 union all select o.source, o.doc_id, o.i, o.n_chars, case when r."offset" + r.n_chars + o.n_chars > 8192 then r.row_id + 1 else r.row_id end, case when r."offset" + r.n_chars + o.n_chars > 8192 then 0 else r."offset" + r.n_chars end from r join o on o.source = r.source and o.i = r.i + 1)
 select source, doc_id, row_id, "offset" from r""")
def packed_rows(spark, d):
    return sampling.greedy_packing(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 8192)


@query("select source, count(*) filter (where n_chars > 8192) as skipped from documents group by source")
def oversize_rows(spark, d):
    return sampling.oversize(table(spark, d, "documents"), "source", "n_chars", 8192)


# --- text

_CHUNKS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')"


@query(rf"select conv_id, turn, cast(len(flatten(list_transform({_CHUNKS}, lambda x: case when regexp_full_match(x, '.+?[.;!?,·:]+') then list_concat([regexp_extract(x, '^(.+?)([.;!?,·:]+)$', 1)], string_split(regexp_extract(x, '^(.+?)([.;!?,·:]+)$', 2), '')) else [x] end))) as bigint) as n_tokens from (select conv_id, turn, regexp_replace(text, '[^ -~\n]', 'x', 'g') as text from conversations)")
def rough_tokens(spark, d):
    t = table(spark, d, "conversations").withColumn("text", F.regexp_replace("text", r"[^ -~\n]", "x"))
    return t.select("conv_id", "turn", F.size(T.rough_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("select event_id, cast(case when event_id % 13 between 1 and 10 then event_id % 13 end as integer) as missing, cast(case when event_id % 7 = 0 then null else 2 * (event_id % 4) + 1 - greatest(0, event_id % 4 - event_id % 7 + 1) end as integer) as n_widths from events")
def gap_markers(spark, d):
    """Markers of lost letters, and of gaps of uncertain width, in texts made from numbers."""
    e = table(spark, d, "events").select("event_id")
    a = F.concat(F.lit("x ["), F.col("event_id") % 13, F.lit(" letters missing] y"))
    b = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("λόγ["), F.col("event_id") % 7, F.lit("±"), F.col("event_id") % 4, F.lit("]καὶ"))).otherwise("λόγ")
    return e.select("event_id", T.letters_missing(a).alias("missing"), F.size(T.gap_widths(b)).alias("n_widths")).withColumn("n_widths", F.when(F.col("n_widths") >= 0, F.col("n_widths")))


@query("select c_custkey, cast(case c_custkey % 4 when 0 then 2 when 1 then 11 else 14 end as integer) as region from customer")
def region_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.region_id(F.expr("case c_custkey % 4 when 0 then 'Attica' when 1 then 'Cyprus' when 2 then 'elsewhere' end")).alias("region"))


_FLATSQL = "trim(regexp_replace(regexp_replace(translate(strip_accents(lower(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'αβγδεφγηιικλμνοπκρστυβωξυζ'))), 'ς', 'σ'), '[^α-ω -]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"select doc_id, length({_FLATSQL}) as n, md5({_FLATSQL}) as flat_md5 from documents")
def flat_text(spark, d):
    t = T.flat(F.expr("translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'αβγδεφγηιικλμνοπκρστυβωξυζ')"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("flat_md5"))


@query("select doc_id, seg, cast(length(s) as bigint) as n from (select doc_id, trim(unnest(p)) as s, cast(generate_subscripts(p, 1) - 1 as integer) as seg from (select doc_id, regexp_split_to_array(translate(text, 'qz', '--'), '-+|…+') as p from documents)) where length(s) >= 32")
def lacuna_segments(spark, d):
    t = F.translate("text", "qz", "--")
    rows = table(spark, d, "documents").select("doc_id", F.explode(P.gap_split(t, 32)).alias("x"))
    return rows.select("doc_id", F.col("x.seg").alias("seg"), F.length("x.text").cast("long").alias("n"))


_PIECES = r"list_filter(regexp_extract_all(text, '(?s).*?(?:[.;!?:··;]+|\n\s*\n|\z)'), lambda x: x <> '')"


@query(f"""with p as (select doc_id, unnest({_PIECES}) as p, generate_subscripts({_PIECES}, 1) as i from documents),
 o as (select doc_id, i, p, {skel('p')} as s, sum(length(p)) over (partition by doc_id order by i) as e, sum(length(p)) over (partition by doc_id) as total from p),
 f as (select doc_id, s, total, e - length(p) as b, row_number() over (partition by doc_id order by i) as k from o where s <> '')
 select doc_id, cast(k - 1 as integer) as i, cast(case when k = 1 then 0 else b end as integer) as start, cast(coalesce(lead(b) over (partition by doc_id order by k), total) as integer) as "end", md5(s) as skel_md5 from f
 union all select doc_id, 0, 0, cast(max(total) as integer), md5('') from o group by doc_id having count(*) filter (where s <> '') = 0""")
def sentence_spans(spark, d):
    rows = folds.with_sentences(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode("sentences").alias("i", "s"))
    return rows.select("doc_id", "i", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.md5("s.skel").alias("skel_md5"))


# --- the split, whole

_TIER = "case lang when 'en' then 'pristine' when 'fr' then 'repaired' else 'bronze' end"
_ZONE = "cast(case when lang = 'en' then doc_id % 12 when doc_id % 5 = 0 then 10 else 12 end as integer)"


def _records(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.expr(_TIER).alias("tier"), F.expr(_ZONE.replace("integer", "int")).alias("zone"))
    return folds.with_sentences(docs)


def _masked(spark, d):
    docs = stored(_records(spark, d), "records")
    return stored(folds.sentence_masks(docs, stored(folds.contamination_index(docs), "index")), "masks")


_WORDS = "list_filter(string_split(s, ' '), lambda w: w <> '')"
_SENT = f"""z as (select doc_id, source, text, {_TIER} as tier, {_ZONE} as zone from documents),
 p as (select doc_id, unnest({_PIECES}) as p, generate_subscripts({_PIECES}, 1) as i from documents),
 o as (select doc_id, i, p, {skel('p')} as s, sum(length(p)) over (partition by doc_id order by i) as e, sum(length(p)) over (partition by doc_id) as total from p),
 f as (select doc_id, s, total, e - length(p) as b, row_number() over (partition by doc_id order by i) - 1 as k from o where s <> ''),
 sn as (select doc_id, k, s, case when k = 0 then 0 else b end as st, coalesce(lead(b) over (partition by doc_id order by k), total) as en from f union all select doc_id, 0, '', 0, max(total) from o group by doc_id having count(*) filter (where s <> '') = 0),
 wd as (select doc_id, k, unnest({_WORDS}) as w, generate_subscripts({_WORDS}, 1) as j from sn where s <> ''),
 ws as (select doc_id, list(w order by k, j) as w, list(k order by k, j) as ks from wd group by doc_id),
 ky as (select doc_id, 'e' || s as g, k as k0, k as k1 from sn where s <> '' union all select doc_id, 'b' || array_to_string(list_sort({_WORDS}), ' '), k, k from sn where s <> ''
 union all select doc_id, 'g' || array_to_string(w[i:i + 7], ' '), ks[i], ks[i + 7] from (select doc_id, w, ks, unnest(range(1, len(w) - 6)) as i from ws)),
 ix as (select g, bit_or(cast(1 << zone as integer)) as m from ky join z using (doc_id) where zone < 12 group by g),
 hk as (select ky.doc_id, unnest(range(k0, k1 + 1)) as k, m from ky join ix using (g)),
 mk as (select sn.doc_id, sn.k, st, en, coalesce(hm, 0) & case when zone < 12 then ~cast(1 << zone as integer) else -1 end as m from sn join z using (doc_id) left join (select doc_id, k, bit_or(m) as hm from hk group by 1, 2) h on h.doc_id = sn.doc_id and h.k = sn.k)"""


@query(f"with {_SENT} select doc_id, cast(k as integer) as i, cast(m as integer) as mask from mk")
def sentence_masks(spark, d):
    return _masked(spark, d).select("doc_id", F.posexplode("masks").alias("i", "mask"))


_FOLD = f"""{_SENT}, fr as (select z.*, cast(fold as integer) as fold, case when zone = fold or zone = 10 then 'test' when zone = (fold + 1) % 10 or zone = 11 then 'val' else 'train' end as role from z, (select unnest(range(10)) as fold)),
 fk as (select *, case when role = 'val' then (1 << fold) | 1024 else (1 << fold) | (1 << ((fold + 1) % 10)) | 1024 | 2048 end as conflict, case when role = 'val' then 25 else 100 end as least from fr where role = 'train' or tier = 'pristine'),
 dt as (select fk.doc_id, fold, role, tier, source, text, least, k, st, en, case when m & cast(conflict as integer) <> 0 then 1 else 0 end as dirty from fk join mk using (doc_id) where role <> 'test'),
 isl as (select *, sum(dirty) over (partition by doc_id, fold order by k) as island, max(dirty) over (partition by doc_id, fold) as cut from dt),
 runs as (select doc_id, fold, role, tier, source, least, island, min(st) as st, max(en) as en, any_value(text) as text from isl where cut = 1 and dirty = 0 group by 1, 2, 3, 4, 5, 6, 7),
 pcs as (select *, regexp_replace(substr(text, cast(st as integer) + 1, cast(en - st as integer)), '^\\s+|\\s+$', '', 'g') as t from runs),
 kept as (select doc_id, fold, role, tier, source, t, row_number() over (partition by doc_id, fold order by island) - 1 as i from pcs where length(t) >= least),
 outp as (select fold, role, cast(doc_id as varchar) || '#seg' || i as id, tier, source, t as text from kept
 union all select fold, role, cast(doc_id as varchar), tier, source, any_value(text) from isl where cut = 0 group by doc_id, fold, role, tier, source
 union all select fold, role, cast(doc_id as varchar), tier, source, text from fk where role = 'test')"""


@query(f"with {_FOLD} select fold, role, id, tier, source, cast(length(text) as bigint) as n, md5(text) as text_md5 from outp")
def fold_materialise(spark, d):
    """What each fold's train, validation and test hold of each record."""
    p = folds.fold_pieces(_masked(spark, d)).where("text is not null")
    return p.select("fold", "role", "id", "tier", "source", F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


@query(f"""with {_FOLD}, dr as (select fold, role, tier, doc_id, cut, sum(case when dirty = 1 then en - st else 0 end) as gone from isl group by 1, 2, 3, 4, 5),
 sh as (select fold, role, tier, doc_id, sum(case when length(t) < least then length(t) else 0 end) as short, count(*) filter (where length(t) >= least) as n from pcs group by 1, 2, 3, 4),
 st as (select fold, role, tier, cast(sum(case when cut = 1 then gone + coalesce(short, 0) else 0 end) as bigint) as cut, count(*) filter (where cut = 1 and coalesce(n, 0) = 0) as dropped from dr left join sh using (fold, role, tier, doc_id) group by 1, 2, 3),
 no as (select fold, role, tier, count(*) as dropped from fk where role <> 'test' and doc_id not in (select doc_id from sn) group by 1, 2, 3),
 ou as (select fold, role, tier, count(*) as records, cast(sum(length(text)) as bigint) as chars from outp group by 1, 2, 3)
 select fold, role, tier, coalesce(records, 0) as records, coalesce(chars, 0) as chars, coalesce(st.cut, 0) as cut, coalesce(st.dropped, 0) + coalesce(no.dropped, 0) as dropped from ou full join st using (fold, role, tier) full join no using (fold, role, tier)""")
def fold_statistics(spark, d):
    return folds.fold_statistics(folds.fold_pieces(_masked(spark, d)))


@query("select cast(fold as integer) as fold, pair, kind, cast(0 as bigint) as hits from (select unnest(range(10)) as fold), (values ('train-held'), ('val-test')) a(pair), (values ('gram'), ('sent')) b(kind)")
def fold_verify(spark, d):
    """The split checked by the second normaliser and hash; tests check that a spoiled split is found."""
    return folds.verify(folds.fold_pieces(_masked(spark, d)))


@query("select cast(0 as bigint) as shared where false")
def fold_shared_bases(spark, d):
    return folds.shared_bases(folds.fold_pieces(_masked(spark, d))).select(F.size("roles").cast("long").alias("shared"))


@query(f"""with w as (select item_id, list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as g, len(w) as n from (select item_id, {wlist()} as w from benchmark) where len(w) >= 8)
 select item_id, cast(len(g) as bigint) as n_grams, cast(n as bigint) as n_words from w""")
def signature_sizes(spark, d):
    """Records with a signature: all of eight words or more, whose coordinates are filled."""
    items = folds.with_sentences(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    sig = folds.signatures(items).where("size(array_distinct(sig)) > 0 and size(sig) = 128 and not exists(sig, x -> x is null)")
    n = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.size(F.array_distinct(T.ngrams(T.words(T.skeleton(F.col("text")))))).cast("long").alias("n_grams"))
    return sig.join(n, "doc_id").select(F.col("doc_id").alias("item_id"), "n_grams", F.col("n_words").cast("long").alias("n_words"))


@query()
def record_matches(spark, d):
    """Records whose signature is like that of a record of another zone."""
    sig = stored(folds.signatures(_records(spark, d), keep=("zone",)), "signatures")
    return folds.record_matches(sig, sig.where("zone < 12").withColumn("bit", F.expr("shiftleft(1, zone)")))


@query(f"with k as (select distinct g from {grams('documents', 'doc_id')}) select (select count(distinct g) from {grams('benchmark', 'item_id')}) as n_grams, (select count(*) from k where g in (select g from {grams('benchmark', 'item_id')})) as found")
def index_recall(spark, d):
    """Of the n-grams of held-out items, how many an index of all documents has."""
    held = folds.with_sentences(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    docs = folds.with_sentences(table(spark, d, "documents").select("doc_id", "text"))
    a = held.select(F.explode(F.array_distinct(T.gram_hashes(F.flatten(F.transform("sentences", lambda s: T.words(s["skel"])))))).alias("key")).distinct()
    b = docs.select(F.explode(T.gram_hashes(F.flatten(F.transform("sentences", lambda s: T.words(s["skel"]))))).alias("key")).distinct()
    return a.join(b.withColumn("x", F.lit(1)), "key", "left").agg(F.count("*").alias("n_grams"), F.count("x").alias("found"))


@query(f"select doc_id as a_id, b, n from (select a.doc_id, b.doc_id as b, count(*) as n from (select distinct doc_id, g from {grams('documents', 'doc_id')} where doc_id % 10 = 3) a join (select distinct doc_id, g from {grams('documents', 'doc_id')} where doc_id % 10 = 4) b using (g) group by 1, 2) where n >= 5")
def split_gram_pairs(spark, d):
    """Pairs of a test and a validation record that share five n-grams."""
    g = stored(table(spark, d, "documents").where("doc_id % 10 in (3, 4)").select("doc_id", F.explode(F.array_distinct(T.gram_hashes(T.words(T.skeleton(F.col("text")))))).alias("h")), "grams")
    a, b = g.where("doc_id % 10 = 3").withColumnRenamed("doc_id", "a_id"), g.where("doc_id % 10 = 4").withColumnRenamed("doc_id", "b")
    return a.join(b, "h").groupBy("a_id", "b").agg(F.count("*").alias("n")).where("n >= 5")


@query("select source, first as a, doc_id as b from (select source, doc_id, min(doc_id) over (partition by source) as first from documents) where doc_id <> first")
def prefix_edges(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return dedup.prefix_edges(docs, "source").join(docs.withColumnRenamed("doc_id", "b"), "b").select("source", "a", "b")


# --- letters, marks, treebanks

_GREEK = "translate({0}, 'abcdefghijklmnopqrstuvwxyzßæœ', 'αβγδεφγηιικλμνοπκρστυβωξυζσεε')"
_GREEKSQL = _GREEK.format("strip_accents(lower(text))")


def _greek(spark, d, *keep):
    return bounded(table(spark, d, "documents")).select("doc_id", *keep, F.translate(T.fold(F.col("text")), "abcdefghijklmnopqrstuvwxyzßæœ", "αβγδεφγηιικλμνοπκρστυβωξυζσεε").alias("t"))


@query(f"select doc_id, cast(length(regexp_replace(t, '[^α]', '', 'g')) as bigint) as n_long, cast(length(regexp_replace(t, '[^ι]', '', 'g')) as bigint) as n_short, md5(t) as plain_md5 from (select doc_id, replace(replace({_GREEKSQL}, '_', ''), '^', '') as t from documents)")
def length_labels(spark, d):
    """Texts with a mark behind every alpha and iota, read back into plain text and labels."""
    t = F.regexp_replace("t", "[_^]", "")
    m = _greek(spark, d).select("doc_id", marks.length_labels(F.regexp_replace(F.regexp_replace(t, "α", "α_"), "ι", "ι^")).alias("x"))
    count = lambda c: F.size(F.filter(F.map_values("x.labels"), lambda v: v == c)).cast("long")
    return m.select("doc_id", count(marks.LONG).alias("n_long"), count(marks.SHORT).alias("n_short"), F.md5("x.plain").alias("plain_md5"))


_GW = f"regexp_extract_all({_GREEKSQL}, '[α-ω]+')"


@query(f"select doc_id, cast(len(list_filter(w[1:len(w) - 1], lambda x: length(x) % 2 = 0)) as bigint) as heavy, cast(len(list_filter(w[1:len(w) - 1], lambda x: length(x) % 2 = 1)) as bigint) as light, cast(1 as bigint) as verse from (select doc_id, {_GW} as w from documents) where len(w) > 0")
def scansion_labels(spark, d):
    """Words as syllables, heavy if they have an even number of letters."""
    words = F.regexp_extract_all("t", F.lit("[α-ω]+"), F.lit(0))
    line = F.array_join(F.transform(words, lambda w: F.when(F.length(w) % 2 == 0, F.concat(F.lit("["), w, F.lit("]"))).otherwise(F.concat(F.lit("{"), w, F.lit("}")))), " ")
    m = _greek(spark, d).select("doc_id", F.explode(F.array(marks.scansion_labels(line))).alias("x")).where("x is not null")  # a plain column would be computed for the filter too
    count = lambda c: F.size(F.filter(F.map_values("x.labels"), lambda v: v == c)).cast("long")
    return m.select("doc_id", count(marks.HEAVY).alias("heavy"), count(marks.LIGHT).alias("light"), count(marks.VERSE).alias("verse"))


@query(f"select lang, count(*) as n, round(avg(case when a % 3 = 0 then 1 else 0 end), 6) as raw, round(avg(case when g = 1 then 1 else 0 end), 6) as trivial, count(*) filter (where a % 3 = 1) as unpredicted from (select lang, doc_id as a, doc_id % 2 as g from documents) group by lang")
def default_scores(spark, d):
    pairs = table(spark, d, "documents").select("lang", (F.col("doc_id") % 2).alias("g"), F.expr("case doc_id % 3 when 0 then doc_id % 2 when 2 then 1 - doc_id % 2 end").alias("p"))
    return marks.default_report(pairs, "lang").select("lang", "n", F.round("raw", 6).alias("raw"), F.round("trivial", 6).alias("trivial"), "unpredicted")


@query("""with p as (select lang, cast(doc_id % 4 as integer) as g, cast((doc_id // 4) % 4 as integer) as p from documents), r as (select lang, g, count(*) as n, count(*) filter (where g = p) as k from p group by 1, 2), b as (select lang, avg(k / n) as bal from r group by lang)
 select lang, count(*) as n, round(avg((g = p)::int), 6) as acc, round(any_value(bal), 6) as bal_acc, round(2 * count(*) filter (where g > 0 and p > 0) / (count(*) filter (where g > 0) + count(*) filter (where p > 0)), 6) as boundary_f1, round(count(*) filter (where g in (1, 2) and g = p) / count(*) filter (where g in (1, 2) and p in (1, 2)), 6) as weight_acc from p join b using (lang) group by lang""")
def scansion_scores(spark, d):
    pairs = table(spark, d, "documents").select("lang", (F.col("doc_id") % 4).alias("g"), (F.floor(F.col("doc_id") / 4) % 4).alias("p"))
    s = marks.scansion_scores(pairs, "lang")
    return s.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("acc", "bal_acc", "boundary_f1", "weight_acc")))


_XPOS = "substr('nvadr', cast(doc_id % 5 + 1 as integer), 1) || '-' || substr('spd', cast(doc_id % 3 + 1 as integer), 1) || '---' || substr('mfn-', cast(doc_id % 4 + 1 as integer), 1) || substr('nga', cast(doc_id % 3 + 1 as integer), 1) || '-'"


@query("""select doc_id, case doc_id % 5 when 0 then 'NOUN' when 1 then 'VERB' when 2 then 'ADJ' when 3 then 'ADV' else 'ADP' end as upos,
 'Case=' || case doc_id % 3 when 0 then 'Nom' when 1 then 'Gen' else 'Acc' end || case doc_id % 4 when 0 then '|Gender=Masc' when 1 then '|Gender=Fem' when 2 then '|Gender=Neut' else '' end || '|Number=' || case doc_id % 3 when 0 then 'Sing' when 1 then 'Plur' else 'Dual' end as feats from documents""")
def tag_features(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(_XPOS.replace("integer", "int")).alias("x"))
    return t.select("doc_id", ud.upos(F.col("x")).alias("upos"), ud.feature_string(ud.features(F.col("x"))).alias("feats"))


_TOKENS = "select conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' +'), lambda x: x <> '') as w from conversations"


@query(f"""with t as ({_TOKENS}), k as (select conv_id, turn, unnest(range(1, len(w) + 1)) as i from t where len(w) > 1), s as (select count(distinct conv_id * 1000 + turn) as n from k),
 m(measure, a, b, c) as (select 'Tokens', count(*), count(*), count(*) from k union all select 'Words', count(*), count(*), count(*) from k union all select 'Sentences', n, n, n from s
 union all select 'UPOS', count(*), count(*), count(*) filter (where i % 3 <> 0) from k union all select 'XPOS', count(*), count(*), count(*) from k union all select 'UFeats', count(*), count(*), count(*) from k
 union all select 'AllTags', count(*), count(*), count(*) filter (where i % 3 <> 0) from k union all select 'Lemmas', count(*), count(*), count(*) filter (where i % 5 <> 0) from k
 union all select 'UAS', count(*), count(*), count(*) from k union all select 'LAS', count(*), count(*), count(*) filter (where i = 1 or i % 4 <> 0) from k
 union all select 'CLAS', count(*), count(*), count(*) filter (where i = 1 or i % 4 <> 0) from k union all select 'MLAS', count(*), count(*), count(*) filter (where (i = 1 or i % 4 <> 0) and i % 3 <> 0) from k
 union all select 'BLEX', count(*), count(*), count(*) filter (where (i = 1 or i % 4 <> 0) and i % 5 <> 0) from k)
 select measure, a as gold, b as system, c as correct, round(2 * c / (a + b), 6) as f1 from m""")
def treebank_scores(spark, d):
    """Turns as sentences under their first word; the other side has some tags, lemmas and relations changed."""
    words = F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " +"), lambda x: x != "")
    t = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w")).where("size(w) > 1")

    def side(changed: bool):
        def line(w, i):
            i = i + 1
            if_ = lambda test, a, b: F.when(test, a).otherwise(b) if changed else F.lit(b)
            lemma = F.when((i % 5 == 0) & F.lit(changed), F.lit("other")).otherwise(F.lower(w))
            return F.concat_ws("\t", i.cast("string"), w, F.concat(lemma, F.lit("x")), if_(i % 3 == 0, "NOUN", "VERB"), F.lit("v"), F.lit("_"), F.when(i == 1, "0").otherwise("1"), F.when(i == 1, "root").otherwise(if_(i % 4 == 0, "obj", "obl")), F.lit("_"), F.lit("_"))

        text = F.concat(F.array_join(F.transform("w", line), "\n"), F.lit("\n\n"))
        return t.select(F.concat_ws("-", "conv_id", "turn").alias("doc"), text.alias("text"))

    s = conll.treebank_scores(side(False), side(True))
    return s.select("measure", "gold", "system", "correct", F.round("f1", 6).alias("f1"))


_BITS = " + ".join(f"(doc_id >> {k}) % 2" for k in range(5))


@query(f"select doc_id, 'hex' as metre, true as applied, cast(6 + {_BITS} as bigint) as heavy, cast(2 * (5 - ({_BITS})) as bigint) as light, cast(1 as bigint) as verse from documents")
def verse_readings(spark, d):
    """Hexameters whose feet follow the bits of an id, two letters a syllable, read without being told the metre."""
    feet = F.concat(*[F.when(F.shiftright("doc_id", k) % 2 == 0, "HLL").otherwise("HH") for k in range(5)], F.lit("H"))
    sure = lambda k: F.array(*[F.lit(0.0 if i == k else -9.0) for i in range(4)])
    rows = F.transform(F.filter(F.split(feet, ""), lambda c: c != ""), lambda c: F.array(sure(0), F.when(c == "H", sure(1)).otherwise(sure(2))))
    logp = F.concat(F.flatten(rows), F.array(sure(0), sure(3)))
    r = stored(table(spark, d, "documents").select("doc_id", logp.alias("p")), "verses").select("doc_id", metre.gated_readings()("p", F.lit(None).cast("string")).alias("x"))
    count = lambda c: F.size(F.filter("x.labels", lambda v: v == c)).cast("long")
    return r.select("doc_id", F.col("x.metre").alias("metre"), F.col("x.applied").alias("applied"), count(1).alias("heavy"), count(2).alias("light"), count(3).alias("verse"))


@query("select 10 as zone, 11 as wanted, count(*) as n from documents where doc_id % 10 = 4 having count(*) > 0 union all select 12, 10, count(*) from documents where doc_id % 10 = 3 having count(*) > 0")
def digit_faults(spark, d):
    """The digit rule against zones that were given by the digit less one."""
    z = table(spark, d, "documents").select("doc_id", F.expr("case when doc_id % 10 = 4 then 10 else 12 end").alias("zone"))
    return selection.digit_faults(z)


@query("select lang, count(*) as n, round(avg(case when doc_id % 7 = 0 or doc_id % 2 = 0 then 1 else 0 end), 6) as xpos, round(avg(case when doc_id % 3 = 0 and doc_id % 5 <> 0 then 1 else 0 end), 6) as script from documents group by lang")
def native_scores(spark, d):
    w = table(spark, d, "documents").select("lang", F.expr("if(doc_id % 7 = 0, -100, 1)").alias("gold_xpos"), F.expr("if(doc_id % 2 = 0, 1, 2)").alias("pred_xpos"), F.expr("if(doc_id % 5 = 0, -100, 1)").alias("gold_script"), F.expr("if(doc_id % 3 = 0, 1, 2)").alias("pred_script"), *[F.lit(1).alias(f"{s}_{c}") for s in ("gold", "pred") for c in ("upos", "head", "deprel")])
    return conll.native_scores(w, "lang").select("lang", "n", F.round("xpos", 6).alias("xpos"), F.round("script", 6).alias("script"))


@query("select cast(count(*) as bigint) as n, round(avg((source in (select source from documents where doc_id % 5 = 0))::int), 6) as form, round(avg((lang in ('en', 'fr'))::int), 6) as tag from documents")
def vocabulary_coverage(spark, d):
    t = table(spark, d, "documents").select(F.lit("s").alias("script"), F.col("lang").alias("tag"), F.col("source").alias("key"), F.col("lang").alias("lemma"), "doc_id")
    c = conll.coverage(t, t.select("script"), t.where("tag in ('en', 'fr')").select("tag"), t.where("doc_id % 5 = 0").select("key"), t.select("key", "lemma"))
    return c.select("n", F.round("form", 6).alias("form"), F.round("tag", 6).alias("tag"))


@query("select source, lang as lemma, count(*) as n from documents group by 1, 2")
def lexicon_counts(spark, d):
    return trees.lexicon(table(spark, d, "documents").select("source", F.col("lang").alias("lemma")), "source")


@query("select source as form, lang as lemma, 'u' as upos, 'x' as xpos from (select source, lang, row_number() over (partition by source order by count(*) desc, lang) as r from documents group by 1, 2) where r = 1")
def rule_table(spark, d):
    return trees.rule_table(table(spark, d, "documents").select(F.col("source").alias("form"), F.col("lang").alias("lemma"), F.lit("u").alias("upos"), F.lit("x").alias("xpos")))


@query("select sent, dep, head from (select conv_id as sent, turn as dep, cast(length(text) % 5 as integer) as head, row_number() over (partition by conv_id, turn order by length(text) desc, length(text) % 5) as r from conversations) where r = 1")
def greedy_heads(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sent"), F.col("turn").alias("dep"), (F.length("text") % 5).alias("head"), F.length("text").cast("double").alias("score"))
    return trees.greedy_heads(c)


@query("select band, count(*) as n, round(avg(levenshtein(replace(g, ' ', ''), replace(p, ' ', '')) / greatest(length(replace(g, ' ', '')), 1)), 6) as cer from (select case when length(g) between 1 and 5 then '1-5' when length(g) between 6 and 10 then '6-10' when length(g) between 11 and 20 then '11-20' end as band, g, p from (select n_name as g, r_name as p from nation join region on n_regionkey = r_regionkey)) group by band")
def letter_errors(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(reports.length_band(F.length("n_name")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(reports.letters_error(F.col("n_name"), F.col("r_name"))), 6).alias("cer"))
