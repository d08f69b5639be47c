"""Queries over the driver's tables, each beside its equivalent in SQL.

Stand-ins: `documents` for corpus records, `benchmark` for held-out texts, `source` for the work
a record belongs to, the last digit of doc_id for the digit rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.planes import planes
from ..operators import decontam, dedup, folds, metrics, sampling, trees
from ..operators.scratch import bounded, fresh
from ..sources import readers
from ..streaming.decontam import run_stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, which also serves checkpoint()."""
    return fresh(spark, label)


# SQL that the oracles share
_SKEL = "trim(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}]+', ' ', 'g'))"


def skel(x: str = "text") -> str:
    return _SKEL.format(x)


def wlist(x: str = "text") -> str:
    return f"list_filter(string_split({skel(x)}, ' '), lambda w: w <> '')"


def slist(x: str = "text") -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{T.SENTENCE_END}'.replace('\\\\', '\\')), lambda s: {skel('s')}), lambda s: s <> '')".replace("'.replace('\\\\', '\\')", "'")


def grams(src: str, key: str, n: int = 8) -> str:
    return f"(select {key}, array_to_string(w[i:i + {n - 1}], ' ') as g from (select {key}, w, unnest(range(1, len(w) - {n - 2})) as i from (select {key}, {wlist()} as w from {src})))"


ROLE = "case when zone = fold or zone = 10 then 'test' when zone = (fold + 1) % 10 or zone = 11 then 'val' else 'train' end"
DIGIT = "case when right(trim(cast(doc_id as varchar)), 1) = '3' then 10 when right(trim(cast(doc_id as varchar)), 1) = '4' then 11 else 12 end"


def _zoned(docs: DataFrame) -> DataFrame:
    return docs.withColumn("zone", decontam.digit_zone(F.col("doc_id")))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- text, scans, projections


@query(f"select doc_id, length({skel()}) as n_skel, cast(len({wlist()}) as bigint) as n_words, md5({skel()}) as skel_md5 from documents")
def skeleton_stats(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.skeleton(F.col("text")).alias("s"))
    return s.select("doc_id", F.length("s").cast("long").alias("n_skel"), F.size(T.words(F.col("s"))).cast("long").alias("n_words"), F.md5("s").alias("skel_md5"))


@query(f"select doc_id, cast(len(s) as bigint) as n_sentences, cast(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as bigint) as longest from (select doc_id, {slist()} as s from documents)")
def sentence_counts(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("select doc_id, field, cast(length(text) as bigint) as n from (select doc_id, 'text' as field, text from documents union all select doc_id, 'lang', lang from documents union all select doc_id, 'source', source from documents) where trim(text) <> ''")
def unpivot_fields(spark, d):
    return readers.unpivot_text(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), "doc_id", ["text", "lang", "source"]).select("doc_id", "field", F.length("text").cast("long").alias("n"))


@query("""select lang, count(*) as n, cast(count(*) filter (where 100 * l >= 95 * c) as bigint) as kept from
 (select lang, length(regexp_replace(text, '[^a-zA-Z]+', '', 'g')) as l, length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) as c from documents) group by lang""")
def script_ratio_filter(spark, d):
    s = table(spark, d, "documents").select("lang", F.length(F.regexp_replace("text", "[^a-zA-Z]+", "")).alias("l"), F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).alias("c"))
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.expr("100 * l >= 95 * c")).alias("kept"))


_TAGS = "regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"


@query(f"select page_id, cast(len({wlist('t')}) as bigint) as n_words, md5({skel('t')}) as skel_md5 from (select page_id, {_TAGS} as t from pages)")
def html_text(spark, d):
    s = table(spark, d, "pages").select("page_id", T.skeleton(T.strip_tags(F.col("html"))).alias("s"))
    return s.select("page_id", F.size(T.words(F.col("s"))).cast("long").alias("n_words"), F.md5("s").alias("skel_md5"))


@query("select u.conv_id, u.turn, cast(length(u.text) as bigint) as n_user, cast(length(a.text) as bigint) as n_assistant from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'")
def role_pairs(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("n_assistant"))
    return c.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("n_user")).join(a, ["conv_id", "turn"])


_YEAR = "case event_id % 7 when 0 then '999' when 1 then '-0' when 2 then ' -999' when 3 then 'null34' else cast(cast(round(value) as bigint) - 400 as varchar) end"


@query(f"""select event_id, case when y is null then 15 else cast(least(14, greatest(0, floor((floor((y + y) / 2.0) + 800) / 100.0))) as integer) end as century
 from (select event_id, case when trim(t) = '-0' then null when regexp_full_match(trim(t), '-?[0-9]+') and cast(trim(t) as integer) not in (999, -999) then cast(trim(t) as integer) end as y from (select event_id, {_YEAR} as t from events))""")
def century_buckets(spark, d):
    y = T.year(F.expr(_YEAR.replace("varchar", "string")))
    return table(spark, d, "events").select("event_id", y.alias("y")).select("event_id", T.century(F.col("y"), F.col("y")).alias("century"))


# --- duplicates and splits


@query(f"select a, b from (select doc_id as b, min(doc_id) over (partition by {skel()}) as a from documents where {skel()} <> '') where a <> b")
def exact_dup_edges(spark, d):
    return dedup.exact_edges(table(spark, d, "documents"))


_SHARED = f"""with s as (select distinct doc_id, s from (select doc_id, unnest({slist()}) as s from documents) where len(string_split(s, ' ')) >= 5),
 t as (select doc_id, count(*) as m from s group by doc_id), k as (select s from s group by s having count(*) between 2 and 24),
 e as (select s.doc_id, s.s, m from s join k on s.s = k.s join t on t.doc_id = s.doc_id where m >= 2)
 select x.doc_id as a, y.doc_id as b, count(*) as n from e x join e y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2 having count(*) >= 2 and 100 * count(*) >= 50 * max(least(x.m, y.m))"""


@query(_SHARED)
def shared_sentence_pairs(spark, d):
    return dedup.shared_sentence_pairs(table(spark, d, "documents"))


_JACCARD = f"""with w as (select doc_id, {wlist()} as w from documents), l as (select * from w where len(w) >= 35),
 g as (select distinct doc_id, n, g from (select doc_id, len(w) as n, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from l))),
 m as (select doc_id, count(*) as m from g group by doc_id), r as (select g from g group by g having count(*) between 2 and 200),
 k as (select g.doc_id, g.n, g.g from g join r on g.g = r.g),
 c as (select distinct x.doc_id as a, y.doc_id as b from k x join k y on x.g = y.g and x.doc_id < y.doc_id where greatest(x.n, y.n) <= 3 * least(x.n, y.n)),
 i as (select a, b, count(*) as common from c join g x on x.doc_id = a join g y on y.doc_id = b and x.g = y.g group by a, b)
 select a, b, common, x.m + y.m as both from i join m x on x.doc_id = a join m y on y.doc_id = b where 100 * common >= 70 * (x.m + y.m - common)"""


@query(_JACCARD)
def jaccard_pairs(spark, d):
    return dedup.jaccard_pairs(table(spark, d, "documents"))


@query()
def minhash_lsh_pairs(spark, d):
    return dedup.minhash_pairs(table(spark, d, "documents"))


_EXACT = f"select a, b from (select doc_id as b, min(doc_id) over (partition by {skel()}) as a from documents where {skel()} <> '') where a <> b"
_COMPONENTS = f"""with recursive e0 as ({_EXACT} union select a, b from ({_SHARED})),
 e as (select a, b from e0 union select b, a from e0),
 r(v, l) as (select doc_id, doc_id from documents union select e.b, r.l from r join e on e.a = r.v)
 select v as doc_id, min(l) as cluster from r group by v"""


def _clusters(spark, d):
    shared(spark, "x")
    docs = table(spark, d, "documents")
    edges = dedup.exact_edges(docs).union(dedup.shared_sentence_pairs(docs).select("a", "b"))
    return dedup.components(docs.select("doc_id"), edges)


@query(_COMPONENTS)
def dup_components(spark, d):
    return _clusters(spark, d)


@query(f"select cluster, count(*) as n_docs from ({_COMPONENTS}) group by cluster having count(*) > 1 order by n_docs desc, cluster limit 5")
def top_components(spark, d):
    return _clusters(spark, d).groupBy("cluster").agg(F.count("*").alias("n_docs")).where("n_docs > 1").orderBy(F.desc("n_docs"), "cluster").limit(5)


@query(f"""with c as (select source as cluster, lang, sum(len({wlist()})) as w from documents group by 1, 2),
 s as (select cluster, sum(w) as size from c group by 1)
 select unit, cast(sum(w) as bigint) as n_words from (select case when size * 100 * 10 > (select sum(w) from c) * 52 then cluster || '|' || lang else cluster end as unit, w from c join s using (cluster)) group by unit""")
def oversize_units(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("cluster"), "lang", F.size(T.words(T.skeleton(F.col("text")))).cast("long").alias("n_words"))
    return dedup.oversize_units(docs, 52, 10, "lang")


_UNITS = SQL["oversize_units"]


@query(f"""with recursive u as (select unit, n_words, row_number() over (order by n_words desc, unit) as i from ({_UNITS})),
 r as (select 0::bigint as i, ''::varchar as unit, 0::bigint as n_words, -1 as bucket, list_transform(range(10), lambda x: 0::bigint) as loads
 union all select u.i, u.unit, u.n_words, cast(list_position(loads, list_min(loads)) - 1 as integer), list_transform(loads, lambda x, k: case when k = list_position(loads, list_min(loads)) then x + u.n_words else x end) from r join u on u.i = r.i + 1)
 select unit, n_words, bucket from r where i > 0""")
def bin_pack_buckets(spark, d):
    return dedup.pack_buckets(oversize_units(spark, d))


@query(f"select doc_id, {DIGIT} as zone from documents")
def digit_zones(spark, d):
    return _zoned(table(spark, d, "documents")).select("doc_id", "zone")


@query("""with b as (select source, max(doc_id % 10) as bucket, count(distinct doc_id % 10) as n from documents join labels using (doc_id) group by source)
 select doc_id, coalesce(bucket, 12) as zone, coalesce(n > 1, false) as conflict from documents left join b using (source)""")
def sibling_inherit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    b = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.max(F.col("doc_id") % 10).alias("bucket"), F.countDistinct(F.col("doc_id") % 10).alias("n"))
    return docs.join(b, "source", "left").select("doc_id", F.coalesce("bucket", F.lit(12).cast("long")).alias("zone"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("conflict"))


@query(f"select doc_id, cast(fold as integer) as fold, {ROLE} as role from (select doc_id, {DIGIT} as zone, unnest(range(10)) as fold from documents)")
def fold_roles(spark, d):
    return decontam.fold_roles(_zoned(table(spark, d, "documents").select("doc_id"))).select("doc_id", "fold", "role")


@query(f"select cast(fold as integer) as fold, role, source, count(*) as n, cast(sum(n_chars) as bigint) as chars from (select source, n_chars, fold, {ROLE} as role from (select source, n_chars, doc_id % 10 as zone, unnest(range(10)) as fold from documents)) group by 1, 2, 3")
def fold_census(spark, d):
    z = table(spark, d, "documents").select("source", "n_chars", (F.col("doc_id") % 10).alias("zone"))
    return decontam.fold_roles(z).groupBy("fold", "role", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# --- contamination

_KEYS = f"""(select distinct doc_id, 'exact' as kind, s as key from (select doc_id, unnest({slist()}) as s from documents)
 union all select distinct doc_id, 'bag', array_to_string(list_sort(string_split(s, ' ')), ' ') from (select doc_id, unnest({slist()}) as s from documents)
 union all select doc_id, 'gram', g from {grams('documents', 'doc_id')})"""


@query(f"select kind, mask, count(*) as n_keys from (select kind, key, bit_or(cast(1 << (doc_id % 3)::integer as integer)) as mask from {_KEYS} group by kind, key) group by kind, mask")
def index_bitor(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 3).alias("zone"))
    return decontam.index(docs).groupBy("kind", "mask").agg(F.count("*").alias("n_keys"))


@query(f"""with k as {_KEYS}, x as (select kind, key, bit_or(cast(1 << (doc_id % 3)::integer as integer)) as mask from k group by kind, key)
 select doc_id, bit_or(mask) & ~cast(1 << (doc_id % 3)::integer as integer) as mask from k join x using (kind, key) group by doc_id
 union all select doc_id, 0 from documents where doc_id not in (select doc_id from k)""")
def conflict_masks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 3).alias("zone"))
    return decontam.conflict_masks(docs)


@query(f"select doc_id, count(distinct g) as n_grams, count(distinct item_id) as n_items from {grams('documents', 'doc_id')} join {grams('benchmark', 'item_id')} using (g) group by doc_id")
def decontam_ngram(spark, d):
    return decontam.gram_hits(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query(f"select doc_id, count(*) as n_hits from (select doc_id, unnest({slist()}) as s from documents) where len(string_split(s, ' ')) >= 3 and s in (select unnest({slist()}) from benchmark) group by doc_id")
def decontam_exact(spark, d):
    return decontam.sentence_hits(table(spark, d, "documents"), table(spark, d, "benchmark"), least=3)


@query(f"""with b as (select array_to_string(list_sort(string_split(s, ' ')), ' ') as k from (select unnest({slist()}) as s from benchmark))
 select doc_id, count(*) as n_hits from (select doc_id, unnest({slist()}) as s from documents) where len(string_split(s, ' ')) >= 3 and array_to_string(list_sort(string_split(s, ' ')), ' ') in (select k from b) group by doc_id""")
def decontam_bag(spark, d):
    return decontam.sentence_hits(table(spark, d, "documents"), table(spark, d, "benchmark"), bag=True, least=3)


_RUNS = f"""with s as (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as i from (select doc_id, {slist()} as ss from documents)),
 n as (select doc_id, i, s, sum(len(string_split(s, ' '))) over (partition by doc_id order by i) as e, len(string_split(s, ' ')) as n from s),
 w as (select doc_id, list_filter(string_split(array_to_string({slist()}, ' '), ' '), lambda w: w <> '') as w from documents),
 g as (select doc_id, p, array_to_string(w[p:p + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as p from w)),
 h as (select doc_id, p - 1 as p from g where g in (select g from {grams('benchmark', 'item_id')})),
 t as (select distinct n.doc_id, i, 1 as dirty from n join h on n.doc_id = h.doc_id and p < e and p + 8 > e - n),
 m as (select n.doc_id, n.i, s, coalesce(dirty, 0) as dirty from n left join t on n.doc_id = t.doc_id and n.i = t.i),
 k as (select *, sum(dirty) over (partition by doc_id order by i) as island, max(dirty) over (partition by doc_id) as cut from m),
 r as (select doc_id, island, cut, string_agg(s, ' ' order by i) as text from k where dirty = 0 group by 1, 2, 3)
 select doc_id, row_number() over (partition by doc_id order by island) - 1 as seg, cast(length(text) as bigint) as n, md5(text) as text_md5 from r where cut = 0 or length(text) >= 100"""


@query(_RUNS)
def restitched_segments(spark, d):
    r = decontam.clean_runs(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return r.select("doc_id", F.col("seg").cast("long").alias("seg"), F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


_HELD = f"(select g from {grams('benchmark', 'item_id')})"


@query(f"""with c as ({_RUNS.replace("md5(text) as text_md5", "text")}), w as (select string_split(text, ' ') as w from c where seg >= 0)
 select 'cut' as kind, (select count(*) from (select unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as g from w) where g in {_HELD}) as hits
 union all select 'uncut', (select count(*) from (select distinct doc_id, g from {grams('documents', 'doc_id')}) where g in {_HELD})""")
def leakage_verify(spark, d):
    """Held-out n-grams left inside re-stitched segments, and in the documents as they were."""
    held, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    left = decontam.clean_runs(docs, held).select(F.concat_ws("/", "doc_id", "seg").alias("doc_id"), "text")
    total = lambda df, kind: decontam.gram_hits(df, held).agg(F.lit(kind).alias("kind"), F.coalesce(F.sum("n_grams"), F.lit(0)).alias("hits"))
    return total(left, "cut").unionByName(total(docs, "uncut"))


_RESPELT = "regexp_replace({0}, '([A-Za-z]{{9,}})', '\\1x'{1})"


@query(f"""with a as (select item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as g from (select item_id, {wlist()} as w from benchmark)),
 b as (select item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as g from (select item_id, {wlist(_RESPELT.format("text", ", 'g'").replace(chr(92) * 2, chr(92)))} as w from benchmark))
 select item_id, count(distinct a.g) as n_grams, count(distinct b.g) as n_shared, count(b.g) > 0 as flagged from a left join b using (item_id, g) group by item_id""")
def mutation_flagged(spark, d):
    """Copies in another spelling and with a letter more in each long word: the n-grams that the index still finds."""
    items = table(spark, d, "benchmark")
    return decontam.mutation_test(items, F.regexp_replace("text", "([A-Za-z]{9,})", "$1x"))


@query(f"""with w as (select distinct doc_id, w from (select doc_id, unnest({wlist()}) as w from documents) where length(w) >= 6),
 t as (select * from w where doc_id % 10 = 3), r as (select w from t group by w having count(*) <= 3),
 p as (select x.doc_id, t.doc_id as t, count(*) as n from w x join t using (w) where x.doc_id % 10 not in (3, 4) and x.w in (select w from r) group by 1, 2 having count(*) >= 4)
 select doc_id, max(n) as n_rare from p group by doc_id""")
def rare_word_screen(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return decontam.rare_word_screen(docs.where("doc_id % 10 not in (3, 4)"), docs.where("doc_id % 10 = 3"))


@query(f"""with b as (select item_id, {skel()} as t from benchmark), p as (select distinct item_id, substr(t, cast(floor((length(t) - 48) * p / 100.0) as integer) + 1, 48) as w from b, (values (25), (50), (75)) v(p) where length(t) >= 48),
 d as (select {skel()} as t from documents)
 select item_id, count(*) as n_found from p where exists (select 1 from d where contains(t, w)) group by item_id""")
def window_scan(spark, d):
    return decontam.window_scan(table(spark, d, "benchmark"), table(spark, d, "documents"))


_RUNS20 = "(select {0}, substr(t, i, 20) as s from (select {0}, t, unnest(range(1, length(t) - 18)) as i from (select {0}, replace({1}, ' ', '') as t from {2})) union all select {0}, 'whole ' || t from (select {0}, replace({1}, ' ', '') as t from {2}) where length(t) between 1 and 19)"


@query(f"select doc_id, count(distinct s) as n_shared from {_RUNS20.format('doc_id', skel(), 'documents')} where s in (select s from {_RUNS20.format('item_id', skel(), 'benchmark')}) group by doc_id")
def shingle_screen(spark, d):
    return decontam.shingle_screen(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("select doc_id from documents where not regexp_matches(source, '^(src1|src2)') and source not in ('src3')")
def prefix_blocklist(spark, d):
    return table(spark, d, "documents").where(~F.col("source").rlike("^(src1|src2)") & ~F.col("source").isin("src3")).select("doc_id")


@query("select doc_id, source from documents where source not in (select source from documents join labels using (doc_id) group by source having 100 * sum(toxic) > 14 * count(*))")
def flagged_source_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    bad = docs.join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("100 * t > 14 * n")
    return docs.join(bad.select("source"), "source", "left_anti").select("doc_id", "source")


@query("select split, n_ids, shared from (values ('test-train', (select count(distinct text) from documents where doc_id % 10 = 3), (select count(*) from (select text from documents where doc_id % 10 = 3 intersect select text from documents where doc_id % 10 not in (3, 4))))) v(split, n_ids, shared)")
def split_overlap(spark, d):
    docs = table(spark, d, "documents")
    test, train = docs.where("doc_id % 10 = 3").select("text"), docs.where("doc_id % 10 not in (3, 4)").select("text")
    n = test.agg(F.countDistinct("text").alias("n_ids"))
    return n.select(F.lit("test-train").alias("split"), "n_ids").join(F.broadcast(test.intersect(train).agg(F.count("*").alias("shared"))))


# --- samples, offsets, packing

_SEED = "cast('0x' || substr(md5({0} || ':{1}'), 1, 8) as bigint)"


def seed(x: str, n: int) -> str:
    return _SEED.format(f"cast({x} as varchar)" if x == "doc_id" else x, n)


@query(f"select doc_id, lang, rank from (select doc_id, lang, row_number() over (partition by lang order by {seed('doc_id', 1)}, doc_id) as rank from documents) where rank <= case lang when 'en' then 100 when 'fr' then 60 when 'de' then 40 else 0 end")
def tier_quota_sample(spark, d):
    return sampling.quota(table(spark, d, "documents").select("doc_id", "lang"), "lang", {"en": 50, "fr": 30, "de": 20}, 200).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query(f"select doc_id from documents order by {seed('doc_id', 1234)}, doc_id limit 200")
def holdout_200(spark, d):
    return sampling.holdout(table(spark, d, "documents").select("doc_id"), 200)


@query(f"""select doc_id, cast(gap as integer) as gap, cast(start as integer) as start, substr(t, cast(start as integer) + 1, gap) as gold from
 (select doc_id, t, gap, 4 + {seed("cast(doc_id as varchar) || '-' || cast(gap as varchar)", 7)} % (length(t) - gap - 8) as start from
 (select doc_id, {skel()} as t, unnest([1, 3, 5, 10]) as gap from documents) where length(t) >= gap + 9)""")
def gap_samples(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.skeleton(F.col("text")).alias("text"))
    return sampling.gaps(s, [1, 3, 5, 10])


_OFFSETS = "select source, doc_id, n_chars, cast(coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from documents"


@query(_OFFSETS)
def shard_offsets(spark, d):
    return sampling.offsets(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")


_STORE = f"(select lang as tier, doc_id as id, \"offset\" - case when doc_id % 97 = 5 then 1 else 0 end as \"offset\", n_chars as length from (select lang, doc_id, n_chars, cast(coalesce(sum(n_chars) over (order by lang, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from documents) where doc_id % 89 <> 7)"


@query(f"""with s as (select * from {_STORE} where length > 0), e as (select distinct "offset" + length as o from s), k as (select "offset" as o, count(*) as k from s group by 1),
 r as (select tier, row_number() over (order by tier) as rank from (select distinct lang as tier from documents)), l as (select r.tier, max("offset" + length) as lim from r left join r q on q.rank < r.rank left join s on s.tier = q.tier group by r.tier),
 h as (select s.tier, count(*) as records, cast(sum(length) as bigint) as letters, count(*) filter (where k > 1 or "offset" > 0 and e.o is null) as broken, count(*) filter (where "offset" < lim) as out_of_order
 from s join k on k.o = s."offset" left join e on e.o = s."offset" join l on l.tier = s.tier group by s.tier)
 select tier, records, letters, broken, out_of_order, records * 100 < m * 98 or letters > chars as lossy from h join (select lang as tier, count(*) as m, sum(n_chars) as chars from documents group by 1) using (tier)""")
def offset_contiguity(spark, d):
    """A store whose rows lie after one another by language, with some rows gone and some moved by one."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("tier"), F.col("doc_id").alias("id"), "n_chars")
    o = sampling.offsets(docs.withColumn("all", F.lit(1)).withColumn("key", F.struct("tier", "id")), "all", "key", "n_chars")
    store = o.where("id % 89 <> 7").select("tier", "id", (F.col("offset") - F.when(F.col("id") % 97 == 5, 1).otherwise(0)).alias("offset"), F.col("n_chars").alias("length"))
    return folds.store_faults(store, docs, [r.tier for r in docs.select("tier").distinct().orderBy("tier").collect()], loss_percent=2)


_PACKED = """with recursive o as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as i from documents where n_chars <= 8192),
 r as (select source, doc_id, i, n_chars, cast(0 as bigint) as row_id, cast(0 as bigint) as "offset" from o where i = 1
 union all select o.source, o.doc_id, o.i, o.n_chars, case when r."offset" + r.n_chars + o.n_chars > 8192 then r.row_id + 1 else r.row_id end, case when r."offset" + r.n_chars + o.n_chars > 8192 then 0 else r."offset" + r.n_chars end from r join o on o.source = r.source and o.i = r.i + 1)
 select source, doc_id, row_id, "offset" from r"""


@query(_PACKED)
def greedy_packing(spark, d):
    return sampling.greedy_packing(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 8192)


#: Latin letters as Greek ones, so that the driver's texts have planes.
_AS_GREEK = "translate({0}, 'abcdefghijklmnopqrstuvwxyzßæœ', 'αβγδεφγηιικλμνοπκρστυβωξυζσεε')"


@query(f"""with t as (select doc_id, {_AS_GREEK.format('strip_accents(lower(text))')} as t from documents),
 g as (select doc_id, t, regexp_extract_all(t, '[α-ω]+') as w, regexp_split_to_array(t, '[α-ω]+') as gaps from t)
 select doc_id, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as n_letters, cast(len(w) as bigint) as n_words,
 cast(case when len(w) = 0 then 0 else 1 + len(list_filter(gaps[2:len(gaps) - 1], lambda x: regexp_matches(x, '[.;!?]'))) end as bigint) as n_sentences,
 cast(len(list_filter(gaps[2:len(gaps) - 1], lambda x: regexp_matches(x, ',') and not regexp_matches(x, '[.;!?:·]'))) as bigint) as n_commas from g""")
def letter_planes(spark, d):
    p = bounded(table(spark, d, "documents")).select("doc_id", planes(F.translate(T.fold(F.col("text")), "abcdefghijklmnopqrstuvwxyzßæœ", "αβγδεφγηιικλμνοπκρστυβωξυζσεε")).alias("p")).select("doc_id", F.coalesce("p.boundary", F.array().cast("array<tinyint>")).alias("b"), F.coalesce("p.punct", F.array().cast("array<tinyint>")).alias("s"))
    count = lambda x: F.size(x).cast("long")
    inner = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    return p.select("doc_id", count("b").alias("n_letters"), count(F.filter("b", lambda x: x >= 1)).alias("n_words"), count(F.filter("b", lambda x: x == 2)).alias("n_sentences"), count(F.filter(inner("s"), lambda x: x == 1)).alias("n_commas"))


# --- reports and metrics


@query("select source, count(*) as n, cast(sum(n_chars) as bigint) as chars, arg_max(doc_id, n_chars * 1000000000 - doc_id) as longest from documents group by source")
def manifest_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"))


@query("select lang, doc_id, n_chars, rank from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents) where rank <= 12")
def top_works(spark, d):
    r = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, d, "documents").select("lang", "doc_id", "n_chars", r.cast("long").alias("rank")).where("rank <= 12")


@query("select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by rollup (lang, source)")
def census_rollup(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""with p as (select quality as g, case when len({wlist()}) >= 20 then 1 else 0 end as p, source from documents join labels using (doc_id)),
 c as (select source, count(*) filter (where g = 1 and p = 1) as tp, count(*) filter (where g <> 1 and p = 1) as fp, count(*) filter (where g = 1 and p <> 1) as fn, count(*) filter (where g <> 1 and p <> 1) as tn from p group by source)
 select source, tp, fp, fn, tn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as "precision", round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1,
 round((case when tp + fn = 0 then 0 else tp / (tp + fn) end + case when tn + fp = 0 then 0 else tn / (tn + fp) end) / 2, 6) as balanced_accuracy from c""")
def label_scores(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", "quality", (F.size(T.words(T.skeleton(F.col("text")))) >= 20).cast("int").alias("p"))
    s = metrics.binary_scores(p, "quality", "p", "source")
    return s.select("source", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "balanced_accuracy")])


_PLAIN_TURN = "regexp_replace({0}, '[^ -~]', '?'{1})"  # engines differ on bytes and letters
_TURNS = f"select a.conv_id, a.turn, {_PLAIN_TURN.format('a.text', chr(44) + chr(39) + 'g' + chr(39))} as gold, {_PLAIN_TURN.format('b.text', chr(44) + chr(39) + 'g' + chr(39))} as pred, a.turn % 3 as band from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1"


def _turns(spark, d):
    """Each turn with the next one, whole."""
    c = table(spark, d, "conversations").withColumn("text", F.regexp_replace("text", "[^ -~]", "?"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return c.select("conv_id", "turn", F.col("text").alias("gold"), (F.col("turn") % 3).alias("band")).join(nxt, ["conv_id", "turn"])


@query(f"select band, count(*) as n, round(avg(levenshtein(gold, pred) / greatest(length(gold), 1)), 6) as cer, round(avg((gold = pred)::int), 6) as top1, round(avg((gold in (pred, gold))::int), 6) as topk from ({_TURNS}) group by band")
def cer_topk_by_band(spark, d):
    s = _turns(spark, d).withColumn("hyps", F.array("pred", "gold"))
    r = metrics.gap_report(s, "band", "gold", "hyps")
    return r.select("band", "n", *[F.round(c, 6).alias(c) for c in ("cer", "top1", "topk")])


@query(f"with p as (select band, avg(levenshtein(gold, pred) / greatest(length(gold), 1)) as cer, count(*) as n from ({_TURNS}) group by band) select round(avg(cer), 6) as macro, round(sum(cer * n) / sum(n), 6) as micro from p")
def macro_micro(spark, d):
    per = _turns(spark, d).groupBy("band").agg(F.avg(metrics.cer(F.col("gold"), F.col("pred"))).alias("cer"), F.count("*").alias("n"))
    m = metrics.macro_micro(per, "cer", "n")
    return m.select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


@query("""with recursive x as (select d, row_number() over (order by d, source) as i from (select source, cast(sum(quality) - sum(toxic) - 12 as bigint) as d from documents join labels using (doc_id) group by source)),
 f(i, s, share) as (select 0::bigint, 0::bigint, 1.0::double union all select i, s, sum(share) from (select x.i, f.s + x.d as s, f.share / 2 as share from f join x on x.i = f.i + 1 union all select x.i, f.s - x.d, f.share / 2 from f join x on x.i = f.i + 1) group by i, s)
 select (select count(*) from x) as n, round(sum(share) filter (where abs(s) >= abs((select sum(d) from x))), 6) as p from f where i = (select count(*) from x)""")
def sign_flip_test(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    diffs = docs.groupBy("source").agg((F.sum("quality") - F.sum("toxic") - 12).alias("d"))
    return metrics.sign_flip_p(diffs, "d").select("n", F.round("p", 6).alias("p"))


@query()
def similarity_error(spark, d):
    return _turns(spark, d).select("conv_id", "turn", metrics.similarity_error("gold", "pred").alias("error"))


@query(f"""with f as (select distinct unnest({wlist()}) as form from documents), p as (select form, regexp_replace(form, '(s|en|es|er)$', '') as lemma from f),
 n as (select '[0, "", ' || (length(form) - length(lemma)) || ', "", false]' as script, count(*) as n from p where lemma <> '' group by 1)
 select script, n, row_number() over (order by n desc, script) as rank from n""")
def edit_scripts(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.array_distinct(T.words(T.skeleton(F.col("text"))))).alias("form")).distinct()
    pairs = w.select("form", F.regexp_replace("form", "(s|en|es|er)$", "").alias("lemma")).where("lemma <> ''")
    return trees.label_inventory(pairs)


@query()
def spanning_trees(spark, d):
    """Heads of the words of each conversation turn; each word is scored for a head by a hash of the two places."""
    t = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("sent"), F.size(F.split("text", " ")).alias("n"))
    return trees.scored_trees(t, "sent", "n", seed=1)


@query(f"select doc_id, count(distinct g) as n_grams from {grams('documents', 'doc_id')} where g in (select g from {grams('benchmark', 'item_id')}) group by doc_id")
def stream_decontam(spark, d):
    """The stream's output equals the batch result."""
    g = table(spark, d, "benchmark").select(F.explode(F.array_distinct(T.ngrams(T.words(T.skeleton(F.col("text")))))).alias("g")).distinct()
    docs = table(spark, d, "documents")
    source, out, log = (shared(spark, x) for x in ("stream-in", "stream-out", "stream-log"))
    docs.select("doc_id", "text").write.parquet(source)
    run_stream(spark, source, "doc_id long, text string", decontam.small(g), out, log)
    return spark.read.schema("doc_id long, g string").parquet(out).groupBy("doc_id").agg(F.countDistinct("g").alias("n_grams"))
