"""Contamination: key index, conflict masks, clean runs, screens, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bag_key, characters, gram_hashes, let, mutate, ngrams, sentences, skeleton, words
from .scratch import stored

#: Zones: 0-9 rotating buckets, 10 fixed test, 11 fixed validation, 12 train only.
TEST, VAL, TRAIN = 10, 11, 12
#: Rows of an index that is broadcast (about 100 bytes each: under 32 MB); beyond that the join shuffles.
BROADCAST_ROWS = 300_000
#: Windows that are looked for in a text at once.
PROBES = 2_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint, if a count of the table allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def digit_zone(rid: Column) -> Column:
    """Zone of an id by its last digit: 3 test, 4 validation, others and no digit train."""
    d = F.right(F.trim(rid.cast("string")), F.lit(1))
    return F.when(d == "3", TEST).when(d == "4", VAL).otherwise(TRAIN)


def fold_roles(zones: DataFrame, folds: int = 10) -> DataFrame:
    """(fold, role) of each row for each fold k: test is zone k or 10, validation k + 1 or 11."""
    k = zones.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    z = F.col("zone")
    return k.withColumn("role", F.when((z == F.col("fold")) | (z == TEST), "test").when((z == (F.col("fold") + 1) % folds) | (z == VAL), "val").otherwise("train"))


def train_mask(folds: int = 10) -> Column:
    """Zones that a training record of column fold must not collide with, as bits."""
    return F.expr(f"shiftleft(1, fold) | shiftleft(1, (fold + 1) % {folds}) | {1 << TEST | 1 << VAL}")


def keys(docs: DataFrame, n: int = 8, zone: str = "zone") -> DataFrame:
    """(doc_id, zone, kind, key): distinct 64-bit hashes of sentences, bags of their words, and n-grams of the whole word
    stream, with the record's zone, so nothing is joined back by record."""
    kind = lambda name, hashes: F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(name).alias("kind"), h.alias("key")))
    made = let(sentences(F.col("text")), lambda s: F.concat(kind("exact", F.transform(s, lambda x: F.xxhash64(x))), kind("bag", F.transform(s, lambda x: F.xxhash64(bag_key(x))))))
    grams = kind("gram", gram_hashes(words(skeleton(F.col("text"))), n))
    return docs.select("doc_id", F.col(zone).alias("zone"), F.explode(F.concat(made, grams)).alias("k")).select("doc_id", "zone", "k.*")


def index(docs: DataFrame, zone: str = "zone", n: int = 8) -> DataFrame:
    """(kind, key, mask): which zones hold a key, as an OR of 1 << zone."""
    return keys(docs, n, zone).groupBy("kind", "key").agg(F.expr("bit_or(shiftleft(1, cast(zone as int)))").alias("mask"))


def conflict_masks(docs: DataFrame, idx: DataFrame | None = None, zone: str = "zone", n: int = 8) -> DataFrame:
    """(doc_id, mask): zones that a record collides with, its own bit cleared. Without an index that of the records
    themselves is made, of which only keys of several zones can collide."""
    k = stored(keys(docs, n, zone), "keys")
    if idx is None:
        idx = k.groupBy("kind", "key").agg(F.expr("bit_or(shiftleft(1, cast(zone as int)))").alias("mask")).where("mask & (mask - 1) <> 0")
    hit = k.join(idx, ["kind", "key"]).groupBy("doc_id").agg(F.expr("bit_or(mask)").alias("mask"))
    own = F.expr(f"~shiftleft(1, cast({zone} as int))")
    return docs.select("doc_id", zone).join(hit, "doc_id", "left").select("doc_id", F.coalesce(F.col("mask").bitwiseAND(own), F.lit(0)).alias("mask"))


def held_grams(held: DataFrame, *keep: str, n: int = 8) -> DataFrame:
    """(h, keep...): n-gram hashes of held-out texts, a query set; written once, and broadcast if they are few."""
    g = held.select(*keep, F.explode(F.array_distinct(gram_hashes(words(skeleton(F.col("text"))), n))).alias("h"))
    return small(stored(g if keep else g.distinct(), "held"))


def gram_hits(docs: DataFrame, held: DataFrame, n: int = 8, item: str = "item_id") -> DataFrame:
    """(doc_id, n_grams, n_items): distinct held-out n-grams, and items, found in a document, by 64-bit hashes.
    The join comes before the distinct, so only hits are grouped."""
    d = docs.select("doc_id", F.explode(gram_hashes(words(skeleton(F.col("text"))), n)).alias("h"))
    hit = d.join(held_grams(held, item, n=n), "h").select("doc_id", "h", item)
    return hit.groupBy("doc_id").agg(F.countDistinct("h").alias("n_grams"), F.countDistinct(item).alias("n_items"))


def sentence_hits(docs: DataFrame, held: DataFrame, bag: bool = False, least: int = 1) -> DataFrame:
    """(doc_id, n_hits): sentences that a held-out text has, as they are or in another order."""
    def s(x: DataFrame, *cols: str) -> DataFrame:
        out = x.select(*cols, F.explode(sentences(F.col("text"))).alias("s")).where(F.size(words(F.col("s"))) >= least)
        return out.select(*cols, (bag_key(F.col("s")) if bag else F.col("s")).alias("s"))

    return s(docs, "doc_id").join(small(s(held).distinct()), "s", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_hits"))


def clean_runs(docs: DataFrame, held: DataFrame, n: int = 8, least: int = 100) -> DataFrame:
    """(doc_id, seg, text): what is left of a document once sentences that touch a held-out
    n-gram are cut. Runs of clean sentences are joined and numbered; pieces of cut
    documents under `least` characters go; an untouched document stays whole.

    Only places of hits are grouped; they come back to their document as one array, and the rest is array expressions."""
    stream = F.flatten(F.transform(sentences(F.col("text")), words))
    places = docs.select("doc_id", F.posexplode(gram_hashes(stream, n)).alias("p", "h")).join(held_grams(held, n=n), "h", "left_semi")
    hits = stored(places.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("hits")), "hits")
    d = docs.select("doc_id", sentences(F.col("text")).alias("s")).join(small(hits), "doc_id", "left")

    def dirty(s: Column) -> Column:
        # the sentence of each word; a hit at word p touches those from p to p + n - 1
        at = F.flatten(F.transform(s, lambda x, i: F.transform(words(x), lambda _: i)))
        return let(at, lambda a: F.array_distinct(F.flatten(F.transform(F.coalesce("hits", F.array().cast("array<int>")), lambda p: F.sequence(F.get(a, p), F.get(a, p + (n - 1)))))))

    marked = d.select("doc_id", "s", F.explode(F.array(dirty(F.col("s")))).alias("dirty"))
    edges = let(F.concat(F.array(F.lit(-1)), F.sort_array("dirty"), F.array(F.size("s"))), lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.slice("s", F.get(e, i) + 2, F.greatest(F.get(e, i + 1) - F.get(e, i) - 1, F.lit(0)))))
    runs = F.transform(F.filter(edges, lambda r: F.size(r) > 0), lambda r: F.array_join(r, " "))
    kept = F.filter(runs, lambda t: (F.size("dirty") == 0) | (F.length(t) >= least))
    return marked.select("doc_id", F.posexplode(kept).alias("seg", "text"))


def rare_word_screen(train: DataFrame, test: DataFrame, df: int = 3, length: int = 6, least: int = 4) -> DataFrame:
    """(doc_id, n_rare): training records with `least` rare words of one test record: words of
    `length` letters or more that at most `df` test records have."""
    def w(x: DataFrame, name: str) -> DataFrame:
        return x.select(F.col("doc_id").alias(name), F.explode(F.array_distinct(words(skeleton(F.col("text"))))).alias("w")).where(F.length("w") >= length)

    t = w(test, "t")
    rare = t.groupBy("w").agg(F.count("*").alias("c")).where(f"c <= {df}").select("w")
    shared = w(train, "doc_id").join(t.join(rare, "w"), "w").groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    return shared.where(f"n >= {least}").groupBy("doc_id").agg(F.max("n").alias("n_rare"))


def window_scan(items: DataFrame, docs: DataFrame, width: int = 48, control: bool = False) -> DataFrame:
    """(item_id, n_found): of an item's windows at 25, 50 and 75 %, how many occur verbatim in a
    document. Items are a query set, so their windows go to all documents. With `control` a row of null
    item_id tells how many windows of one document itself were found: none means that the scan is broken."""
    def probes(df: DataFrame, name: Column) -> DataFrame:
        folded = df.select(name.alias("item_id"), skeleton(F.col("text")).alias("t")).where(f"length(t) >= {width}")
        at = [F.col("t").substr((F.floor((F.length("t") - width) * p / 100.0) + 1).cast("int"), F.lit(width)) for p in (25, 50, 75)]
        return folded.select("item_id", F.explode(F.array(*at)).alias("probe")).distinct()

    probe = probes(items, F.col("item_id"))
    if control:
        one = docs.where(F.length(skeleton(F.col("text"))) >= width).select("text").limit(1)
        probe = probe.unionByName(probes(one, F.lit(None).cast(items.schema["item_id"].dataType)))
    probe = stored(probe, "probes")
    texts = docs.select(skeleton(F.col("text")).alias("t"))
    numbered = probe.select("probe").distinct().select("probe", F.pmod(F.xxhash64("probe"), F.lit(probe.count() // PROBES + 1)).alias("block"))
    blocks = numbered.groupBy("block").agg(F.collect_list("probe").alias("probes"))  # about PROBES of 48 letters each
    seen = texts.join(F.broadcast(blocks)).select(F.explode(F.filter("probes", lambda p: F.contains("t", p))).alias("probe")).distinct()
    return probe.join(seen, "probe").groupBy("item_id").agg(F.count("*").alias("n_found"))


def shingle_screen(docs: DataFrame, held: DataFrame, n: int = 20) -> DataFrame:
    """(doc_id, n_shared): distinct runs of n letters shared with held-out texts; a held-out text of fewer letters is
    matched by a document of just these letters."""
    def parts(x: Column) -> Column:
        # a whole short text has another hash than any run of n letters
        return let(F.replace(skeleton(x), F.lit(" "), F.lit("")), lambda t: F.when(F.length(t) >= n, gram_hashes(characters(t), n)).when(t != "", F.array(F.xxhash64(t, F.lit("whole")))).otherwise(F.array().cast("array<bigint>")))

    h = small(stored(held.select(F.explode(parts(F.col("text"))).alias("s")).distinct(), "shingles"))
    d = docs.select("doc_id", F.explode(parts(F.col("text"))).alias("s"))
    return d.join(h, "s", "left_semi").groupBy("doc_id").agg(F.countDistinct("s").alias("n_shared"))


def mutation_test(items: DataFrame, copy: Column | None = None, n: int = 8) -> DataFrame:
    """(item_id, n_grams, n_shared, flagged): distinct n-grams of each item, how many of them a respelt copy (of the text, or
    of another version of it) still has, and whether it has any. Items without n-grams have no row."""
    other = F.col("text") if copy is None else copy
    made = items.select("item_id", ngrams(words(skeleton(F.col("text"))), n).alias("a"), ngrams(words(skeleton(mutate(other))), n).alias("b")).where("size(a) > 0")
    a = made.select("item_id", F.size(F.array_distinct("a")).cast("long").alias("n_grams"), F.size(F.array_intersect("a", "b")).cast("long").alias("n_shared"))
    return a.withColumn("flagged", F.col("n_shared") > 0)
