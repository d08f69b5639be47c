"""The split, selections, sources and duplicates on small tables, against plain rewrites of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import decontam, dedup, folds, reports, selection
from corpusloom.operators.scratch import shared_dir
from corpusloom.sources import readers

STOP = re.compile("[.;!?:··;]+|\\n\\s*\\n")


def brute_spans(text):
    cuts = [0, *(m.end() for m in STOP.finditer(text))]
    pieces = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]
    worded = [folds.second_words(text[a:b]) for a, b in pieces]
    starts = [p[0] for p, w in zip(pieces, worded, strict=True) if w]
    if not pieces:
        return []
    starts = [0, *starts[1:]]
    return list(zip(starts, [*starts[1:], len(text)], strict=True))


def test_sentence_spans_tile(spark):
    rnd = random.Random(1)
    texts = ["", "...", None, "a", "...a. b", "a\n \n\nb. ", "é: ñ\nx"] + ["".join(rnd.choice(["a", "b c", ".", "!", " ", "\n", "\n\n", "·", "é"]) for _ in range(25)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in folds.with_sentences(df).collect():
        text = texts[r.doc_id] or ""
        got = [(s.start, s.end) for s in r.sentences]
        assert got == brute_spans(text), repr(text)
        assert "".join(text[a:b] for a, b in got) == text
        assert [s.skel.split() for s in r.sentences] == [folds.second_words(text[a:b]) for a, b in got] or not text.strip()


def brute_segments(text, spans, masks, conflict, least):
    keep = [not m & conflict for m in masks]
    if not spans:
        return [], 0
    if all(keep):
        return [text], 0
    pieces, cut, run = [], 0, None
    for (a, b), k in [*zip(spans, keep, strict=True), ((0, 0), False)]:
        if k:
            run = (run[0], b) if run else (a, b)
        else:
            if run:
                t = text[run[0] : run[1]].strip()
                pieces.append(t) if len(t) >= least else None
                cut += len(t) if len(t) < least else 0
                run = None
            cut += b - a
    return pieces, cut


def test_segments_against_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(150):
        text = "".join(rnd.choice(["word ", "two words", ". ", "!\n"]) for _ in range(rnd.randrange(14)))
        spans = brute_spans(text)
        rows.append((i, text, [(a, b, "x") for a, b in spans], [rnd.choice((0, 0, 1, 2)) for _ in spans]))
    df = spark.createDataFrame(rows, "i int, text string, sentences array<struct<start: int, end: int, skel: string>>, masks array<int>")
    for r in df.select("i", folds.segments(F.col("text"), F.col("sentences"), F.col("masks"), F.lit(1), F.lit(12)).alias("s")).collect():
        _, text, spans, masks = rows[r.i]
        assert (r.s.pieces, r.s.cut) == brute_segments(text, [x[:2] for x in spans], masks, 1, 12), rows[r.i]


QUOTE = "sing goddess the wrath of achilles son of peleus the ruinous wrath"


def records(spark):
    own = lambda i: " ".join(f"w{i}x{chr(97 + j)}{chr(97 + i)}" for j in range(26)).replace(str(i), "q" * (i + 1))
    rows = [
        (1, "s", "pristine", 0, own(1) + ". " + QUOTE + ". " + own(2) + "."),
        (2, "s", "pristine", 5, own(3) + ". " + QUOTE + "."),
        (3, "s", "repaired", 12, "Short. " + QUOTE.upper() + "! " + own(4) + "."),
        (4, "s", "pristine", 10, own(5) + "."),
        (5, "s", "bronze", 12, own(6) + "."),
        (6, "s", "bronze", 12, ""),
    ]
    return spark.createDataFrame(rows, "doc_id int, source string, tier string, zone int, text string")


def test_split_leaves_nothing_and_a_spoiled_one_is_found(spark):
    docs = folds.with_sentences(records(spark))
    masked = folds.sentence_masks(docs, folds.contamination_index(docs)).cache()
    masks = {r.doc_id: r.masks for r in masked.collect()}
    assert masks[1] == [0, 1 << 5, 0] and masks[2] == [0, 1] and masks[3] == [0, 1 | 1 << 5, 0] and masks[4] == [0] and masks[6] == []
    pieces = folds.fold_pieces(masked).cache()
    assert all(r.hits == 0 for r in folds.verify(pieces).collect()) and folds.shared_bases(pieces).count() == 0
    of = {(r.fold, r.id): (r.role, r.text) for r in pieces.collect()}
    assert of[0, "1"][0] == "test" and of[9, "1#seg0"][0] == "val" if (9, "1#seg0") in of else of[9, "1"][0] == "val"
    assert of[5, "1#seg0"][0] == "train" and (3, "3#seg0") not in of or of[3, "3"][0] == "train"
    assert all(of[k, "4"][0] == "test" for k in range(10)) and (0, "6") not in {(f, i) for (f, i), (_, t) in of.items() if t is not None}
    stats = {(r.fold, r.role, r.tier): r for r in folds.fold_statistics(pieces).collect()}
    assert stats[0, "train", "bronze"].records == 1 and stats[0, "train", "bronze"].dropped == 1
    spoiled = pieces.unionByName(pieces.where("fold = 0 and role = 'test'").withColumn("role", F.lit("train")))
    hits = {(r.fold, r.pair, r.kind): r.hits for r in folds.verify(spoiled).collect()}
    assert hits[0, "train-held", "gram"] > 0 and hits[0, "train-held", "sent"] > 0 and hits[0, "val-test", "gram"] == 0 and hits[1, "train-held", "gram"] == 0
    assert {r.base for r in folds.shared_bases(spoiled).collect()} == {"1", "4"}


def test_documentary_tier(spark):
    docs = folds.with_sentences(records(spark))
    papyri = folds.with_sentences(spark.createDataFrame([("phi1:edition", "phi", QUOTE), ("phi1:synthetic", "phi", "w q"), ("x", "other", "no")], "doc_id string, source string, text string"))
    index = folds.documentary_index(papyri, ["phi"], ["synthetic"])
    assert index.where("mask <> 8192").count() == 0 and folds.index_recall(papyri.where("source = 'phi' and doc_id like '%edition'"), index).first().found == index.count()
    clean = folds.documentary_clean(docs, index, ["none"], least=20).where("text is not null").collect()
    assert not [r for r in clean if QUOTE in (r.text or "").lower()] and {r.id for r in clean} >= {"1#seg0", "1#seg1", "4", "5"}
    fields = spark.createDataFrame([("p", "a", 10, [0, 1]), ("q", "a", 11, [1 << 3]), ("q", "synthetic", 11, [1 << 4]), ("r", "a", 12, [0])], "id string, field string, zone int, masks array<int>")
    got = {(r.fold, r.role, r.id) for r in folds.held_fields(fields, ["synthetic"]).collect()}
    assert got == {(k, "test", "p") for k in range(10)} | {(k, "val", "q") for k in range(10) if k != 3}
    census = {(r.tier, r.source): r for r in folds.census(folds.documentary_clean(docs, index, []), [("pristine", "s")]).collect()}
    assert census["pristine", "s"].forbidden and not census["bronze", "s"].forbidden


def test_signatures_and_matches(spark):
    rnd = random.Random(3)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    base = words(120)
    near = base[:118] + words(2)
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(words(120))), (4, "too few words"), (5, " ".join(base * 5 + words(300)))]
    docs = folds.with_sentences(spark.createDataFrame(rows, "doc_id int, text string"))
    sig = folds.signatures(docs)
    assert {r.doc_id: r.n_words for r in sig.collect()} == {1: 120, 2: 120, 3: 120, 5: 900}
    against = sig.where("doc_id = 1").withColumn("bit", F.lit(8))
    assert {(r.doc_id, r.mask) for r in folds.record_matches(sig, against).collect()} == {(1, 8), (2, 8)}
    masked = folds.sentence_masks(docs.withColumn("zone", F.lit(12)), spark.createDataFrame([], "key long, mask int"), folds.record_matches(sig, against))
    assert {r.doc_id: r.masks for r in masked.collect()} == {1: [8], 2: [8], 3: [0], 4: [0], 5: [0]}


def test_store_faults(spark):
    good = [("a", 1, 0, 5), ("a", 2, 5, 3), ("b", 3, 8, 4), ("b", 4, 12, 0)]
    source = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 3, 4), ("b", 4, 1)], "tier string, id int, n_chars int")
    check = lambda rows: {r.tier: (r.records, r.broken, r.out_of_order, r.lossy) for r in folds.store_faults(spark.createDataFrame(rows, "tier string, id int, offset long, length long"), source, ["a", "b"], 50).collect()}
    assert check(good) == {"a": (2, 0, 0, False), "b": (1, 0, 0, False)}
    assert check([("a", 1, 0, 5), ("a", 2, 6, 3), ("b", 3, 2, 40)]) == {"a": (2, 1, 0, False), "b": (1, 1, 1, True)}
    assert check(good[:1])["b"] == (0, 0, 0, True)


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(0, "train", "1", "αβ"), (0, "test", "2", 'x "y"\n'), (1, "train", "3", None)], "fold int, role string, id string, text string").repartition(2)
    readers.write_jsonl_zst(rows, str(tmp_path / "folds"), ["fold", "role"])
    back = readers.jsonl_zst(spark, str(tmp_path / "folds"), "id string, text string", "*").collect()
    assert {(r.id, r.text, r._bad) for r in back} == {("1", "αβ", None), ("2", 'x "y"\n', None), ("3", None, None)} and (tmp_path / "folds" / "fold=0" / "role=test").is_dir()
    import zstandard

    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.zst").write_bytes(zstandard.compress(b'{"id": "1"}\nbroken\n') + zstandard.compress(b'{"id": "2"}'))
    got = readers.jsonl_zst(spark, str(tmp_path / "z"), "id string")
    assert {r.id for r in readers.parseable(got).collect()} == {"1", "2"}
    assert tuple(readers.skipped(got).first()) == (3, 1, 2)
    (tmp_path / "m.tsv").write_text("a\ta_\nno\nb\tb^\tc\n")
    assert sorted(tuple(r) for r in readers.marked_lines(spark, str(tmp_path / "m.tsv")).collect()) == [("a", "a_"), ("b", "b^")]
    for folder, lines in (("x", "one\n\nthree\n"), ("y", "1\n\n3")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "w.txt").write_text(lines)
    both = readers.parallel_lines(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    assert sorted((r.line, r.a, r.b) for r in both.collect()) == [(0, "one", "1"), (2, "three", "3")]
    (tmp_path / "y" / "w.txt").write_text("1\n2")
    with pytest.raises(Exception, match="numbers of lines differ"):
        readers.parallel_lines(spark, str(tmp_path / "x"), str(tmp_path / "y")).collect()
    (tmp_path / "b.jsonl").write_text('{"text": "a", "source": "s", "task": "t"}\n{"text": "b"}\n')
    got = readers.benchmark_split(spark, str(tmp_path / "b.jsonl"), spark.createDataFrame([(1,)], "line int")).collect()
    assert sorted((r.text, r.split) for r in got) == [("a", "test"), ("b", "dev")]
    (tmp_path / "c.xml").write_text("<record><urn_cts> u1 </urn_cts><author>A</author><title_labels>T</title_labels></record><record><author>x</author></record>\n<record><urn_cts>u1</urn_cts><author>B</author></record>")
    assert [tuple(r) for r in readers.catalogue_names(spark, str(tmp_path / "c.xml")).collect()] == [("u1", "B — ")]
    assert readers.report([("A", spark.range(1))]) == "## A\n\n| id |\n| --- |\n| 0 |\n"
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert readers.parquet(spark, str(tmp_path / "p"), "id", "absent").columns == ["id", "absent"]
    a, b = spark.createDataFrame([("d/f1.xml", 7)], "file string, tm int"), spark.createDataFrame([("i1", "e/f1.xml"), ("i2", "f2.xml")], "id string, file string")
    assert [tuple(r) for r in readers.id_lookup(a, b).collect()] == [("i1", 7)]


def test_caps_have_exact_ways(spark):
    shared_dir(spark)
    text = "this is one shared sentence of words. and here is another shared one."
    df = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    assert dedup.shared_sentence_pairs(df).count() == 0 and dedup.shared_sentence_pairs(df, cap=None).count() == 30 * 29 // 2
    assert dedup.minhash_pairs(df, cap=20).count() == 0 and dedup.minhash_pairs(df, cap=None).count() == 30 * 29 // 2
    chain = spark.range(1, 300).selectExpr("id - 1 as a", "id as b")
    got = dedup.components(spark.range(301).withColumnRenamed("id", "doc_id"), chain)
    assert got.where("cluster = 0").count() == 300 and got.where("doc_id = 300 and cluster = 300").count() == 1
    assert [r.bucket for r in dedup.pack_buckets(spark.createDataFrame([("a", 1), ("b", 1)], "unit string, n_words long"), 2, seed=1).collect()] == [0, 1]
    assert {tuple(r) for r in dedup.prefix_edges(spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "doc_id int, prefix string"), "prefix").collect()} == {(1, 2)}


def test_screens(spark):
    held = spark.createDataFrame([(1, "Short line."), (2, "abcdefghij klmnopqrst uvwxyz")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "short LINE"), (2, "short lines"), (3, "x abcdefghijklmnopqrst y"), (4, None), (5, "a" * 60)], "doc_id int, text string")
    assert {r.doc_id: r.n_shared for r in decontam.shingle_screen(docs, held).collect()} == {1: 1, 3: 1}
    found = {r.item_id: r.n_found for r in decontam.window_scan(held.withColumn("text", F.repeat("text", 9)), docs, control=True).collect()}
    assert found == {None: 1}
    m = decontam.mutation_test(spark.createDataFrame([(1, "Ἄνδρα μοι, ἔννεπε. Μοῦσα πολύτροπον ὃς μάλα πολλὰ πλάγχθη ςΣ")], "item_id int, text string")).first()
    assert m.flagged and m.n_grams == m.n_shared == 3


def test_selections(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    gap = lambda t, s, n: one(selection.scorable_gap(F.lit(t), F.lit(s), F.lit(n)))
    assert gap("abc def", 1, 2) and not gap("ab- d", 2, 2) and not gap("a  b", 1, 2) and not gap("ab  c", 2, 1) and not gap("a b", 1, 1) and gap("ab c", 2, 2) and not gap("a  bc", 2, 2) and not gap("ab  c", 1, 2)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, seg int")
    out = selection.without_listed(rows, spark.createDataFrame([("a", "2"), ("b", None)], "id string, seg string"), "id", "seg")
    assert [tuple(r) for r in out.collect()] == [("a", 1)]
    cat = spark.createDataFrame([("x", "Homer", None), ("bad", "Z", None), ("x", None, "graece")], "corpus string, author string, title string")
    assert [r.flagged for r in selection.catalogue_flags(cat, ["bad"], {"author": "hom", "title": "e$"}).collect()] == [True, True, True]
    n = selection.numbered(spark.range(50).selectExpr("50 - id as k"), ["k"]).collect()
    assert sorted((r.k, r.ordinal) for r in n) == [(i + 1, i) for i in range(50)]
    mix = selection.tier_mix(spark.createDataFrame([(i, "a") for i in range(3)] + [(9, "b")], "doc_id long, tier string"), {"a": 0.7, "b": 0.3, "c": 0.0}, 10)
    got = [(r.tier, r["pass"], r.doc_id) for r in mix.collect()]
    assert len([x for x in got if x[0] == "a"]) == 7 and len(set(got)) == 10 and {p for t, p, _ in got if t == "b"} == {0, 1, 2}
    assert [r.unit for r in selection.seeded_order(spark.createDataFrame([("a", 1), ("b", 2)], "unit string, size int"), "size", "unit", 1).collect()] == ["b", "a"]
    first = selection.first_per_group(rows, "id", "seg", 1)
    assert sorted(r.seg for r in first.collect()) == [1, 1]
    w = {r.tier: r.weight for r in selection.record_weights(spark.createDataFrame([("a", 10), ("b", 20)], "tier string, n_chars int"), {"a": 0.5, "b": 0.5}).collect()}
    assert abs(w["a"] - 2 / 3) < 1e-9
    assert one(selection.base_id(F.lit("ab_c#d"))) == "ab" and one(T.region_id(F.lit(None).cast("string"))) == 14
    r = reports.two_shares(spark.createDataFrame([(5, 10, 5, 10), (0, 3, 0, 3)], "a int, n int, b int, m int"), "a", "n", "b", "m").collect()
    assert all((x.z, x.p) == (0.0, 1.0) for x in r)


def test_incremental_train_mask(spark):
    got = spark.range(10).selectExpr("cast(id as int) as fold").select("fold", decontam.train_mask().alias("m")).collect()
    assert all(r.m == (1 << r.fold | 1 << (r.fold + 1) % 10 | 3 << 10) for r in got)


def test_signatures_are_sparks_hashes_and_copies_are_one_class(spark):
    """Coordinates against Spark's own hash; matches against all pairs, with a group of copies that would make 256 million rows of equal bands."""
    rnd = random.Random(5)
    words = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    base = words(90)
    rows = [(i, " ".join(base)) for i in range(2000)]
    rows += [(2000 + i, " ".join(base[: 90 - 4 * i] + words(4 * i))) for i in range(14)] + [(3000 + i, " ".join(words(50))) for i in range(5)]
    docs = folds.with_sentences(spark.createDataFrame(rows, "doc_id int, text string")).withColumn("bit", F.expr("shiftleft(1, doc_id % 9)"))
    sig = folds.signatures(docs, keep=("bit",)).cache()
    h = docs.where("doc_id in (0, 2003, 3001)").select("doc_id", F.explode(F.array_distinct(T.ngrams(T.words(T.skeleton(F.col("text")))))).alias("g")).select("doc_id", F.xxhash64("g").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(127))).alias("k"))
    want = {(r.doc_id, r.k): r.m for r in h.groupBy("doc_id", "k").agg(F.min(F.xxhash64("x", "k")).alias("m")).collect()}
    got = {(r.doc_id, k): v for r in sig.where("doc_id in (0, 2003, 3001)").collect() for k, v in enumerate(r.sig)}
    assert got == want and len(got) == 3 * 128
    one = {r.doc_id: r for r in sig.where("doc_id = 0 or doc_id >= 2000").collect()}
    of = lambda i: one[i if i >= 2000 else 0]
    bits = {}
    for i in range(2000):
        bits[0] = bits.get(0, 0) | 1 << i % 9 if i % 3 else bits.get(0, 0)
    bits |= {i: 1 << i % 9 for i in one if i >= 2000 and i % 3}

    def like(x, y):
        equal = [p == q for p, q in zip(x.sig, y.sig, strict=True)]
        return sum(equal) >= 64 and any(a and b for a, b in zip(equal[::2], equal[1::2], strict=True))

    masks = {i: sum({b for j, m in bits.items() if like(one[i], one[j]) for b in (1 << k for k in range(9)) if m & b}) for i in one}
    found = {r.doc_id: r.mask for r in folds.record_matches(sig, sig.where("doc_id % 3 <> 0")).collect()}
    assert found == {i: masks[of(i).doc_id] for i, _ in rows if masks[of(i).doc_id]}


def test_verification_counts_each_place(spark):
    """Against a plain count, with texts that stand twice in a role of a fold."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcd") * 2 for _ in range(rnd.randrange(14))) + rnd.choice((".", "", ". aa bb")) for _ in range(30)]
    rows = [(rnd.randrange(4), rnd.choice(("train", "train", "val", "test")), i, rnd.choice(texts)) for i in range(160)] + [(0, "train", 200, None)]
    df = spark.createDataFrame(rows, "fold int, role string, id int, text string").coalesce(2)
    want = {}
    for fold in {f for f, _, _, t in rows if t is not None}:
        for kind in (0, 1):
            have = {r: [folds._keys_of(t, 3, False)[kind] for f, x, _, t in rows if f == fold and x == r and t is not None] for r in ("train", "val", "test")}
            of = {r: set().union(*v) for r, v in have.items()}
            if any(of.values()):
                name = ("sent", "gram")[kind]
                want[fold, "train-held", name] = sum(len(k & (of["val"] | of["test"])) for k in have["train"])
                want[fold, "val-test", name] = sum(len(k & of["test"]) for k in have["val"])
    got = folds.verify(df, n=3)
    assert {(r.fold, r.pair, r.kind): r.hits for r in got.collect()} == want and sum(want.values()) > 0
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "string", "string", "bigint"]
