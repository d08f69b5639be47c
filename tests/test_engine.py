"""Reference operators: hand-made cases, invariants and the SQL beside each query."""

import random
import unicodedata
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.functions import planes as P
from corpusloom.functions import text as T
from corpusloom.operators import decontam, dedup, metrics, sampling, trees
from corpusloom.plans import registry
from corpusloom.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(con.sql(f"select {names} from want").fetchall())


def test_fold_equals_unicodedata(spark):
    rnd = random.Random(1)
    pool = "abcéÀñαάὰᾶᾳἄΣςϲϐϑϰϊΐ .;·\ń̈"
    rows = ["".join(rnd.choice(pool) for _ in range(30)) for _ in range(200)] + ["", "ΛΟΓΟΣ", "μῆνιν ἄειδε"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    for r in df.select("i", T.fold(F.col("t")).alias("f")).collect():
        want = "".join(c for c in unicodedata.normalize("NFD", rows[r.i]) if unicodedata.category(c) != "Mn").lower()
        want = want.translate(str.maketrans(T.VARIANTS)).replace("ς", "σ")
        assert r.f == want


def test_sentences_and_ngrams(spark):
    df = spark.createDataFrame([("One two. Three!\n\nfour;; ... five",)], "t string")
    assert df.select(T.sentences(F.col("t"))).first()[0] == ["one two", "three", "four", "five"]
    for n, want in ((0, 0), (7, 0), (8, 1), (9, 2)):
        w = spark.createDataFrame([([f"w{i}" for i in range(n)],)], "w array<string>")
        assert len(w.select(T.ngrams(F.col("w"))).first()[0]) == want


def test_planted_probes(spark):
    quote = "sing goddess the wrath of achilles son of peleus the ruinous wrath"
    held = spark.createDataFrame([(1, quote + ".")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Clean filler text here. " + quote + ". More clean filler."), (2, "Peleus the ruinous wrath sing goddess wrath the of achilles son of."), (3, "nothing to see")], "doc_id long, text string")
    assert {r.doc_id for r in decontam.gram_hits(docs, held).collect()} == {1}
    assert {r.doc_id for r in decontam.sentence_hits(docs, held, bag=True).collect()} == {1, 2}
    left = {(r.doc_id, r.seg): r.text for r in decontam.clean_runs(docs, held, least=5).collect()}
    assert left[1, 0] == "clean filler text here" and left[1, 1] == "more clean filler" and (3, 0) in left
    assert decontam.mutation_test(held).first().flagged


def test_components_and_packing(spark):
    registry.shared(spark, "t")
    nodes = spark.range(8).withColumnRenamed("id", "doc_id")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {r.doc_id: r.cluster for r in dedup.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    units = spark.createDataFrame([(f"u{i}", w) for i, w in enumerate((9, 7, 6, 5, 4, 3, 2))], "unit string, n_words long")
    loads = Counter()
    for r in dedup.pack_buckets(units, 3).collect():
        loads[r.bucket] += r.n_words
    assert max(loads.values()) - min(loads.values()) <= 2
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate((5, 4, 3, 20, 8))], "g string, o long, n long")
    assert [(r.o, r.row_id, r.offset) for r in sampling.greedy_packing(rows, "g", "o", "n", 10).orderBy("o").collect()] == [(0, 0, 0), (1, 0, 5), (2, 1, 0), (4, 2, 0)]


def test_jaccard_pairs_of_a_large_group_against_brute_force(spark):
    rnd = random.Random(9)
    texts = []
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    for i in range(230):
        w = list(base)
        for j in (0, 59)[: 1 + (i % 23 == 0)]:  # all other grams are in more than 200 documents
            w[j] = "x" + "".join(chr(97 + int(c)) for c in str(i))
        texts.append(" ".join(w))
    texts += [" ".join(rnd.choice(base) for _ in range(50)) for _ in range(10)] * 2 + ["short text", "", None]
    sets = [frozenset(tuple(w[k : k + 8]) for k in range(len(w) - 7)) if len(w) >= 35 else frozenset() for w in ((t or "").split() for t in texts)]
    want = set()
    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            common, both = len(x & sets[b]), len(x) + len(sets[b])
            if common and 100 * common >= 70 * (both - common):
                want.add((a, b, common, both))
    got = dedup.jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(want) > 20_000 and {tuple(r) for r in got} == want


def test_planes():
    p = P.encode("Μῆνιν ἄειδε, θεά.")
    assert P.decode(p, marks=False) == "μηνιν αειδε θεα." and p.boundary == [0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 2] and p.punct[9] == 1 and p.cap[0] == 1
    assert P.decode(p) == "Μῆνιν ἄειδε θεά." and P.encode("latin") is None and P.encode(None) is None
    assert all(P.unpack(P.pack(*m)) == m for m in product(range(4), range(3), range(2), range(2)))


def test_trees():
    rnd = np.random.default_rng(3)
    for n in (2, 3, 4, 5):
        for _ in range(20):
            s = rnd.random((n, n))
            best = -1.0
            for heads in product(range(n), repeat=n - 1):
                h = [0, *heads]
                ok = all(h[d] != d for d in range(1, n))
                for d in range(1, n):
                    v, k = d, 0
                    while v and k <= n:
                        v, k = h[v], k + 1
                    ok &= v == 0
                if ok:
                    best = max(best, sum(s[d, h[d]] for d in range(1, n)))
            got = trees.arborescence(s)
            assert abs(sum(s[d, got[d]] for d in range(1, n)) - best) < 1e-9
    for form, lemma in (("λόγους", "λόγος"), ("a", "b"), ("", "x"), ("same", "same")):
        assert trees.apply_script(form, trees.edit_script(form, lemma)) == lemma
    step = {(0, 0): {1}, (1, 1): {0}}
    assert trees.meter_decode(np.log(np.array([[0.4, 0.6], [0.5, 0.5]])), step, {0})[1] == [0, 1]


def test_conllu_round_trip(spark, tmp_path):
    src = tmp_path / "a.conllu"
    src.write_text("# id = 1\n1\tA\ta\tX\t_\t_\t0\troot\t_\t_\n1-2\tAB\t_\t_\t_\t_\t_\t_\t_\t_\n\n1\tB\tb\tY\t_\t_\t0\troot\t_\t_\n")
    out = str(tmp_path / "out")
    trees.write_conllu(trees.read_conllu(spark, str(src)), out)
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert text.strip() == src.read_text().strip()


def test_metrics(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "d double")
    assert metrics.sign_flip_p(d, "d").first().p == 0.25
    z, p = metrics.two_proportions(50, 100, 50, 100)
    assert z == 0 and p == 1
    g = spark.createDataFrame([(1, 0, 1, "N", "a", 2, "x"), (1, 1, 2, "V", "b", 0, "root")], "sent int, start int, end int, upos string, lemma string, head int, deprel string")
    p = g.withColumn("deprel", F.lit("root"))
    assert {r.metric: r.f1 for r in metrics.attachment_scores(g, p).collect()} == {"UPOS": 1.0, "Lemmas": 1.0, "UAS": 1.0, "LAS": 0.5}


def test_sources(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"id": "1", "text": "a"}\n{"id": "2", "text": NaN}\nbroken\n')
    rows = readers.jsonl(spark, str(f), "id string, text string").collect()
    assert len(rows) == 3 and rows[0].text == "a" and rows[2]._bad == "broken"
    assert readers.markdown(spark.range(2)) == "| id |\n| --- |\n| 0 |\n| 1 |"


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
