"""Treebank operators: CoNLL-U, edit scripts, label inventories, arborescences, constrained decoding."""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, line, comment, id, form, ..., misc): every line in place, comments and ranges too."""
    blocks = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\n\s*\n")).alias("sent", "block"))
    lines = blocks.select("file", "sent", F.posexplode(F.split("block", "\n")).alias("line", "text"))
    cells = F.split("text", "\t")
    note = F.startswith("text", F.lit("#"))
    return lines.select("file", "sent", "line", F.when(note, F.col("text")).alias("comment"), *[F.when(~note, F.get(cells, i)).alias(c) for i, c in enumerate(COLUMNS)])


def write_conllu(tokens: DataFrame, path: str) -> None:
    row = F.coalesce("comment", F.concat_ws("\t", *[F.coalesce(c, F.lit("_")) for c in COLUMNS]))
    sent = tokens.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("line", row.alias("row")))).alias("rows"))
    sent.repartitionByRange("file", "sent").sortWithinPartitions("file", "sent").select(F.concat(F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.lit("\n")).alias("value")).write.text(path)


def form_key(s: str) -> str:
    """Lower case, grave to acute, length marks and dots off, composed."""
    bare = unicodedata.normalize("NFD", s.lower()).replace("̀", "́")
    return unicodedata.normalize("NFC", "".join(c for c in bare if c not in "̣̄̆"))


def lemma_key(s: str) -> str:
    """Lower case, composed; length marks and numbers of homonyms stay."""
    return unicodedata.normalize("NFC", s.lower())


def edit_script(form: str, lemma: str) -> tuple[int, str, int, str]:
    """(cut in front, added in front, cut at the end, added at the end) around the longest common part, of equal ones the
    first in the form and then in the lemma; without a common part the whole form is cut."""
    for n in range(min(len(form), len(lemma)), 0, -1):
        for i in range(len(form) - n + 1):
            j = lemma.find(form[i : i + n])
            if j >= 0:
                return i, lemma[:j], len(form) - i - n, lemma[j + n :]
    return len(form), lemma, 0, ""


def lemma_script(form: str, lemma: str) -> tuple[int, str, int, str, bool]:
    """The script of folded keys, and whether the lemma begins with a capital."""
    return *edit_script(form_key(form), lemma_key(lemma)), lemma[:1] != lemma[:1].lower()


def apply_script(form: str, script: tuple) -> str | None:
    """None if the form is too short for what is cut."""
    front, add, back, more = script[:4]
    return add + form[front : len(form) - back] + more if front + back <= len(form) else None


def written(script: tuple) -> str:
    return json.dumps(list(script), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def script_of(form: pd.Series, lemma: pd.Series) -> pd.Series:
    return pd.Series([None if f is None or m is None else written(lemma_script(f, m)) for f, m in zip(form, lemma, strict=True)])


@F.pandas_udf(T.StringType())
def key_of(form: pd.Series) -> pd.Series:
    return pd.Series([None if f is None else form_key(f) for f in form])


@F.pandas_udf(T.StringType())
def scripted(form: pd.Series, script: pd.Series) -> pd.Series:
    """A form's lemma by a script, with a capital where the script or the form has one; null where it does not apply."""

    def run(f: str, s: str) -> str | None:
        script = json.loads(s)
        out = apply_script(form_key(f), script)
        capital = len(script) > 4 and script[4] or f[:1] != f[:1].lower()
        return out[:1].upper() + out[1:] if out and capital else out

    return pd.Series([None if f is None or s is None else run(f, s) for f, s in zip(form, script, strict=True)])


def label_inventory(tokens: DataFrame) -> DataFrame:
    """(script, n, rank) of edit scripts by frequency. Ranks come from how many scripts each frequency has, so no task
    holds all scripts: ties are ranked in the order of the script within their frequency."""
    n = tokens.select(script_of("form", "lemma").alias("script")).groupBy("script").agg(F.count("*").alias("n"))
    per = n.groupBy("n").agg(F.count("*").alias("k"))
    above = per.select("n", (F.sum("k").over(W.orderBy(F.desc("n"))) - F.col("k")).alias("above"))  # a row a frequency
    own = F.row_number().over(W.partitionBy("n").orderBy("script"))
    return n.join(above, "n").select("script", "n", (F.col("above") + own).alias("rank"))


def place_alphabets(tokens: DataFrame, width: int = 9) -> DataFrame:
    """(pos, chars): sorted characters of each place of the tags, `-` always among them."""
    tag = F.substring(F.rpad(F.coalesce("xpos", F.lit("")), width, "-"), 1, width)
    seen = tokens.select(tag.alias("tag")).distinct().select(F.posexplode(F.split("tag", "")).alias("pos", "char")).where("char <> ''")
    return seen.groupBy("pos").agg(F.array_sort(F.array_union(F.collect_set("char"), F.array(F.lit("-")))).alias("chars"))


def lexicon(tokens: DataFrame, *on: str) -> DataFrame:
    """(on..., lemma, n): how often a key (and a tag) has a lemma. tokens: key, xpos, lemma."""
    return tokens.groupBy(*on, "lemma").agg(F.count("*").alias("n"))


def rule_table(tokens: DataFrame) -> DataFrame:
    """(form, lemma, upos, xpos): the commonest analysis of each form that takes the rule path; of equals the least."""
    n = tokens.groupBy("form", "lemma", "upos", "xpos").agg(F.count("*").alias("n"))
    best = n.groupBy("form").agg(F.min_by(F.struct("lemma", "upos", "xpos"), F.struct(-F.col("n"), "lemma", "upos", "xpos")).alias("x"))
    return best.select("form", "x.*")


def rule_predictions(tokens: DataFrame, rules: DataFrame, lemmas: DataFrame, upos: str = "u", xpos: str = "u--------") -> DataFrame:
    """(id, lemma, upos, xpos) of tokens (id, form, key) off the model's path: the rule of the form, else the commonest
    lemma of its key, else the form itself with the tags given. lemmas: key, lemma, n."""
    best = lemmas.groupBy("key").agg(F.min_by("lemma", F.struct(-F.col("n"), "lemma")).alias("known"))
    r = rules.select("form", F.struct("lemma", "upos", "xpos").alias("rule"))
    t = tokens.join(r, "form", "left").join(best, "key", "left")
    return t.select("id", F.coalesce("rule.lemma", "known", "form").alias("lemma"), F.coalesce("rule.upos", F.lit(upos)).alias("upos"), F.coalesce("rule.xpos", F.lit(xpos)).alias("xpos"))


def lemma_decode(words: DataFrame, scripts: DataFrame, by_tag: DataFrame, by_key: DataFrame, extra: DataFrame | None = None, k: int = 64) -> DataFrame:
    """(word, lemma) of words (word, form, key, xpos) with scores scripts (word, script, lp).

    Of a word's k best scripts that apply, those count that give a lemma which the lexicon has for its key and tag (else
    for its key), by score plus 0.001 log(1 + times seen); if none does, the lexicon's commonest lemma; without lexicon
    entries the best script's lemma. by_tag: key, xpos, lemma, n; by_key: key, lemma, n; extra (key, xpos, lemma)
    adds candidates that were never seen."""
    applied = scripts.join(words.select("word", "form"), "word").withColumn("out", scripted("form", "script")).where("out is not null")
    top = applied.withColumn("r", F.row_number().over(W.partitionBy("word").orderBy(F.desc("lp"), "script"))).where(F.col("r") <= k)
    tagged = words.join(by_tag, ["key", "xpos"]).select("word", "lemma", "n")
    other = words.join(tagged.select("word").distinct(), "word", "left_anti").join(by_key, "key").select("word", "lemma", "n")
    known = tagged.unionByName(other)
    if extra is not None:
        new = words.join(extra, ["key", "xpos"]).select("word", "lemma", F.lit(0).cast("long").alias("n"))
        known = known.unionByName(new).groupBy("word", "lemma").agg(F.max("n").alias("n"))
    hit = top.join(known, (top.word == known.word) & (F.lower(top.out) == F.lower(known.lemma))).select(top.word, "lemma", (F.col("lp") + 0.001 * F.log1p("n")).alias("s"))
    best = hit.groupBy("word").agg(F.max_by("lemma", F.struct("s", "lemma")).alias("a"))
    common = known.groupBy("word").agg(F.min_by("lemma", F.struct(-F.col("n"), "lemma")).alias("b"))
    free = top.where("r = 1").select("word", F.col("out").alias("c"))
    return words.select("word", "form").join(best, "word", "left").join(common, "word", "left").join(free, "word", "left").select("word", F.coalesce("a", "b", "c", "form").alias("lemma"))


def arborescence(score: np.ndarray) -> list[int]:
    """Heads of the best spanning tree; score[d, h] of head h for dependent d, 0 the root, one root
    child at most not enforced. Cycles are contracted and solved anew."""
    n = len(score)
    s = score.astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    heads = s.argmax(axis=1)
    heads[0] = 0
    cycle = None
    for start in range(1, n):
        path, v = [], start
        while v and v not in path:
            path.append(v)
            v = int(heads[v])
        if v:
            cycle = path[path.index(v) :]
            break
    if cycle is None:
        return heads.tolist()
    rest = [v for v in range(n) if v not in cycle]
    k, c = len(rest), np.array(cycle)
    small = np.full((k + 1, k + 1), -np.inf)
    small[:k, :k] = s[np.ix_(rest, rest)]
    own = s[c, heads[c]]
    gain = s[np.ix_(c, rest)] - own[:, None]
    enter = gain.argmax(axis=0)
    small[k, :k] = gain.max(axis=0)
    leave = s[np.ix_(rest, c)]
    small[:k, k] = leave.max(axis=1)
    solved = arborescence(small)
    out = heads.copy()
    for a in range(1, k):
        h = solved[a]
        out[rest[a]] = c[leave[a].argmax()] if h == k else rest[h]
    h = solved[k]
    out[c[enter[h]]] = rest[h]
    return [int(x) for x in out]


def parse_trees(scores: DataFrame) -> DataFrame:
    """(sent, dep, head) from (sent, dep, head, score); a sentence is one group."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["dep"].max(), pdf["head"].max())) + 1
        m = np.full((n, n), -1e9)
        m[pdf["dep"], pdf["head"]] = pdf["score"]
        heads = arborescence(m)
        return pd.DataFrame({"sent": pdf["sent"].iloc[0], "dep": range(1, n), "head": heads[1:]})

    return scores.select("sent", "dep", "head", "score").groupBy("sent").applyInPandas(solve, f"sent {scores.schema['sent'].dataType.simpleString()}, dep long, head long")


def scored_trees(sentences: DataFrame, sent: str, size: str, seed: int = 0) -> DataFrame:
    """(sent, dep, head): trees over sentences of `size` words whose scores are hashes of their places; a stand-in for a
    parser, whose matrix is made where the tree is found, so no row a pair is shuffled."""
    kind = sentences.schema[sent].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for name, n in zip(pdf["sent"], pdf["n"], strict=True):
                rng = np.random.default_rng(zlib.crc32(f"{seed}:{name}".encode()))
                heads = arborescence(rng.random((int(n) + 1, int(n) + 1)))
                out.append(pd.DataFrame({"sent": name, "dep": np.arange(1, int(n) + 1), "head": heads[1:]}))
            yield pd.concat(out) if out else pd.DataFrame({"sent": [], "dep": [], "head": []})

    return sentences.select(F.col(sent).alias("sent"), F.col(size).alias("n")).mapInPandas(run, f"sent {kind}, dep long, head long")


def constrained_tags(scores: DataFrame, inventory: DataFrame) -> DataFrame:
    """(word, tag): of the attested tags the one of the greatest sum of per-place log probabilities;
    scores (word, pos, char, lp), inventory (tag); a place without a score counts -20."""
    parts = inventory.select("tag", F.posexplode(F.split("tag", "")).alias("pos", "char")).where("char <> ''")
    size = parts.groupBy("tag").agg(F.count("*").alias("n"))
    got = scores.join(F.broadcast(parts) if parts.count() <= 100_000 else parts, ["pos", "char"]).groupBy("word", "tag").agg(F.sum("lp").alias("lp"), F.count("*").alias("k"))
    best = got.join(size, "tag").withColumn("total", F.col("lp") - 20.0 * (F.col("n") - F.col("k")))
    return best.groupBy("word").agg(F.max_by("tag", F.struct("total", "tag")).alias("tag"))


def greedy_heads(scores: DataFrame) -> DataFrame:
    return scores.groupBy("sent", "dep").agg(F.max_by("head", F.struct("score", -F.col("head"))).alias("head"))


def meter_decode(logp: np.ndarray, step: dict[tuple[int, int], set[int]], final: set[int]) -> tuple[float, list[int]] | None:
    """The best symbol sequence that an automaton (start 0) accepts, and its score."""
    states = {0: (0.0, [])}
    for row in logp:
        new: dict[int, tuple[float, list[int]]] = {}
        for state, (v, path) in states.items():
            for symbol, p in enumerate(row):
                for to in step.get((state, symbol), ()):
                    if to not in new or v + p > new[to][0]:
                        new[to] = (v + p, [*path, symbol])
        states = new
    ends = [x for s, x in states.items() if s in final]
    return max(ends, key=lambda x: x[0]) if ends else None
