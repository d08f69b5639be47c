"""Treebank files checked and scored: spans, words, tags, lemmas, trees, thirteen measures.

A document is one row (doc, text) per side. Words are aligned by their place in the characters without spaces; where a
token stands for several words, the words inside that stretch are aligned by their longest common subsequence of forms.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Features that count, relations of content words, relations of function words.
FEATURES = set("PronType NumType Poss Reflex Foreign Abbr Gender Animacy Number Case Definite Degree VerbForm Mood Tense Aspect Voice Evident Polarity Person Polite".split())
CONTENT = set("nsubj obj iobj csubj ccomp xcomp obl vocative expl dislocated advcl advmod discourse nmod appos nummod acl amod conj fixed flat compound list parataxis orphan goeswith reparandum root dep".split())
FUNCTION = set("aux cop mark det clf case cc".split())
MEASURES = "Tokens Sentences Words UPOS XPOS UFeats AllTags Lemmas UAS LAS CLAS MLAS BLEX".split()


@dataclass(eq=False)
class Word:
    start: int
    end: int
    several: bool
    form: str
    lemma: str
    upos: str
    xpos: str
    feats: str
    deprel: str
    head: int
    parent: Word | None = None
    helpers: list[Word] = field(default_factory=list)


@dataclass
class Treebank:
    characters: str = ""
    tokens: list[tuple[int, int]] = field(default_factory=list)
    sentences: list[tuple[int, int]] = field(default_factory=list)
    words: list[Word] = field(default_factory=list)


class Malformed(ValueError):
    pass


def _cells(line: str, at: int) -> list[str]:
    cells = line.split("\t")
    if len(cells) != 10:
        raise Malformed(f"line {at}: {len(cells)} columns of 10")
    return cells


def _whole(text: str, what: str, at: int) -> int:
    try:
        return int(text)
    except ValueError:
        raise Malformed(f"line {at}: {what} {text!r}") from None


def load(text: str) -> Treebank:
    """A checked treebank: ten columns, word numbers in order, heads inside the sentence, one root, no cycle, no empty
    form, an empty line behind each sentence. Empty nodes are left out, spaces in forms dropped, features that are not
    universal and subtypes of relations ignored."""
    bank, place = Treebank(), 0
    lines = text.removesuffix("\n").split("\n") if text else []
    rows: list[tuple[int, list[str]]] = []
    for at, line in enumerate(lines, 1):
        line = line.rstrip("\r")
        if line.startswith("#") and not rows:
            continue
        if line:
            rows.append((at, _cells(line, at)))
        elif rows:
            place = _sentence(bank, rows, place)
            rows = []
        else:
            raise Malformed(f"line {at}: 0 roots")
    if rows:
        raise Malformed("no empty line at the end")
    return bank


def _sentence(bank: Treebank, rows: list[tuple[int, list[str]]], place: int) -> int:
    begin, words, inside = place, [], 0
    for at, cells in rows:
        several = inside > 0
        if several:  # a word of the token before, whatever its number says
            inside -= 1
        elif "." in cells[0]:
            continue
        else:
            form = "".join(c for c in cells[1] if unicodedata.category(c) != "Zs")
            if not form:
                raise Malformed(f"line {at}: empty form")
            bank.characters += form
            bank.tokens.append((place, place + len(form)))
            place += len(form)
            if "-" in cells[0]:
                first, _, last = cells[0].partition("-")
                inside = _whole(last, "range", at) - _whole(first, "range", at) + 1
                continue
            if _whole(cells[0], "number", at) != len(words) + 1:
                raise Malformed(f"line {at}: number {cells[0]}, expected {len(words) + 1}")
            cells = [cells[0], form, *cells[2:]]
        feats = "|".join(sorted(x for x in cells[5].split("|") if x.split("=", 1)[0] in FEATURES))
        words.append(Word(*bank.tokens[-1], several, cells[1], cells[2], cells[3], cells[4], feats, cells[7].split(":")[0], _whole(cells[6], "head", at)))
    if inside:
        raise Malformed(f"line {rows[-1][0]}: a range without its words")
    at = rows[-1][0]
    for w in words:
        if not 0 <= w.head <= len(words):
            raise Malformed(f"line {at}: head {w.head} outside the sentence")
        w.parent = words[w.head - 1] if w.head else None
    if sum(w.parent is None for w in words) != 1:
        raise Malformed(f"line {at}: {sum(w.parent is None for w in words)} roots")
    for w in words:
        up, steps = w, 0
        while up is not None and steps <= len(words):
            up, steps = up.parent, steps + 1
        if up is not None:
            raise Malformed(f"line {at}: a cycle")
        if w.parent is not None and w.deprel in FUNCTION:
            w.parent.helpers.append(w)
    bank.words += words
    bank.sentences.append((begin, place))
    return place


def _stretches(words: list[Word]) -> list[tuple[int, int]]:
    """Unions of overlapping tokens that stand for several words."""
    out: list[list[int]] = []
    for s, e in sorted({(w.start, w.end) for w in words if w.several}):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _common(a: list[Word], b: list[Word]) -> list[tuple[Word, Word]]:
    """Pairs of a longest common subsequence of lower-case forms, as early as can be."""
    left, right = [w.form.lower() for w in a], [w.form.lower() for w in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], 1 + best[i + 1][j + 1] if left[i] == right[j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if left[i] == right[j]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def align(gold: list[Word], system: list[Word]) -> list[tuple[Word, Word]]:
    """Pairs of words of two sides over the same characters."""
    zones = _stretches(gold + system)
    pairs: list[tuple[Word, Word]] = []
    for s, e in zones:
        inside = lambda ws: [w for w in ws if s <= w.start and w.end <= e]  # noqa: E731, B023
        pairs += _common(inside(gold), inside(system))
    free = lambda w: not w.several and not any(s <= w.start and w.end <= e for s, e in zones)
    place = {(w.start, w.end): w for w in system if free(w)}
    return pairs + [(w, place[w.start, w.end]) for w in gold if free(w) and (w.start, w.end) in place]


def score(gold: Treebank, system: Treebank) -> dict[str, tuple[int, int, int, int]]:
    """Measure to (gold, system, correct, aligned) counts."""
    if gold.characters != system.characters:
        raise Malformed("the sides have different characters")
    pairs = align(gold.words, system.words)
    of = {id(s): g for g, s in pairs}
    counterpart = lambda w: of.get(id(w), "none") if w is not None else None
    own = lambda w: w
    lemma = lambda w, to: "_" if to is not own and getattr(counterpart(w), "lemma", "") == "_" or to is own and w.lemma == "_" else w.lemma

    def helpers(w: Word, to):
        return [(to(c), c.deprel, c.upos, c.feats) for c in w.helpers]

    keys = {
        "Words": None,
        "UPOS": lambda w, to: w.upos,
        "XPOS": lambda w, to: w.xpos,
        "UFeats": lambda w, to: w.feats,
        "AllTags": lambda w, to: (w.upos, w.xpos, w.feats),
        "Lemmas": lemma,
        "UAS": lambda w, to: to(w.parent),
        "LAS": lambda w, to: (to(w.parent), w.deprel),
        "CLAS": lambda w, to: (to(w.parent), w.deprel),
        "MLAS": lambda w, to: (to(w.parent), w.deprel, w.upos, w.feats, helpers(w, to)),
        "BLEX": lambda w, to: (to(w.parent), w.deprel, lemma(w, to)),
    }
    out = {}
    for name, a, b in (("Tokens", gold.tokens, system.tokens), ("Sentences", gold.sentences, system.sentences)):
        same = len(set(a) & set(b))
        out[name] = (len(a), len(b), same, same)
    for name, key in keys.items():
        counts = (lambda w: w.deprel in CONTENT) if name in ("CLAS", "MLAS", "BLEX") else (lambda w: True)
        judged = [(g, s) for g, s in pairs if counts(g)]
        good = len(judged) if key is None else sum(key(g, own) == key(s, counterpart) for g, s in judged)
        out[name] = (sum(map(counts, gold.words)), sum(map(counts, system.words)), good, len(judged))
    return out


_FOUND = T.ArrayType(T.StructType([T.StructField("measure", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("gold", "system", "correct", "aligned"))]))


@F.pandas_udf(_FOUND)
def _scores(gold: pd.Series, system: pd.Series) -> pd.Series:
    return pd.Series([[{"measure": m, "gold": a, "system": b, "correct": c, "aligned": d} for m, (a, b, c, d) in score(load(g), load(s)).items()] for g, s in zip(gold, system, strict=True)])


@F.pandas_udf(T.StringType())
def fault(text: pd.Series) -> pd.Series:
    """What is wrong with a treebank text, null if nothing."""

    def said(t: str) -> str | None:
        try:
            load(t)
        except Malformed as e:
            return str(e)
        return None

    return pd.Series([said(t or "") for t in text])


def f1(correct: Column, gold: Column, system: Column) -> Column:
    return F.coalesce(F.try_divide(2 * correct, gold + system), F.lit(0.0))


def treebank_scores(gold: DataFrame, system: DataFrame, *group: str, doc: str = "doc", text: str = "text") -> DataFrame:
    """(group..., measure, gold, system, correct, aligned, precision, recall, f1, accuracy): counts of documents are
    summed. group names columns of `gold`. A document that the system side lacks is an error."""
    both = gold.select(*group, doc, F.col(text).alias("g")).join(system.select(doc, F.col(text).alias("s")), doc, "left")
    each = both.select(*group, F.explode(_scores("g", F.coalesce("s", F.raise_error(F.lit("a document has no system text"))))).alias("x")).select(*group, "x.*")
    total = each.groupBy(*group, "measure").agg(*(F.sum(c).alias(c) for c in ("gold", "system", "correct", "aligned")))
    c, g, s, a = (F.col(x) for x in ("correct", "gold", "system", "aligned"))
    safe = lambda x: F.coalesce(F.try_divide(c, x), F.lit(0.0))
    return total.select(*group, "measure", "gold", "system", "correct", "aligned", safe(s).alias("precision"), safe(g).alias("recall"), f1(c, g, s).alias("f1"), safe(a).alias("accuracy"))


def native_scores(words: DataFrame, *group: str) -> DataFrame:
    """Sums of joint decoding: share right of xpos, script, upos, heads (uas) and heads with labels (las). Columns gold_x
    and pred_x; a gold label of -100 was never seen in training: it counts as wrong, but for xpos as right."""
    same = lambda c: F.col(f"gold_{c}") == F.col(f"pred_{c}")
    rate = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("int"))
    seen = lambda c: F.col(f"gold_{c}") != -100
    return words.groupBy(*group).agg(
        F.count("*").alias("n"),
        rate(same("xpos") | ~seen("xpos")).alias("xpos"),
        *(rate(same(c) & seen(c)).alias(c) for c in ("script", "upos")),
        rate(same("head")).alias("uas"),
        rate(same("head") & same("deprel")).alias("las"),
    )


def known_lemma_accuracy(tokens: DataFrame, lexicon: DataFrame, width: int = 9) -> DataFrame:
    """One row: accuracy of lemmas of forms that the lexicon has and of those it lacks, their numbers, and the accuracy of
    each place of the tag. tokens: key, lemma, xpos, pred_lemma, pred_xpos; lexicon: key."""
    known = lexicon.select("key").distinct().withColumn("known", F.lit(True))
    t = tokens.join(known, "key", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("right", F.col("lemma") == F.col("pred_lemma"))
    part = lambda test, name: (F.count_if(test).alias(f"n_{name}"), F.try_divide(F.count_if(test & F.col("right")), F.count_if(test)).alias(name))
    place = [F.avg((F.substring(F.rpad(F.coalesce("xpos", F.lit("")), width, "-"), i, 1) == F.substring(F.rpad(F.coalesce("pred_xpos", F.lit("")), width, "-"), i, 1)).cast("int")) for i in range(1, width + 1)]
    return t.agg(*part(F.col("known"), "in_vocabulary"), *part(~F.col("known"), "out_of_vocabulary"), F.array(*place).alias("places"))


def coverage(tokens: DataFrame, scripts: DataFrame, tags: DataFrame, forms: DataFrame, lemmas: DataFrame) -> DataFrame:
    """One row: the share of tokens (script, tag, key, lemma) whose script, tag, form, and lemma for the form, a training
    vocabulary has."""
    mark = lambda df, on, name: df.select(*on).distinct().withColumn(name, F.lit(1))
    t = tokens.join(mark(scripts, ["script"], "s"), "script", "left").join(mark(tags, ["tag"], "t"), "tag", "left")
    t = t.join(mark(forms, ["key"], "f"), "key", "left").join(mark(lemmas, ["key", "lemma"], "l"), ["key", "lemma"], "left")
    return t.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(c, F.lit(0))).alias(n) for c, n in (("s", "script"), ("t", "tag"), ("f", "form"), ("l", "lemma"))))
