"""Length marks and scansion as labels of letters: parsing, writing, ambiguity, syllables, scores.

A label is (ordinal of a letter, class). Ordinals count the letters of the planes, so labels and planes are aligned.
Length: 0 long, 1 short. Scansion: 0 none, 1 a heavy syllable ends here, 2 a light one, 3 the verse.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from array import array
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import planes as P

LONG, SHORT = 0, 1
NONE, HEAVY, LIGHT, VERSE = 0, 1, 2, 3
#: How lengths are written, vowels of two lengths, all vowels, diphthongs.
LENGTHS = {"_": LONG, "̄": LONG, "^": SHORT, "̆": SHORT}
DICHRONA, VOWELS = "αιυ", "αεηιουω"
DIPHTHONGS = "αι αυ ει ευ ηυ οι ου υι ωυ".split()
_PAIRS = np.zeros((25, 25), bool)
for _a, _b in DIPHTHONGS:
    _PAIRS[P.ALPHABET.index(_a), P.ALPHABET.index(_b)] = True


def _ordinals(text: str) -> list[int]:
    """Letters up to and with each character."""
    return list(accumulate(map(P.is_letter, text), initial=0))[1:]


def read_lengths(marked: str) -> tuple[str, dict[int, int]]:
    """The plain text and the length marks of its letters; the last mark of a letter counts."""
    raw = unicodedata.normalize("NFD", marked)
    upto = _ordinals(raw)
    labels = {n - 1: LENGTHS[c] for c, n in zip(raw, upto, strict=True) if c in LENGTHS and n}
    return unicodedata.normalize("NFC", "".join(c for c in raw if c not in LENGTHS)), labels


def write_lengths(plain: str, labels: dict[int, int]) -> str:
    """`_` or `^` after each labelled letter and its combining marks."""
    text = unicodedata.normalize("NFC", plain)
    clusters = re.findall(r"(?s).[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯]*", text)
    upto = _ordinals([c[0] for c in clusters])
    return "".join(c + ("_^"[labels[n - 1]] if P.is_letter(c[0]) and n - 1 in labels else "") for c, n in zip(clusters, upto, strict=True))


_SPAN = re.compile(r"\[([^\]]*)\]|\{([^}]*)\}")


def read_scansion(bracketed: str) -> tuple[str, dict[int, int]] | None:
    """The plain text and the scansion of [heavy] and {light} spans: the class stands on a span's last letter, and
    the line's last one is the verse's end. None without spans that hold a letter."""
    spans = np.array([m.span() for m in _SPAN.finditer(bracketed)], np.int64).reshape(-1, 2)
    codes = P.code_points(bracketed)
    upto = np.concatenate(([0], np.cumsum(P.are_letters(codes))))
    spans = spans[upto[spans[:, 1]] > upto[spans[:, 0]]]
    if not len(spans):
        return None
    labels = np.where(codes[spans[:, 0]] == ord("["), HEAVY, LIGHT)
    labels[-1] = VERSE
    return unicodedata.normalize("NFC", _SPAN.sub(r"\1\2", bracketed)), dict(zip((upto[spans[:, 1]] - 1).tolist(), labels.tolist(), strict=True))


def write_scansion(plain: str, labels: dict[int, int]) -> str:
    """[heavy] and {light} spans, the verse's last one as heavy; text behind the last label stays bare."""
    text = unicodedata.normalize("NFC", plain)
    upto, out, start = _ordinals(text), [], 0
    for i, c in enumerate(text):
        label = labels.get(upto[i] - 1, NONE) if P.is_letter(c) else NONE
        if label:
            out.append(("{%s}" if label == LIGHT else "[%s]") % text[start : i + 1])
            start = i + 1
    return "".join(out) + text[start:]


def ambiguous(chars: np.ndarray, boundary: np.ndarray, dia: np.ndarray) -> np.ndarray:
    """Letters whose length the spelling leaves open: α, ι, υ without circumflex and iota, outside diphthongs; a
    diaeresis on the second vowel, or the end of a word, parts a pair."""
    chars = np.asarray(chars, np.int64)
    accent, _, iota, diaeresis = P.unpack(np.asarray(dia, np.int64))
    pair = _PAIRS[chars[:-1], chars[1:]] & (np.asarray(boundary)[:-1] == 0) & (diaeresis[1:] == 0)
    inside = np.append(pair, False) | np.insert(pair, 0, False) if len(chars) else pair[:0]
    return np.isin(chars, [P.ALPHABET.index(c) for c in DICHRONA]) & (accent != 3) & (iota == 0) & ~inside


def _syllables(labels: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each syllable, which ends with its label."""
    return list(pairwise([0, *(np.flatnonzero(labels) + 1).tolist()]))


def join_vowelless(chars: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A syllable without a vowel is joined to the one before and keeps its own class; a first one stays."""
    out, vowel, seen = np.array(labels), np.isin(chars, [P.ALPHABET.index(c) for c in VOWELS]), []
    for s, e in _syllables(out):
        if seen and not vowel[s:e].any():
            out[seen.pop()] = NONE
        seen.append(e - 1)
    return out


def circumflex_heavy(dia: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Light syllables with a circumflex become heavy."""
    out, long = np.array(labels), P.unpack(np.asarray(dia, np.int64))[0] == 3
    for s, e in _syllables(out):
        if out[e - 1] == LIGHT and long[s:e].any():
            out[e - 1] = HEAVY
    return out


_LABELS = T.StructType([T.StructField("plain", T.StringType()), T.StructField("labels", T.MapType(T.IntegerType(), T.IntegerType()))])


def _parsed(read):
    def run(text: pa.Array) -> pa.Array:
        # of each text only its plain form and two numbers a label are kept, not a dictionary
        plain, sizes, keys, values = [], [], array("i"), array("i")
        for t in text:
            x = read(t.as_py()) if t.is_valid else None
            plain.append(x[0] if x else None), sizes.append(len(x[1]) if x else 0)
            if x:
                keys.extend(x[1]), values.extend(x[1].values())
        none = np.array([x is None for x in plain], bool)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        offsets = pa.array(ends.astype(np.int32), mask=np.append(none, False))
        labels = pa.MapArray.from_arrays(offsets, pa.array(np.frombuffer(keys, np.int32)), pa.array(np.frombuffer(values, np.int32)))
        return pa.StructArray.from_arrays([pa.array(plain, pa.string()), labels], ["plain", "labels"], mask=pa.array(none))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _LABELS)


length_labels, scansion_labels = _parsed(read_lengths), _parsed(read_scansion)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def ambiguous_letters(p: pd.DataFrame) -> pd.Series:
    """Of a column of planes."""
    return pd.Series([ambiguous(r["chars"], r["boundary"], r["dia"]) if r["chars"] is not None else None for r in p.to_dict("records")])


def _mean_recall(classes: tuple[int, ...]) -> Column:
    """The mean of the recalls of the classes that occur."""
    each = [F.try_divide(F.count_if((F.col("g") == c) & (F.col("p") == c)), F.count_if(F.col("g") == c)) for c in classes]
    known = F.filter(F.array(*each), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def _f1(positive: Column, said: Column) -> Column:
    return F.coalesce(F.try_divide(2 * F.count_if(positive & said), F.count_if(positive) + F.count_if(said)), F.lit(0.0))


def length_scores(pairs: DataFrame, *group: str, missing: int = LONG) -> DataFrame:
    """n, accuracy, F1 of long and short, balanced accuracy of (gold, pred) columns g and p; a letter without a
    prediction counts as `missing`."""
    both = pairs.withColumn("p", F.coalesce("p", F.lit(missing)))
    f1 = [_f1(F.col("g") == c, F.col("p") == c).alias(f"{name}_f1") for name, c in (("long", LONG), ("short", SHORT))]
    return both.groupBy(*group).agg(F.count("*").alias("n"), F.avg((F.col("g") == F.col("p")).cast("int")).alias("acc"), *f1, _mean_recall((LONG, SHORT)).alias("bal_acc"))


def scansion_scores(pairs: DataFrame, *group: str) -> DataFrame:
    """n, accuracy, balanced accuracy over four classes, F1 of where syllables end, and accuracy of the weight where both
    sides end a heavy or light one."""
    g, p = F.col("g"), F.col("p")
    weighed = g.isin(HEAVY, LIGHT) & p.isin(HEAVY, LIGHT)
    return pairs.groupBy(*group).agg(F.count("*").alias("n"), F.avg((g == p).cast("int")).alias("acc"), _mean_recall((NONE, HEAVY, LIGHT, VERSE)).alias("bal_acc"), _f1(g > 0, p > 0).alias("boundary_f1"), F.try_divide(F.count_if(weighed & (g == p)), F.count_if(weighed)).alias("weight_acc"))


def length_pairs(lines: DataFrame, gold: str, pred: str, *keep: str) -> DataFrame:
    """A row a marked letter of the gold line: (keep..., ordinal, g, p). Lines whose plain texts differ are an error."""
    both = lines.select(*keep, length_labels(gold).alias("a"), length_labels(pred).alias("b"))
    both = both.withColumn("a", F.when(F.col("a.plain") == F.col("b.plain"), F.col("a")).otherwise(F.raise_error(F.lit("plain texts differ"))))
    return both.select(*keep, F.explode("a.labels").alias("ordinal", "g"), F.col("b.labels").alias("bl")).select(*keep, "ordinal", "g", F.try_element_at("bl", "ordinal").alias("p"))


def scansion_pairs(lines: DataFrame, gold: str, pred: str, *keep: str) -> DataFrame:
    """A row a letter of the gold line, 0 where no syllable ends; lines without gold syllables are left out."""
    both = lines.select(*keep, scansion_labels(gold).alias("a"), scansion_labels(pred).alias("b"))
    n = letter_count("a.plain")
    rows = both.where("a is not null").select(*keep, "a", "b", n.alias("n")).where("n > 0").select(*keep, "a", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))
    label = lambda side: F.coalesce(F.try_element_at(f"{side}.labels", "ordinal"), F.lit(0))
    return rows.select(*keep, "ordinal", label("a").alias("g"), label("b").alias("p"))


@F.pandas_udf(T.IntegerType())
def letter_count(text: pd.Series) -> pd.Series:
    return pd.Series([sum(map(P.is_letter, t)) if t is not None else 0 for t in text])


def default_report(pairs: DataFrame, *group: str) -> DataFrame:
    """Of (gold, pred) columns g and p, p null where nothing was predicted: the share that is right as predicted, of
    marking every letter short, and of predictions with short for the rest; what that gains over marking all short;
    and letters without a prediction."""
    g, p = F.col("g"), F.col("p")
    rate = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("int"))
    out = pairs.groupBy(*group).agg(F.count("*").alias("n"), rate(g == p).alias("raw"), rate(g == SHORT).alias("trivial"), rate(g == F.coalesce(p, F.lit(SHORT))).alias("default_short"), F.count_if(p.isNull()).alias("unpredicted"))
    return out.withColumn("improvement", F.col("default_short") - F.col("trivial"))


def tiled(line: str) -> list[str]:
    """What the brackets of a scanned line hold once text outside them is moved in: text behind a bracket goes to its
    end, text before the first to its start."""
    pieces = re.findall(r"\[([^\[\]{}]*)\]|\{([^\[\]{}]*)\}|([^\[\]{}]+)", line)
    out, lead = [], ""
    for square, curly, bare in pieces:
        if not bare:
            out.append(lead + square + curly)
            lead = ""
        elif out:
            out[-1] += bare
        else:
            lead = bare
    return out


def open_flags(line: str) -> tuple[str, list[bool]]:
    """The text of a scanned line, and for each character whether its syllable ends in a vowel, whatever the weight."""
    syllables = tiled(line)
    last = [next((c for c in reversed(x) if c.isalpha()), "") for x in syllables]
    vowel = [bool(c) and unicodedata.normalize("NFD", c)[0].lower() in VOWELS for c in last]
    return "".join(syllables), [v for x, v in zip(syllables, vowel, strict=True) for _ in x]


def transferred(flags: list[bool], source: str, target: str) -> list[bool | None]:
    """Flags of one text's characters on those of another where the two agree; elsewhere null."""
    out: list[bool | None] = [None] * len(target)
    for block in difflib.SequenceMatcher(None, source, target, autojunk=False).get_matching_blocks():
        out[block.b : block.b + block.size] = flags[block.a : block.a + block.size]
    return out


def listed_flags(text: str, stoplist: set[str]) -> list[bool]:
    """Whether each character stands in a word of the stoplist, as written or without what is no letter at its ends."""
    out = [False] * len(text)
    for m in re.finditer(r"\S+", text):
        core = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", m.group())
        if m.group() in stoplist or core in stoplist:
            out[m.start() : m.end()] = [True] * len(m.group())
    return out


def marked_by(fn, batched: bool = False):
    """A pandas UDF that marks lines with a callback str -> str. Batched, the lines of a batch go to it at once, one under
    the other; where it fails or gives another number of lines, they go one by one, and a line that fails stays unmarked."""

    def one(text: str) -> str:
        try:
            return fn(text)
        except Exception:  # a line that the callback cannot mark counts as unmarked
            return text

    @F.pandas_udf(T.StringType())
    def run(lines: pd.Series) -> pd.Series:
        texts = [t or "" for t in lines]
        if batched and not any("\n" in t for t in texts):
            out = one("\n".join(texts)).split("\n")
            if len(out) == len(texts) and out != texts:
                return pd.Series(out)
        return pd.Series([one(t) for t in texts])

    return run


def scored_positions(lines: DataFrame, scanned: str, marked: str, pred: str, stoplist: list[str], *keep: str) -> DataFrame:
    """(keep..., ordinal, g, p): marked letters of open syllables outside the stoplist, with the mark that a
    prediction gives the same letter (null: none). The stoplist is a short list of words, sent to the workers."""
    stops = set(stoplist)

    def run(scan: pd.Series, gold: pd.Series, said: pd.Series) -> pd.Series:
        out = []
        for s, g, x in zip(scan, gold, said, strict=True):
            (plain, labels), (other, guess) = read_lengths(g or ""), read_lengths(x or "")
            upto = _ordinals(plain)
            char = {n - 1: i for i, n in reversed(list(enumerate(upto))) if n}
            text, flags = open_flags(s or "")
            opened = transferred(flags, text, plain)
            barred = listed_flags(plain, stops)
            place = transferred(list(range(len(other))), other, plain)
            back = _ordinals(other)
            rows = []
            for n, label in labels.items():
                i = char[n]
                if opened[i] and not barred[i]:
                    j = place[i]
                    rows.append({"ordinal": n, "g": label, "p": guess.get(back[j] - 1) if j is not None else None})
            out.append(rows)
        return pd.Series(out)

    kind = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("ordinal", "g", "p")]))
    return lines.select(*keep, F.explode(F.pandas_udf(run, kind)(scanned, marked, pred)).alias("x")).select(*keep, "x.*")


def macro(scores: DataFrame, *columns: str) -> DataFrame:
    """Means of group scores, each group alike."""
    return scores.agg(*(F.avg(c).alias(c) for c in columns))
