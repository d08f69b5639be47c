"""A text as aligned arrays, one entry a Greek letter: letter, boundary, marks, case, stop.

Built from Unicode decompositions: letters are numbered in alphabetical order, marks attach to the letter
before, and each letter's boundary and punctuation are the strongest in the gap that follows. What a
character is gets decided once a distinct character; a text's arrays are gathers and segment maxima.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The alphabet, variants of letters, archaic letters, marks by class, stops by class.
ALPHABET = "αβγδεζηθικλμνξοπρστυφχψω"
VARIANTS = {"ς": "σ", "ϲ": "σ", "ϐ": "β", "ϑ": "θ", "ϰ": "κ", "ϕ": "φ", "ϱ": "ρ", "ϖ": "π"}
ARCHAIC = "ϝϜϙϘϟϞϡϠϛϚͱͰͳͲϻϺϸϷ"
ACCENTS = {"́": 1, "̀": 2, "͂": 3, "̂": 3}
BREATHINGS = {"̓": 1, "̔": 2}
IOTA, DIAERESIS = "ͅ", "̈"
STOPS = {",": 1, "·": 2, "·": 2, ":": 3, ".": 4, ";": 5, ";": 5, "?": 5, "!": 5}
SENTENCE = ".;;!?؟"
#: Ids of a lost letter and of what is unknown about it; widths that stand in for a gap of unknown length.
LOST, UNKNOWN_BOUNDARY, UNKNOWN_MARKS, UNKNOWN_STOP = 24, 3, 48, 6
GAP_WIDTHS = (20, 30)
_ID = {c: i for i, c in enumerate(ALPHABET)}
FIELDS = ("chars", "boundary", "dia", "cap", "punct")


class Trait(NamedTuple):
    """What one decomposed character contributes."""

    letter: int = -1
    cap: int = 0
    accent: int = 0
    breathing: int = 0
    iota: int = 0
    diaeresis: int = 0
    mark: int = 0
    weight: int = 0
    stop: int = 0
    latin: int = 0


@functools.cache
def trait(ch: str) -> Trait:
    low, kind = ch.lower(), unicodedata.category(ch)
    base = VARIANTS.get(low, low)
    if base in _ID:
        return Trait(letter=_ID[base], cap=int(ch != low))
    if kind[0] == "M":
        return Trait(mark=1, accent=ACCENTS.get(ch, 0), breathing=BREATHINGS.get(ch, 0), iota=int(ch == IOTA), diaeresis=int(ch == DIAERESIS))
    latin = int("a" <= low <= "z")
    weight = 2 if ch in SENTENCE else int(ch in ARCHAIC or latin or ch.isspace() or ch.isdigit() or kind[0] in "PS")
    return Trait(weight=weight, stop=STOPS.get(ch, 0), latin=latin)


#: Traits by code point, filled in as characters are met.
_TRAITS, _MET = np.zeros((len(Trait._fields), 0x110000), np.int8), np.zeros(0x110000, bool)
_COLUMN = dict(zip(Trait._fields, _TRAITS, strict=True))


def _learn(codes: np.ndarray) -> None:
    met = _MET[codes]
    if not met.all():
        new = np.unique(codes[~met])
        _TRAITS[:, new] = np.array([trait(chr(c)) for c in new.tolist()], np.int8).T
        _MET[new] = True


@functools.cache
def is_letter(ch: str) -> bool:
    """Whether a character, composed or not, makes a letter of the planes."""
    return trait(unicodedata.normalize("NFD", ch)[0]).letter >= 0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: is_letter by code point, -1 where it was not asked yet.
_LETTER = np.full(0x110000, -1, np.int8)


def are_letters(codes: np.ndarray) -> np.ndarray:
    """is_letter of each code point, as 0 and 1."""
    found = _LETTER[codes]
    if (found < 0).any():
        new = np.unique(codes[found < 0])
        _LETTER[new] = [is_letter(chr(c)) for c in new.tolist()]
        found = _LETTER[codes]
    return found


def pack(accent, breathing, iota, diaeresis):
    return ((accent * 3 + breathing) * 2 + iota) * 2 + diaeresis


def unpack(d):
    d, diaeresis = np.divmod(d, 2)
    d, iota = np.divmod(d, 2)
    return (*np.divmod(d, 3), iota, diaeresis)


@dataclass
class Planes:
    chars: np.ndarray
    boundary: np.ndarray
    dia: np.ndarray
    cap: np.ndarray
    punct: np.ndarray
    orphans: int = 0
    conflicts: int = 0

    def __len__(self) -> int:
        return len(self.chars)

    def part(self, s: int, e: int) -> Planes:
        return Planes(*(getattr(self, f)[s:e] for f in FIELDS))


def analyse(text: str | None, least_share: float = 0.95) -> Planes | str:
    """Planes, or why there are none: "empty" without a Greek letter, "foreign" where fewer than
    `least_share` of the Greek and Latin letters are Greek."""
    raw = unicodedata.normalize("NFD", text or "")
    codes = code_points(raw)
    _learn(codes)
    letter = _COLUMN["letter"][codes]
    at = np.flatnonzero(letter >= 0)
    if not len(at):
        return "empty"
    col = {f: _COLUMN[f][codes] for f in Trait._fields}
    if len(at) < least_share * (len(at) + col["latin"].sum(dtype=np.int64)):
        return "foreign"
    # everything from a letter to the next one belongs to it; what comes before the first one to none
    gap = lambda f: np.maximum.reduceat(col[f], at).astype(np.int64) if col[f].any() else np.zeros(len(at), np.int64)
    conflicts = 0
    if col["mark"].any():
        own = np.cumsum(letter >= 0) - 1
        conflicts = sum(int((np.bincount(own[m], minlength=len(at)) > 1).sum()) for f in ("accent", "breathing") for m in [(col[f] > 0) & (own >= 0)])
    boundary = gap("weight")
    boundary[-1] = 2
    dia = pack(gap("accent"), gap("breathing"), gap("iota"), gap("diaeresis"))
    return Planes(letter[at].astype(np.int64), boundary, dia, col["cap"][at].astype(np.int64), gap("stop"), int(col["mark"][: at[0]].sum(dtype=np.int64)), conflicts)


def encode(text: str | None, least_share: float = 0.95) -> Planes | None:
    """Planes as lists, or None where the text is rejected."""
    p = analyse(text, least_share)
    return None if isinstance(p, str) else Planes(*(getattr(p, f).tolist() for f in FIELDS), p.orphans, p.conflicts)


def decode(p: Planes, marks: bool = True) -> str:
    """Text of planes: words, and sentences ended by a stop; with accents and case where `marks`."""
    ends = ["", " ", ". "]
    if not marks:
        return "".join(ALPHABET[c] + ends[b] for c, b in zip(p.chars, p.boundary, strict=True)).rstrip()
    after = [b for b in p.boundary if b > 0] or [2]
    return "".join(word + ends[b] for word, b in zip(words(p), after, strict=False)).rstrip()


def words(p: Planes) -> list[str]:
    """The composed words with accents, case and final sigma."""
    accent, breathing, iota, diaeresis = unpack(np.asarray(p.dia, np.int64))
    hit = lambda table, v: next((c for c, x in table.items() if x == v), "")
    cut = np.flatnonzero(np.asarray(p.boundary) > 0) + 1
    out = []
    for piece in np.split(np.arange(len(p)), cut):
        if len(piece):
            letters = [(ALPHABET[p.chars[i]].upper() if p.cap[i] else ALPHABET[p.chars[i]]) + hit(BREATHINGS, breathing[i]) + DIAERESIS * int(diaeresis[i]) + hit(ACCENTS, accent[i]) + IOTA * int(iota[i]) for i in piece]
            word = "".join(letters)
            out.append(unicodedata.normalize("NFC", word[:-1] + "ς" if word.endswith("σ") else word))
    return out


def plain_planes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(letters, boundary) of accentless text with single spaces and `-` for each lost letter; a space sets
    the boundary of the letter before, other characters go."""
    kept = [c for c in text if c in _ID or c in " -"]
    solid = np.array([c != " " for c in kept], bool)
    chars = np.array([_ID.get(c, LOST) for c in kept if c != " "], np.int64)
    boundary = np.where(chars == LOST, UNKNOWN_BOUNDARY, 0)
    after = np.cumsum(solid)[~solid] - 1
    boundary[after[after >= 0]] = 1
    return chars, boundary


DAMAGE = re.compile(r"-+|…+")


def full_planes(text: str, key: str = "", least_share: float = 0.95) -> tuple[Planes, np.ndarray] | None:
    """Planes of a damaged text, lost letters in place, and which entries are lost. A run of `-` is as long as it
    is; a run of `…` gets a width of GAP_WIDTHS by a hash of key and its number. None if some stretch is rejected."""
    parts, lost = [], []
    gaps = DAMAGE.findall(text)
    for i, stretch in enumerate(DAMAGE.split(text)):
        if stretch.strip():
            p = analyse(stretch, least_share)
            if isinstance(p, str):
                return None
            parts.append(p), lost.append(np.zeros(len(p), bool))
        if i < len(gaps):
            low, high = GAP_WIDTHS
            n = len(gaps[i]) if gaps[i][0] == "-" else low + zlib.crc32(f"{key}:{i}".encode()) % (high - low + 1)
            parts.append(Planes(*(np.full(n, x, np.int64) for x in (LOST, UNKNOWN_BOUNDARY, UNKNOWN_MARKS, 0, UNKNOWN_STOP))))
            lost.append(np.ones(n, bool))
    return (joined(parts), np.concatenate(lost)) if parts else None


def joined(parts: list[Planes]) -> Planes:
    return Planes(*(np.concatenate([getattr(p, f) for p in parts]) for f in FIELDS))


def line_breaks(edition: str) -> tuple[list[int], int]:
    """Ordinals of the letters (and lost letters) before which an edition breaks its lines with `|`, and how many
    letters there are. Tags and {..} go with what they hold, brackets alone go."""
    bare = re.sub(r"&lt;|&gt;", "", re.sub(r"<[^>]+>", " ", edition))
    bare = re.sub(r"[\[\]]", "", re.sub(r"\{[^{}]*\}", "", bare))
    base = [unicodedata.normalize("NFD", c)[0] for c in bare]
    counts = np.cumsum([b == "-" or unicodedata.category(b)[0] == "L" and (0x370 <= ord(b) <= 0x3FF or 0x1F00 <= ord(b) <= 0x1FFF) for b in base], dtype=np.int64)
    return [int(n) for n, c in zip(counts, bare, strict=True) if c == "|"], int(counts[-1]) if len(counts) else 0


_PLANE = T.StructType([*(T.StructField(f, T.ArrayType(T.ByteType())) for f in FIELDS), T.StructField("dropped", T.StringType()), T.StructField("orphans", T.IntegerType()), T.StructField("conflicts", T.IntegerType())])


@F.pandas_udf(_PLANE)
def planes(text: pd.Series) -> pd.DataFrame:
    """Planes of each text; null arrays and the reason in `dropped` where it is rejected."""
    rows = []
    for t in text:
        p = analyse(t)  # eight bytes a letter and field, which go before the next text comes
        rows.append((*[None] * len(FIELDS), p, 0, 0) if isinstance(p, str) else (*(getattr(p, f).astype(np.int8) for f in FIELDS), None, p.orphans, p.conflicts))
    return pd.DataFrame(dict(zip(_PLANE.names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(_PLANE.names), strict=True)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def plane_words(p: pd.DataFrame) -> pd.Series:
    """Words of a column of planes, null where there are none."""
    return pd.Series([words(Planes(*(np.asarray(row[f], np.int64) for f in FIELDS))) if row["chars"] is not None else None for row in p.to_dict("records")])


_FULL = T.StructType([*(T.StructField(f, T.ArrayType(T.ByteType())) for f in FIELDS), T.StructField("lost", T.ArrayType(T.BooleanType()))])


@F.pandas_udf(_FULL)
def damaged_planes(text: pd.Series, key: pd.Series) -> pd.DataFrame:
    found = [full_planes(t or "", str(k)) for t, k in zip(text, key, strict=True)]
    return pd.DataFrame({f: [getattr(x[0], f).astype(np.int8) if x else None for x in found] for f in FIELDS} | {"lost": [x[1] if x else None for x in found]})


@F.pandas_udf(T.StructType([T.StructField("breaks", T.ArrayType(T.IntegerType())), T.StructField("n", T.IntegerType())]))
def break_ordinals(edition: pd.Series) -> pd.DataFrame:
    found = [line_breaks(x or "") for x in edition]
    return pd.DataFrame({"breaks": [x[0] for x in found], "n": [x[1] for x in found]})


def plane_statistics(docs: DataFrame, *group: str, text: str = "text") -> DataFrame:
    """What became of records: taken, dropped by reason, letters, words, sentences, marks without a letter or on top
    of another of their class; sums over tasks before the shuffle."""
    p = docs.select(*group, planes(text).alias("p"))
    count = lambda f, test: F.sum(F.coalesce(F.size(F.filter(F.col(f"p.{f}"), test)), F.lit(0))).cast("long")
    return p.groupBy(*group).agg(
        F.count("*").alias("records"),
        F.count("p.chars").alias("kept"),
        F.count_if(F.col("p.dropped") == "empty").alias("empty"),
        F.count_if(F.col("p.dropped") == "foreign").alias("foreign"),
        F.sum(F.coalesce(F.size("p.chars"), F.lit(0))).cast("long").alias("letters"),
        count("boundary", lambda b: b >= 1).alias("words"),
        count("boundary", lambda b: b == 2).alias("sentences"),
        F.sum("p.orphans").cast("long").alias("orphans"),
        F.sum("p.conflicts").cast("long").alias("conflicts"),
    )


def gap_split(text: str, least: int, damage: str = "-+|…+"):
    """Array of (seg, text): stretches of a text between its damaged runs that have `least` characters."""
    parts = F.transform(F.split(text, damage), lambda s, i: F.struct(i.alias("seg"), F.trim(s).alias("text")))
    return F.filter(parts, lambda p: F.length(p["text"]) >= least)
