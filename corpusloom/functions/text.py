"""Text as Spark columns: folding, skeletons, sentences, keys, n-grams.

All of it is built-in functions, so it stays inside code generation and filters
reach the scan. Two script profiles: `letters` keeps any letter, `greek` only
letters of the Greek blocks, as a matching key for ancient Greek.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter variants that fold to one letter, and the ends of sentences.
VARIANTS = {"ς": "σ", "ϲ": "σ", "Ϲ": "σ", "ϐ": "β", "ϑ": "θ", "ϰ": "κ"}
SENTENCE_END = "[.;!?:··;]+|\\n\\s*\\n"


@functools.cache
def _accents() -> tuple[str, str]:
    """Precomposed letters and their base letters, from the Unicode tables."""
    src, dst = [], []
    for code in range(0xC0, 0x20000):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base != ch and len(base) == 1:
            src.append(ch), dst.append(base)
    return "".join(src), "".join(dst)


def fold(text: Column) -> Column:
    """Accents off, lower case, letter variants folded."""
    src, dst = _accents()
    bare = F.lower(F.regexp_replace(F.translate(text, src, dst), r"\p{Mn}+", ""))
    return F.translate(bare, "".join(VARIANTS), "".join(VARIANTS.values()))


def skeleton(text: Column, profile: str = "letters") -> Column:
    """Folded words joined by one space: what is compared when texts are matched."""
    keep = r"[^\p{L}]+" if profile == "letters" else r"[^\p{InGreek}\p{InGreek_Extended}]+|[^\p{L}\s]+"
    out = F.regexp_replace(fold(text), keep, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def words(skel: Column) -> Column:
    return F.filter(F.split(skel, " "), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Skeletons of the sentences that have one."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: skeleton(s)), lambda s: s != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a column used inside a lambda would be computed anew
    for each element, since Spark puts its expression there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(size: Column, n: int) -> Column:
    return F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))


def ngrams(ws: Column, n: int = 8) -> Column:
    """All n-word windows joined by spaces; none for fewer words."""
    return let(ws, lambda w: F.transform(_starts(F.size(w), n), lambda i: F.array_join(F.slice(w, i, n), " ")))


def gram_hashes(ws: Column, n: int = 8) -> Column:
    """64-bit hashes of the n-word windows, by first word; each word is hashed once and no window is spelled out."""
    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(_starts(F.size(h), n), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(n)])))


def bag_key(skel: Column) -> Column:
    """The words of a skeleton in alphabetical order: equal for reordered sentences."""
    return F.array_join(F.array_sort(words(skel)), " ")


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def shingles(s: Column, n: int) -> Column:
    """All runs of n characters; cut from an array of them, since finding a place in a string takes a walk to it."""
    return let(characters(s), lambda c: F.transform(_starts(F.size(c), n), lambda i: F.array_join(F.slice(c, i, n), "")))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " "), r"<[^>]*>", " ")


def work_prefix(source: Column, rid: Column, dotted: tuple[str, ...] = ()) -> Column:
    """Id of the work a record belongs to: two dotted parts for the sources named, else
    the part before #."""
    return F.when(source.isin(*dotted) if dotted else F.lit(False), F.array_join(F.slice(F.split(rid, r"\."), 1, 2), ".")).otherwise(F.split_part(rid, F.lit("#"), F.lit(1)))


def collapse(text: Column, n: int) -> Column:
    """White space collapsed, trimmed, cut to n characters for display."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n)


def mutate(text: Column) -> Column:
    """The same words in another spelling: marks off, stops changed, commas dropped."""
    src, dst = _accents()
    bare = F.regexp_replace(F.translate(text, src, dst), r"\p{Mn}+", "")
    return F.translate(bare, ".ς,", "·σ")


def year(text: Column) -> Column:
    """A year from a dirty string: null unless it is a whole number that says something; 999, -999 and -0 do not."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^-?\d+$") & ~bare.isin("-0") & ~F.coalesce(bare.try_cast("int").isin(999, -999), F.lit(True)), bare.try_cast("int"))


def century(low: Column, high: Column) -> Column:
    """Century bucket 0..14 of the midpoint of a year range: 100-year bins from -800;
    15 where no year is known."""
    mid = F.floor((F.coalesce(low, high) + F.coalesce(high, low)) / 2.0)
    # least and greatest pass over nulls
    return F.when(mid.isNull(), 15).otherwise(F.least(F.lit(14), F.greatest(F.lit(0), F.floor((mid + 800) / 100.0)))).cast("int")


#: Letters that a reading text folds, stops that become spaces, regions in order of their ids.
READING = {"ς": "σ", "ϲ": "σ", "ϙ": "κ", "ϛ": "σ"}
FLAT = {"ς": "σ", "ϲ": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϰ": "κ", "ϱ": "ρ", "ϖ": "π"}
REGIONS = (
    "Asia Minor", "Aegean Islands, incl. Crete", "Attica", "Central Greece", "Peloponnesos", "Egypt, Nubia and Cyrenaïca", "Northern Greece", "Greater Syria and the East",
    "Sicily, Italy, and the West", "Thrace and the Lower Danube", "North Shore of the Black Sea", "Cyprus", "Upper Danube", "North Africa", "unknown",
)


def reading_text(text: Column) -> Column:
    """Lower case, white space collapsed, variants of letters folded."""
    bare = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return F.translate(bare, "".join(READING), "".join(READING.values()))


def flat(text: Column) -> Column:
    """Base Greek letters, single spaces and `-` alone; stops and all else become spaces."""
    src, dst = _accents()
    low = F.regexp_replace(F.lower(F.translate(text, src, dst)), r"\p{Mn}+", "")
    base = F.translate(low, "".join(FLAT), "".join(FLAT.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(base, "[^αβγδεζηθικλμνξοπρστυφχψω -]", " "), " +", " "))


def region_id(region: Column) -> Column:
    """The place of a region in REGIONS, the last for all others and null."""
    at = F.array_position(F.array(*map(F.lit, REGIONS)), F.coalesce(region, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(len(REGIONS) - 1).cast("int")


def letters_missing(text: Column) -> Column:
    """N of the first `[N letters missing]`, if it is 1 to 10."""
    n = F.regexp_extract(text, r"\[(\d+) letters? missing\]", 1).try_cast("int")
    return F.when(n.between(1, 10), n)


def gap_widths(text: Column, least: int = 1) -> Column:
    """Widths that the first `[N±M]` allows: from N - M, but `least`, to N + M; null without a marker."""
    n, m = (F.regexp_extract(text, r"\[(\d+)±(\d+)\]", i).try_cast("int") for i in (1, 2))
    low = F.greatest(F.lit(least), n - m)
    return F.when(n.isNotNull() & (low <= n + m), F.sequence(low, n + m))


def with_gap(text: Column, width: Column) -> Column:
    """A text with its first `[N±M]` as so many lost letters."""
    parts = F.split(text, r"\[\d+±\d+\]", 2)
    return F.concat(F.get(parts, F.lit(0)), F.repeat(F.lit("-"), width), F.get(parts, F.lit(1)))


def rough_tokens(text: Column) -> Column:
    """White space parts tokens; stops at the end of one are tokens of their own."""
    chunks = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    tail = r"^(.+?)([.;!?,·:]+)$"
    return F.flatten(F.transform(chunks, lambda x: F.when(x.rlike(tail), F.concat(F.array(F.regexp_extract(x, tail, 1)), F.split(F.regexp_extract(x, tail, 2), ""))).otherwise(F.array(x))))


def second_hash(text: Column) -> Column:
    """Sixty-four bits that share nothing with xxhash64."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")
