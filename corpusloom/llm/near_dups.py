"""Operator 5: near-duplicates by fast similarity sketching, banding and exact checks.

A document's set holds its distinct word shingles. The sketch has `bins`
coordinates. In round i every element is thrown into one hashed bin with a hashed
value, and a coordinate keeps the least (round, value) it has seen; rounds stop
once each coordinate is full. After `bins` rounds, round bins + j throws every element
into bin j, so the sketch fills for any non-empty set. The share of equal coordinates of two
sketches estimates their Jaccard similarity with the concentration of a
fully filled sketch.

Documents with equal sets form a class, represented by its smallest id and numbered. Sketches
of classes are banded; classes that share a band are candidates, and
each link is confirmed on the full sets. With 32 bands of 4 coordinates a pair at
similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.

Candidates of a band are not expanded to all pairs. First each class is tested against one other: of the
least classes of its bands, the one that is so most often. Then, in bands that do not hang together yet, classes outside the
band's first component are tested against one class of it, twice: a pick that is the same in many bands, then one of each band's
own. So a class in many bands meets many members of the component, and a round makes at most a pair a row of the bands.
Pairs left untested are in one component, or in different ones; of the latter those are tested that two bounds leave open:
* shingles that no other class of such a band has cannot be shared, so the
  intersection is at most the smaller count of the others (exact);
* the sketches agree in at least as many coordinates as a pair at the threshold
  does less `deviations` standard deviations (5: a link is lost with probability 3e-7; None: this bound is not used,
  and every pair that shares a band and that the first bound leaves open is tested).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, bitmap_slot, hashed_words, id_bitmap, in_bitmap, mix, slices, stored, swept, table, tidy, two, window_hashes
from .components import connected_components

#: Words of a shingle, similarity in hundredths, coordinates, bands and coordinates of a band.
SHINGLE, PERCENT, BINS, BANDS, ROWS = 5, 80, 512, 32, 4
#: Standard deviations below a link's expected agreement at which an untested pair is ruled out.
DEVIATIONS = 5.0
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words than
    `size`, but not none, is one shingle; no words, no shingles."""
    h, at = hashed_words(texts, WORDS)
    grams = window_hashes(h, size)
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        n = e - s
        out.append(np.unique(grams[s : e - size + 1]) if n >= size else window_hashes(h[s:e], n) if n else np.empty(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Filled sketches, one row a set; rows of empty sets stay unfilled."""
    shift, low = np.uint64(64 - int(bins).bit_length() + 1), np.uint64((1 << 48) - 1)
    out = np.full((len(sets), bins), _FULL, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    flat = out.reshape(-1)
    for i in range(2 * bins):
        if not len(element):
            break
        x = mix(element + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        at = doc * bins + (x >> shift).astype(np.int64) if i < bins else doc * bins + (i - bins)
        np.minimum.at(flat, at, np.uint64(i << 48) | (x & low))
        open_ = (out == _FULL).any(axis=1)[doc]
        if not open_.all():
            doc, element = doc[open_], element[open_]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    parts = sketches[:, : rows * bands].reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketches), bands)).copy()
    for i in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i]
    return mix(key).astype(np.int64)


def nibbles(sketches: np.ndarray) -> np.ndarray:
    """Four hashed bits of each coordinate, sixteen to a long."""
    four = (mix(sketches) & np.uint64(15)).reshape(len(sketches), -1, 16)
    return np.bitwise_or.reduce(four << np.arange(0, 64, 4, dtype=np.uint64), axis=2).astype(np.int64)


def _agree(bins: int, percent: int, deviations: float | None) -> str:
    """Condition: columns fa and fb of nibbles agree as often as a link's must."""
    if deviations is None:
        return "true"
    p = percent / 100 + (1 - percent / 100) / 16
    least = int(bins * p - deviations * (bins * p * (1 - p)) ** 0.5)
    one = "bit_count(({y} | shiftrightunsigned({y}, 2)) & 1229782938247303441L)"
    differ = [one.format(y=f"(({x}) | shiftrightunsigned({x}, 1))") for x in (f"(fa[{i}] ^ fb[{i}])" for i in range(bins // 16))]
    return f"{bins} - ({' + '.join(differ)}) >= {least}"


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1)))


def _sums(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and a 128-bit digest of each set."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64)))
    flat = np.concatenate(sets)
    upto = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (flat, mix(flat))]
    return [pa.array(np.diff(ends)), *(pa.array((x[ends[1:]] - x[ends[:-1]]).astype(np.int64)) for x in upto)]


def _sketches(size: int, bins: int, bands: int):
    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), size)
                filled = sketch(sets, bins)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), *_sums(sets), _lists(band_keys(filled, bands)), _lists(nibbles(filled))], ["id", "h", "n", "d1", "d2", "bands", "four"])

    return run


def _sets(size: int, bitmap: np.ndarray):
    @tidy
    def run(batches):
        for batch in batches:
            near = in_bitmap(bitmap, np.asarray(batch.column("at"), np.int64))
            for part in slices(batch.filter(pa.array(near))):
                sets = shingle_sets(part.column("text"), size)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), *_sums(sets), lists], ["id", "n", "d1", "d2", "set"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h): h tells texts of one id apart."""
    return two(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))


class _Linker:
    """The stages of near_duplicates over numbered classes."""

    def __init__(self, classes: DataFrame, rows: DataFrame, size: int, percent: int, bins: int, bands: int, deviations: float | None):
        self.classes, self.rows, self.size, self.percent, self.bins, self.bands, self.deviations = classes, rows, size, percent, bins, bands, deviations

    def candidates(self) -> DataFrame:
        """(key, v, id, n, lo): the classes of bands that hold more than one, and the band's least class."""
        banded = self.classes.select(F.explode("bands").alias("key"), "v", "id", "n")
        shared = banded.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("key", "lo")
        return stored(banded.join(shared, "key"), "bands")

    def load(self, band: DataFrame, count: int) -> None:
        """The sets of the classes in bands, made from the texts once more."""
        bitmap = id_bitmap(band, "id", count)
        at = self.rows.where("id is not null").select("*", bitmap_slot(F.col("id"), bitmap).alias("at"))
        sets = at.mapInArrow(_sets(self.size, bitmap), "id long, n long, d1 long, d2 long, set array<long>").groupBy("id", "n", "d1", "d2").agg(F.first("set").alias("set"))
        needed = band.select("v").distinct().join(self.classes.select("v", "id", "n", "d1", "d2"), "v")
        self.sets = stored(sets.join(needed, ["id", "n", "d1", "d2"]).select("v", "set"), "sets")
        swept(self.sets.sparkSession)

    def confirmed(self, pairs: DataFrame, label: str = "links") -> DataFrame:
        """Of pairs (a, b) those that link."""
        both = pairs.join(self.sets.select(F.col("v").alias("b"), F.col("set").alias("sb")), "b").join(self.sets.select(F.col("v").alias("a"), F.col("set").alias("sa")), "a")
        both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
        links = stored(both.where(f"100 * i >= {self.percent} * (na + nb - i)").select("a", "b"), label)
        swept(links.sparkSession)
        return links

    def labelled(self, band: DataFrame, comp: DataFrame) -> DataFrame:
        return band.select("key", "v", "n").join(comp, "v", "left").withColumn("component", F.coalesce("component", "v"))

    def outsiders(self, band: DataFrame, comp: DataFrame, pick: str) -> DataFrame:
        """Pairs of the classes outside a band's least component with a pick of it."""
        own = self.labelled(band, comp)
        first = own.groupBy("key").agg(F.min(F.struct("component", F.expr(pick).alias("h"), "v", "n")).alias("f"), F.max("component").alias("last")).where("f.component <> last")
        pairs = own.join(first.select("key", "f"), "key").where(f"component <> f.component and 100 * least(n, f.n) >= {self.percent} * greatest(n, f.n)")
        return pairs.select(F.least("v", "f.v").alias("a"), F.greatest("v", "f.v").alias("b")).distinct()

    def rest(self, band: DataFrame, comp: DataFrame) -> DataFrame | None:
        """Untested pairs of bands that hold several components, as far as the bounds leave them open."""
        own = self.labelled(band, comp)
        mixed = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        own = stored(own.join(mixed, "key"), "mixed")
        if own.isEmpty():
            return None
        percent = self.percent
        shingles = own.select("v").distinct().join(self.sets, "v").select("v", F.explode("set").alias("x"))
        common = shingles.groupBy("x").agg(F.count("*").alias("df")).where("df > 1").select("x")
        share = shingles.join(common, "x").groupBy("v").agg(F.count("*").alias("s")).join(self.classes.select("v", "four", "bands"), "v")
        own = own.join(share, "v").where(f"100 * s >= {percent} * n")
        side = lambda x: own.select("key", *(F.col(c).alias(c[0] + x) for c in ("v", "n", "component", "s", "four", "bands")))
        fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
        bound = f"{100 + percent} * least(sa, sb) >= {percent} * (na + nb)"
        once = f"key = case {' '.join(f'when ba[{i}] = bb[{i}] then ba[{i}]' for i in range(self.bands))} end"  # in the first band that a pair shares
        pairs = side("a").join(side("b"), "key").where(f"va < vb and ca <> cb and {fits} and {bound} and {once} and {_agree(self.bins, percent, self.deviations)}")
        return pairs.select(F.col("va").alias("a"), F.col("vb").alias("b"))

    def components(self) -> DataFrame | None:
        """(v, component) of the classes that link with another."""
        band = self.candidates()
        count = band.count()
        if not count:
            return None
        self.load(band, count)
        links = self.confirmed(band.groupBy("v").agg(F.expr("mode(lo, true)").alias("a")).where("v <> a").select("a", F.col("v").alias("b")))
        comp = connected_components(links)
        for pick in ("xxhash64(v)", "xxhash64(key, v)"):
            comp = self.joined(comp, self.confirmed(self.outsiders(band, comp, pick)))
        rest = self.rest(band, comp)
        return comp if rest is None else self.joined(comp, self.confirmed(rest))

    @staticmethod
    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components once further links are known."""
        if links.isEmpty():
            return comp
        return connected_components(comp.select(F.col("component").alias("a"), F.col("v").alias("b")).unionByName(links))


def _judged(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, bins: int, bands: int, deviations: float | None) -> DataFrame:
    rows = _rows(docs, id_col, text_col)
    s = stored(rows.mapInArrow(_sketches(size, bins, bands), "id long, h long, n long, d1 long, d2 long, bands array<long>, four array<long>"), "sketches")
    full = s.where("n > 0 and id is not null")
    classes = full.groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "bands", "four")).alias("least"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("v"), "n", "d1", "d2", "least.*"), "classes")
    comp = _Linker(classes, rows, size, percent, bins, bands, deviations).components()
    named = classes.select("v", "n", "d1", "d2", F.col("id").alias("class_id"))
    if comp is None:
        named = named.withColumn("component_id", F.col("class_id"))
    else:
        both = named.select("v", "class_id").join(comp, "v")
        both = both.join(both.groupBy("component").agg(F.min("class_id").alias("component_id")), "component").select("v", "component_id")
        named = named.join(both, "v", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    out = full.select("id", "h", "n", "d1", "d2").join(named, ["n", "d1", "d2"]).select("id", "h", F.col("n").alias("n_shingles"), "class_id", "component_id")
    out = out.unionByName(s.where("n = 0 or id is null").select("id", "h", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, bands: int = BANDS, deviations: float | None = DEVIATIONS) -> DataFrame:
    """(id, n_shingles, class_id, component_id, kept), a row per input row.

    Links are pairs of classes with 100 * intersection >= percent * union of their
    full sets. class_id is the smallest id with the same set, component_id the smallest that can be reached, both of the
    row's own text: rows that repeat an id with other texts are judged each by its own, and equal rows alike. Null texts and texts
    without words have no shingles and link with nothing, not even each other;
    their component is their own id. A null id has null class and component and
    is kept. An empty table gives no rows.
    """
    return _judged(docs, id_col, text_col, size, percent, bins, bands, deviations).drop("h")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents less those whose component holds a smaller id; columns as given, and of any names. Rows go, not
    ids: of rows that repeat an id with other texts each is judged by its own text."""
    judged = _judged(docs, "doc_id", "text", SHINGLE, PERCENT, BINS, BANDS, DEVIATIONS)
    gone = stored(judged.where("not kept").select("id", "h").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= 500_000 else gone  # 16 bytes each: 8 MB; beyond that the join shuffles
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("h"))
    return rows.join(gone, ["id", "h"], "left_anti").select("row.*")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's figures: shingles of four words, similarity 0.8."""
    out = near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept", "class_id")
