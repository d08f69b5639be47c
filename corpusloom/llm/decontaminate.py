"""Operator 10: benchmark decontamination by winnowing.

Both sides are cut into words and every k-gram is hashed. Of each run of
w = window - k + 1 consecutive k-grams the least hash is kept (the rightmost of
equal ones), so any shared span of `window` words contains a kept k-gram that is
the same on both sides. Documents' fingerprints are joined with the benchmark's,
and each hit is extended to the left and right while the words agree; a
stretch of at least `window` words is a leak. A run of equal k-grams (one word many times) is
one fingerprint on both sides: two runs are laid with their starts and with their ends together, and
any other way they share no more than the shorter one, which then lies in the longer one. Items of fewer words than `window`
are one fingerprint each, of their whole length, looked up at every document
position of that length.

The benchmark is a stated query set: it is taken in blocks, each of at most
`block_words` words, which are broadcast (12 bytes a word, 48 MB at the default), while all documents stream past and
each row is held against PASS blocks at once. More blocks are further passes over the rows as written by the one
before, so a row's result is its own at any size of the benchmark, and there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, bounded, hashed_words, slices, stored, table, tidy, two, window_hashes

WINDOW, K, BLOCK_WORDS = 10, 5, 4_000_000
#: Bytes of text that are worked on at once, unless a single text is longer.
SLICE = 1 << 20
#: Blocks that a worker holds at once.
PASS = 4
_SCHEMA = "id long, text string, n_words long, hits array<struct<s: long, e: long>>, items array<long>"


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the k-grams that are least in one of the windows of w, the
    rightmost of equals; of fewer than w k-grams, the least one of all."""
    n = len(grams)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    best, at = grams[: n - w + 1].copy(), np.arange(n - w + 1)
    for i in range(1, w):
        other = grams[i : n - w + 1 + i]
        less = other <= best
        best[less], at[less] = other[less], (np.arange(n - w + 1) + i)[less]
    return np.unique(at)


def runs(grams: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of the run of equal k-grams that each position lies in; a run stays within one
    text, whose number is `own`."""
    i = np.arange(len(grams))
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    starts = np.flatnonzero(new)
    return np.maximum.accumulate(np.where(new, i, 0)), np.append(starts[1:] - 1, len(grams) - 1)[np.cumsum(new) - 1]


class Block:
    """Fingerprints of some items: sorted hashes with item, and first and last position of the run of equal k-grams."""

    def __init__(self, ids: list[int], words: np.ndarray, at: np.ndarray, window: int, k: int):
        self.ids, self.words, self.at, self.window, self.k = np.array(ids, np.int64), words, at, window, k
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        grams = window_hashes(words, k)
        keys, items, places, lasts, short = [], [], [], [], {}
        for i, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if e - s >= window:
                own = grams[s : e - k + 1]
                first, last = runs(own, np.zeros(len(own), bool))
                p = np.unique(first[winnow(own, window - k + 1)])
                keys.append(own[p]), items.append(np.full(len(p), i)), places.append(p + s), lasts.append(last[p] + s)
            elif e > s:
                short.setdefault(int(e - s), []).append((window_hashes(words[s:e], int(e - s))[0], i))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        keys, items, places, lasts = join(keys, np.uint64), join(items, np.int64), join(places, np.int64), join(lasts, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.places, self.lasts = keys[order], items[order], places[order], lasts[order]
        for n, pairs in short.items():
            pairs.sort()
            self.short[n] = (np.array([x for x, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64))


def _matches(keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in probe, index in sorted keys) of equal values."""
    lo, hi = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
    n = hi - lo
    who = np.repeat(np.arange(len(probe)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _extend(h: np.ndarray, s: int, e: int, p: int, words: np.ndarray, a: int, b: int, q: int, k: int) -> tuple[int, int]:
    """The longest stretch of equal words around document position p and item
    position q, within [s, e) and [a, b); (p, p) if the k-gram differs."""
    left, right = min(p - s, q - a), min(e - p, b - q)
    same = h[p : p + right] == words[q : q + right]
    stop = right if same.all() else int(np.argmin(same))
    if stop < k:
        return p, p
    back = h[p - left : p][::-1] == words[q - left : q][::-1]
    return p - (left if back.all() else int(np.argmin(back))), p + stop


class Slice:
    """Words of some texts, and the k-grams that winnowing keeps: first and last positions of their runs."""

    def __init__(self, texts: pa.Array, window: int, k: int):
        self.h, self.at = hashed_words(texts, ALNUM)
        h, at = self.h, self.at
        self.doc = doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        grams, w = window_hashes(h, k), window - k + 1
        kept = np.zeros(len(h), bool)
        if len(grams) >= w:
            kept[winnow(grams, w)] = True
        kept[len(grams) :] = False
        inside = np.arange(len(grams)) + k <= at[doc[: len(grams)] + 1]
        first, self.last = runs(grams, np.where(inside, doc[: len(grams)], -1)) if len(grams) else (inside, inside)
        self.p = np.unique(first[np.flatnonzero(kept[: len(grams)] & inside)])
        self.grams = grams[self.p]


def scan(texts: pa.Array, block: Block) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """(words, stretches hit, items hit) of each text."""
    return search(Slice(texts, block.window, block.k), block)


def search(part: Slice, block: Block) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """(words, stretches hit, items hit) of each text of a slice."""
    h, at, doc, p, last = part.h, part.at, part.doc, part.p, part.last
    window, k = block.window, block.k
    n_docs = len(at) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    items: list[set[int]] = [set() for _ in range(n_docs)]
    if len(block.keys):
        who, found = _matches(block.keys, part.grams)
        done: dict[tuple[int, int], tuple[int, int]] = {}
        for x, f in zip(p[who].tolist(), found.tolist(), strict=True):
            d, i = int(doc[x]), int(block.items[f])
            y, q, r = int(last[x]), int(block.places[f]), int(block.lasts[f])
            # runs of one word: where neither their starts nor their ends meet, the shorter one bounds the stretch
            if min(y - x, r - q) + k >= window and h[x] == block.words[q]:
                spans[d].append((x - int(at[d]), y + k - int(at[d])))
                items[d].add(int(block.ids[i]))
            for x, q in ((x, q), (y, r)) if (y, r) != (x, q) else ((x, q),):  # noqa: PLW2901
                lo, hi = done.get((d * len(block.ids) + i, x - q), (0, -1))
                if lo <= x and x + k <= hi:
                    continue
                a, b = _extend(h, int(at[d]), int(at[d + 1]), x, block.words, int(block.at[i]), int(block.at[i + 1]), q, k)
                done[d * len(block.ids) + i, x - q] = a, b
                if b - a >= window:
                    spans[d].append((a - int(at[d]), b - int(at[d])))
                    items[d].add(int(block.ids[i]))
    for n, (keys, owners) in block.short.items():
        grams = window_hashes(h, n)
        inside = np.flatnonzero(np.arange(len(grams)) + n <= at[doc[: len(grams)] + 1])
        who, found = _matches(keys, grams[inside])
        for x, f in zip(inside[who].tolist(), found.tolist(), strict=True):
            d = int(doc[x])
            spans[d].append((x - int(at[d]), x - int(at[d]) + n))
            items[d].add(int(block.ids[owners[f]]))
    return [(int(at[d + 1] - at[d]), merged(spans[d]), sorted(items[d])) for d in range(n_docs)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _found(part: pa.Array, blocks: list) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """What the blocks find in each text of a slice, together."""
    first = blocks[0].value
    words = Slice(part, first.window, first.k)
    found = search(words, first)
    for b in blocks[1:]:
        found = [(n, merged(x + y), sorted({*i, *j})) for (n, x, i), (_, y, j) in zip(found, search(words, b.value), strict=True)]
    return found


def _scan(blocks: list, last: bool):
    """Adds to each row what the blocks find; the last pass needs the texts no more."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, size=SLICE):
                hits, items = part.column("hits").to_pylist(), part.column("items").to_pylist()
                found = [(n, merged(x + [(y["s"], y["e"]) for y in h]), sorted({*i, *j})) for (n, x, i), h, j in zip(_found(part.column("text"), blocks), hits, items, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.nulls(len(found), pa.string()) if last else part.column("text"),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([[{"s": s, "e": e} for s, e in x[1]] for x in found], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([x[2] for x in found], pa.list_(pa.int64())),
                    ],
                    ["id", "text", "n_words", "hits", "items"],
                )

    return run


def _clean(blocks: list):
    """Drops the rows in which the blocks find something."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, size=SLICE):
                found = _found(pc.cast(part.column("text"), pa.string()), blocks)
                yield part.filter(pa.array([not spans for _, spans, _ in found]))

    return run


def _blocks(items: DataFrame, window: int, k: int, block_words: int):
    """Items in ascending order, cut where a block would exceed its words."""
    ids, texts, words = [], [], 0
    for row in items.orderBy("id").toLocalIterator(prefetchPartitions=False):
        n = len(row.text or "")
        if ids and words + n > block_words:
            yield Block(ids, *hashed_words(pa.array(texts, pa.string()), ALNUM), window, k)
            ids, texts, words = [], [], 0
        ids.append(row.id), texts.append(row.text), (words := words + n)
    yield Block(ids, *hashed_words(pa.array(texts, pa.string()), ALNUM), window, k)


def _passes(benchmark: DataFrame, item_col: str, item_text: str, window: int, k: int, block_words: int) -> list[list]:
    """The benchmark's blocks, broadcast one by one, in groups of PASS."""
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and window")
    items = two(benchmark, item_col, item_text).where("id is not null")
    held = [benchmark.sparkSession.sparkContext.broadcast(b) for b in _blocks(items, window, k, block_words)]
    return [held[i : i + PASS] for i in range(0, len(held), PASS)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, hits, items) for each document row: word stretches [s, e) that
    lie in a shared stretch of at least `window` words or in a whole shorter
    item, and the ids of those items.

    Null and wordless texts have no words and no hits; items without words and
    items with a null id match nothing. Rows that repeat an id, and rows with a null id, each get
    a row of their own text. An item id that repeats
    counts once. An empty benchmark leaves every document without hits.
    """
    rows = two(docs, id_col, text_col).selectExpr("id", "text", "0L as n_words", "cast(array() as array<struct<s: bigint, e: bigint>>) as hits", "cast(array() as array<bigint>) as items")
    passes = _passes(benchmark, item_col, item_text, window, k, block_words)
    for i, blocks in enumerate(passes):
        rows = (stored(rows, "pass") if i else rows).mapInArrow(_scan(blocks, i + 1 == len(passes)), _SCHEMA)
    return rows.drop("text")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents less those that hold a benchmark passage; columns as given. Every row is judged by its own
    text, also where its id repeats or is null; a null text stays."""
    for i, blocks in enumerate(_passes(benchmark, "item_id", "text", WINDOW, K, BLOCK_WORDS)):
        docs = bounded(stored(docs, "pass") if i else docs).mapInArrow(_clean(blocks), docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and digest of items, and the stretches that are hit."""
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(hits, 0L, (a, x) -> a + x.e - x.s)")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias("hits"),
    )
