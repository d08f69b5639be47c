"""Operator 9: cross-entropy difference of a target and a background n-gram model.

Both are interpolated bigram models of the same order, smoothing and vocabulary (the words of
`least` or more tokens in the target; all others are one unknown word). The target is text
labelled good, the background all text. A document's score is the mean over its tokens
of the target's loss less the background's, in bits: the lower, the closer to the target.

Counts are exact, over all documents, and nothing that grows with the corpus is sent to the driver
or to every worker. Documents are numbered once, in written chunks of about CHUNK bytes of text, each
with its own list of distinct words. A chunk sends its distinct words, and later its distinct bigrams, as
packed blocks, one a range of hashes; a range sums the blocks of all chunks and answers each with the
totals of its entries in the order they came. So a chunk needs only the totals of its own entries,
and the number of ranges follows the corpus, so that a range holds about RANGE entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, hash_words, mix, slices, split_words, stored, table, two

LEAST, WEIGHT = 5, 0.6
#: Bytes of text in a chunk, unless a single text is longer.
CHUNK = 12 << 20
#: Entries of all chunks in a range of hashes.
RANGE = 1_000_000
_CHUNK = "chunk long, n_tokens long, n_words long, target_texts long, full_texts long, ids array<long>, at binary, good binary, token binary, words binary"
_BLOCK = "part int, chunk long, keys binary, counts binary"
_ANSWER = "chunk long, kind int, part int, counts binary"


_ROW = pa.schema([*((c, pa.int64()) for c in ("chunk", "n_tokens", "n_words", "target_texts", "full_texts")), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("at", "good", "token", "words"))])
_BLOCKS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWERS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
_SCORES = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("target_bits", pa.float64()), ("background_bits", pa.float64()), ("score", pa.float64())])
_ZSTD = pa.Codec("zstd", 1)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, their low bytes first, then the next ones: most are small."""
    raw = np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True) if raw else b""


def unpacked(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    raw = np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _texts(batches):
    """Chunks: ids, offsets and marks of texts, their tokens as numbers of the chunk's distinct words."""
    from pyspark import TaskContext

    number, size, held = TaskContext.get().partitionId() << 32, 0, []

    def row():
        tokens, n, good, ids = ([x[i] for x in held] for i in range(4))
        words, token, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        n, good = np.concatenate(n), np.concatenate(good)
        at = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        values = [number, len(token), len(words), int((good & (n > 0)).sum()), int((n > 0).sum()), pa.concat_arrays(ids).to_pylist(), packed(at), good.tobytes(), packed(rank[token]), words[order].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _ROW, strict=True)], schema=_ROW)

    for batch in batches:
        for part in slices(batch):
            words, at = split_words(part.column("text"), WORDS)
            new = part.column("text").nbytes
            if held and size + new > CHUNK:
                yield row()
                number, size, held = number + 1, 0, []
            size += new
            held.append((hash_words(words), np.diff(at), np.asarray(part.column("target").to_numpy(zero_copy_only=False), bool), part.column("id")))
    if held:
        yield row()


class Chunk:
    """The arrays of a chunk's row."""

    def __init__(self, row: dict):
        self.number, self.ids = row["chunk"], row["ids"]
        self.at, self.token = unpacked(row["at"], np.int64), unpacked(row["token"], np.int32).astype(np.int64)
        self.good, self.words = np.frombuffer(row["good"], bool), np.frombuffer(row["words"], np.uint64)
        self.n = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.starts = self.at[:-1][self.n > 0]

    def _before(self, token: np.ndarray, start: int) -> np.ndarray:
        before = np.concatenate(([0], token[:-1])) if len(token) else token.copy()
        before[self.starts] = start
        return before

    def word_counts(self) -> np.ndarray:
        """A row a distinct word: tokens and contexts, each of the target and of all texts."""
        good, size = self.good[self.doc], len(self.words) + 1
        before = self._before(self.token, size - 1)
        return np.stack([np.bincount(x, w, size)[:-1].astype(np.int64) for x in (self.token, before) for w in (good, None)], 1)

    def bigrams(self, known: np.ndarray):
        """Distinct bigrams of known words (0: unknown, one more than all words: start) as words before and words, the
        bigram of each token, and the counts of the target and of all texts."""
        size = np.int64(len(self.words) + 2)
        token = np.where(known, np.arange(1, size - 1), 0)[self.token]
        code, which = np.unique(self._before(token, size - 1) * size + token, return_inverse=True)
        counts = np.stack([np.bincount(which, w, len(code)).astype(np.int64) for w in (self.good[self.doc], None)], 1)
        return code // size, code % size, which, counts


def _blocks(number: int, keys: np.ndarray, counts: np.ndarray, ranges: int):
    """The packed entries of a chunk, a row a range."""
    part = range_of(keys, ranges)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(ends)):
        i = order[ends[r] : ends[r + 1]]
        yield {"part": int(r), "chunk": number, "keys": keys[i].tobytes(), "counts": packed(counts[i].ravel())}


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(keys) % np.uint64(ranges)).astype(np.int64)


def _totals(kind: int, columns: int, least: int | None = None):
    """Sums a range's blocks and answers each chunk. With `least` (words) a column more numbers the range's known
    words, from 1 (0: unknown), and one row more has what all chunks need: words known, tokens, and tokens and
    contexts of unknown words."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        counts = np.concatenate([unpacked(r["counts"], np.int64).reshape(-1, columns) for r in rows])
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        sums = np.add.reduceat(counts[order], np.flatnonzero(new), 0)
        out, at = [], 0
        if least is not None:
            known = sums[:, 0] >= least
            out.append((-1, 2, np.concatenate(([known.sum()], sums[:, :2].sum(0), sums[~known].sum(0)))))
            sums = np.column_stack((sums, np.where(known, np.cumsum(known), 0)))
        total = np.empty((len(keys), sums.shape[1]), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        for r in rows:
            n = len(r["keys"]) // 8
            out.append((r["chunk"], kind, total[at : at + n].ravel()))
            at += n
        return pa.Table.from_pylist([{"chunk": c, "kind": k, "part": rows[0]["part"], "counts": packed(x)} for c, k, x in out], _ANSWERS)

    return run


def _answered(answers: list[dict], kind: int, keys: np.ndarray, columns: int, ranges: int) -> np.ndarray:
    """Totals of a chunk's entries from the answers of the ranges."""
    order, out = np.argsort(range_of(keys, ranges), kind="stable"), np.zeros((len(keys), columns), np.int64)
    got = [unpacked(r["counts"], np.int64).reshape(-1, columns) for r in sorted(answers, key=lambda r: r["part"]) if r["kind"] == kind]
    if got:
        out[order] = np.concatenate(got)
    return out


def _bigrams_of(chunk: Chunk, answers: list[dict], offsets: np.ndarray):
    """Word totals, with zero for unknown words; keys of the bigrams, and what Chunk.bigrams gives."""
    words = _answered(answers, 0, chunk.words, 5, len(offsets))
    known = words[:, 4] > 0
    found = chunk.bigrams(known)
    number = np.where(known, words[:, 4] + offsets[range_of(chunk.words, len(offsets))], 0)
    number = np.concatenate(([0], number, [(1 << 32) - 1])).astype(np.uint64)  # the last: start of a text
    return np.where(known[:, None], words, 0), number[found[0]] << np.uint64(32) | number[found[1]], found


def loss(pair: np.ndarray, context: np.ndarray, token: np.ndarray, total: int, size: int, weight: float = WEIGHT) -> np.ndarray:
    """Bits of a word after another from their count, the count of the word before, of the word, of all tokens, and the
    number of words with the unknown one."""
    unigram = (token + 1) / (total + size)
    return -np.log2(np.where(context > 0, weight * pair / np.maximum(context, 1) + (1 - weight) * unigram, unigram))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_tokens, target_bits, background_bits, score), a row per document row;
    `target` holds ids of target documents.

    Bits are means per token; score = target_bits - background_bits. A null, empty or wordless text has
    0 tokens and null for the rest. Repeated rows and null ids are scored each; both count in the background.
    Without target documents both models differ by smoothing alone. An empty table gives no rows.
    """
    good = target.select(target[id_col].cast("long").alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    text = two(docs, id_col, text_col)
    n_good = good.count()
    marks = F.broadcast(good) if n_good <= 500_000 else good  # 9 bytes each: under 16 MB; beyond that the join shuffles
    rows = text.join(marks, "id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    chunks = stored(rows.mapInArrow(_texts, _CHUNK), "chunks")
    n = [x or 0 for x in chunks.agg(*(F.sum(c) for c in ("n_words", "n_tokens", "target_texts", "full_texts"))).first()]
    word_ranges, pair_ranges, starts = n[0] // RANGE + 1, n[1] // RANGE + 1, n[2:]

    def word_blocks(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                for b in _blocks(c.number, c.words, c.word_counts(), word_ranges):
                    yield pa.RecordBatch.from_pylist([b], _BLOCKS)

    words = stored(chunks.mapInArrow(word_blocks, _BLOCK).groupBy("part").applyInArrow(_totals(0, 4, least), _ANSWER), "words")
    sums, offsets = np.zeros(7, np.int64), np.zeros(word_ranges, np.int64)
    for r in words.where("kind = 2").toLocalIterator():  # one a million entries
        one = unpacked(bytes(r["counts"]), np.int64)
        sums, offsets[r["part"]] = sums + one, one[0]
    offsets = np.cumsum(offsets) - offsets
    words = words.where("kind = 0")

    def pair_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [], right.to_pylist()
        for row in left.to_pylist():
            c = Chunk(row)
            _, keys, found = _bigrams_of(c, answers, offsets)
            out.extend(_blocks(c.number, keys, found[3], pair_ranges))
        return pa.Table.from_pylist(out, _BLOCKS)

    by_chunk = chunks.groupBy("chunk")
    pairs = by_chunk.cogroup(words.groupBy("chunk")).applyInArrow(pair_blocks, _BLOCK).groupBy("part").applyInArrow(_totals(1, 2), _ANSWER)

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [], right.to_pylist()
        for row in left.to_pylist():
            c = Chunk(row)
            words, keys, (before, token, which, _) = _bigrams_of(c, answers, offsets)
            both = _answered(answers, 1, keys, 2, pair_ranges)
            bits = []
            for i in (0, 1):
                tokens = np.concatenate(([sums[3 + i]], words[:, i]))
                contexts = np.concatenate(([sums[5 + i]], words[:, 2 + i], [starts[i]]))
                each = loss(both[:, i], contexts[before], tokens[token], sums[1 + i], sums[0] + 1)
                bits.append(np.bincount(c.doc, each[which], len(c.n)) / np.maximum(c.n, 1))
            none = c.n == 0
            out.append(pa.Table.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.n), *(pa.array(x, mask=none) for x in (*bits, bits[0] - bits[1]))], ["id", "n_tokens", "target_bits", "background_bits", "score"]))
        return pa.concat_tables(out) if out else _SCORES.empty_table()

    return by_chunk.cogroup(words.unionByName(pairs).groupBy("chunk")).applyInArrow(scores, "id long, n_tokens long, target_bits double, background_bits double, score double")


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality and not toxic; background: all."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")
