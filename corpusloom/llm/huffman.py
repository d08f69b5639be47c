"""Operator 2: token ids in a Huffman-coded file format.

Ids of all documents are counted, and a canonical code limited to `limit` bits is
built by package-merge, so a code is stored as lengths alone. Documents, in ascending
id order, are coded into independent blocks. A block holds whole documents, their
bits, and the bit offset of every STEP-th id; from those checkpoints a table of 2**limit entries decodes all stretches of a block side by side.

The files are Parquet: `code` (id, bits), one row an id, and `blocks`, one row a block
with its place in the whole stream, so any file system serves, a block is read alone, and writing
is committed by Spark.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, scratch, slices, swept, table, tidy, two

STEP, BLOCK_IDS, LIMIT = 64, 1 << 16, 16
#: Distinct pieces of text whose ids a worker keeps; beyond that it starts anew.
KEPT = 1_500_000


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge:
    0 where a symbol never occurs, 1 for a lone symbol."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # levels: each a merge of the symbols with the pairs of the level below
    level, marks = weight, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        at = np.argsort(both, kind="stable")
        level = both[at]
        marks.append(at < n)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for is_symbol in reversed(marks):
        here = is_symbol[:take]
        k = int(here.sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    lengths[:take] += 1
    out[order] = lengths
    return out


class Code:
    """A canonical code: symbols of a length are numbered in order of their ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.limit = max(1, int(lengths.max(initial=0)))
        self.codes = np.zeros(len(lengths), np.uint64)
        code, last = 0, 0
        starts = np.zeros(self.limit + 2, np.int64)
        sizes = np.bincount(lengths[used], minlength=self.limit + 1)
        for n in range(1, self.limit + 1):
            code = code + (int(sizes[n - 1]) if n > 1 else 0) << 1
            starts[n] = code
        for n in range(1, self.limit + 1):
            here = order[last : last + sizes[n]]
            self.codes[here] = (starts[n] + np.arange(len(here))).astype(np.uint64)
            last += sizes[n]
        self.both = self.codes << np.uint64(6) | lengths.astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.width = np.zeros(1 << self.limit, np.int64)
        spread = 1 << (self.limit - self.lengths[order])
        self.symbol[: spread.sum()] = np.repeat(order, spread)
        self.width[: spread.sum()] = np.repeat(self.lengths[order], spread)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits, high bit first, and the bit offsets of ids 0, STEP, 2 * STEP, ..."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        # codes of neighbours are joined while they fit in 64 bits, so that fewer are laid into words
        both, joined = self.both[ids], 1
        code, n = both >> np.uint64(6), both & np.uint64(63)
        while self.limit * joined <= 32 and joined < STEP:
            if len(code) % 2:
                code, n = np.append(code, np.uint64(0)), np.append(n, np.uint64(0))
            code, n, joined = code[::2] << n[1::2] | code[1::2], n[::2] + n[1::2], 2 * joined
        n = n.astype(np.int64)
        end = np.cumsum(n)
        at = end - n
        # each code's share of the 64-bit word it starts in, and of the next
        word, room = at >> 6, 64 - (at & 63) - n
        first = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        new = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        words = np.zeros((int(end[-1]) + 63 >> 6) + 1, np.uint64)
        words[word[new]] = np.bitwise_or.reduceat(first, new)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: int(end[-1]) + 7 >> 3], at[:: STEP // joined]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block; all stretches between checkpoints in step."""
        if not n:
            return np.empty(0, np.uint32)
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        out = np.empty((STEP, len(checkpoints)), np.uint32)
        at, shift, mask = checkpoints.astype(np.int64), 32 - self.limit, (1 << self.limit) - 1
        last = len(window) - 1
        for i in range(STEP):
            peek = (window[np.minimum(at >> 3, last)].astype(np.int64) >> (shift - (at & 7))) & mask
            out[i] = self.symbol[peek]
            at += self.width[peek]
        return out.T.reshape(-1)[:n]


#: Bytes of text that are split and looked up at once, unless a single text is longer.
SLICE = 16 << 20


class Encoder:
    """Whole texts to ids by the tokenizers library. A byte-level pre-tokenizer always cuts before a single
    space, and before a line feed, that stands between two other characters, so a text is the sum of its words with the
    space or line feed in front; their ids are kept in a bounded table, and only new words go to the library, many
    to a call, strung together and told apart by the bytes of their tokens. Words of letters with at
    most one mark after them are whole pre-tokens by the rule and go to the library's model without its regex.
    Where white space does not stand alone the stretch around it is left whole. Words of many texts are
    numbered at once, so the table is asked once a distinct word, and their ids are gathered.

    All this is done only for a tokenizer whose file says that it works so; another one is given whole texts."""

    #: White space other than space and line feed, as Python and as the library's regex see it.
    RARE = "\t\x0b-\r\x1c-\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
    #: Texts in which some white space does not stand alone.
    ODD = f"^$|^[ \n]| $|  | \n|\n |\n\n\n|\n\n$|[{RARE}]"
    #: Letters (as every version of Unicode has them) and at most one mark.
    PLAIN, MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,;:!?]?", ".,;:!?"
    #: Marks the head of a text, which has no space in front; a lone surrogate is in no text.
    HEAD = "\udc00"
    #: Words of a string for the library.
    GROUP = 1000

    def __init__(self, path: str, kept: int = KEPT, end: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.tokenizer.no_padding(), self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        rule, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        self.cut = said["model"]["type"] == "BPE" and not said.get("normalizer") and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space", True) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in added)
        self.plain = None
        if self.cut and not any(re.fullmatch(r"[^\W\d_]+", x["content"]) for x in added):
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(end or 0, *vocabulary.values()) < 1 << 16 else np.uint32
        #: place of a word in `ends`, in the order met; ids of word k are ids[ends[k]:ends[k + 1]]
        self.known: dict[str, int] = {}
        self.ends, self.ids = array("q", [0]), array("H" if self.kind is np.uint16 else "I")
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves in tokens
        other = iter(range(256, 512))
        self.byte = {b: chr(b) if b in own else chr(next(other)) for b in range(256)}
        self.space, self.feed = self.byte[32], self.byte[10]
        self.byte[32] = " "

    @staticmethod
    def cuts(text: str) -> list[str]:
        """The head, and the further words without the space in front of each."""
        parts = text.split(" ")
        out = [parts[0]]
        for left, x in zip(parts, parts[1:], strict=False):
            if left and x and not left[-1].isspace() and not x[0].isspace():
                out.append(x)
            else:
                out[-1] += " " + x
        return out

    def _library(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ends.frombytes((ends.astype(np.int64) + len(self.ids)).tobytes())
        self.ids.frombytes(ids.astype(self.kind, copy=False).tobytes())

    def _strung(self, tokenizer, words: list[str], wide: int, string, key: str = "") -> None:
        """Adds words whose ids are told apart by bytes: a word's own, and `wide` for what `string` puts in front."""
        groups = [words[i : i + self.GROUP] for i in range(0, len(words), self.GROUP)]
        for group, ids in zip(groups, self._library(tokenizer, [string(g) for g in groups]), strict=True):
            packed = np.array(ids, self.kind)
            ends = np.cumsum(np.asarray(pc.binary_length(pa.array(group, pa.string())), np.int64) + wide)
            self._add([key + x for x in group] if key else group, packed, np.searchsorted(np.cumsum(self.width[packed]), ends, "left") + 1)

    def _pieces(self, front: str):
        """A string of plain words, each pre-token a word of white space apart, as the model's bytes."""

        def string(words: list[str]) -> str:
            out = " ".join(words)
            if not out.isascii():
                out = out.encode("utf-8").decode("latin-1").translate(self.byte)
            out = front + out.replace(" ", " " + front) if front else out
            for x in self.MARKS:
                out = out.replace(x, " " + x)
            return out

        return string

    def _learn(self, words: list[str], n: int) -> np.ndarray:
        """Adds new words, of which the first n are not heads; their places."""
        names, at = pa.array(words, pa.string()), np.arange(len(words))
        simple = np.asarray(pc.match_substring_regex(names, f"^\n?(?:{self.PLAIN})$")) if self.plain else np.zeros(len(words), bool)
        feed = np.asarray(pc.starts_with(names, "\n"))
        after_feed, after_space, alone = [], [], []
        for i in np.flatnonzero(~simple[:n]).tolist():
            (alone if not words[i] or words[i][-1].isspace() else after_feed if words[i][0] == "\n" else after_space).append(i)
        bare = np.flatnonzero((~simple | feed)[n:]) + n
        apart = self._library(self.tokenizer, [words[i] if words[i][:1] == "\n" else " " + words[i] for i in alone] + [words[i] for i in bare])
        place, start = np.empty(len(words), np.int64), len(self.known)
        self._add([words[i] for i in alone] + [self.HEAD + words[i] for i in bare], np.fromiter(chain.from_iterable(apart), self.kind), np.cumsum([len(x) for x in apart]))
        parts = self._pieces(self.feed + " ")
        order = [np.array(alone, np.int64), bare]
        for tokenizer, which, wide, string, key in (
            (self.tokenizer, after_space, 1, lambda g: " " + " ".join(g), ""),
            (self.tokenizer, after_feed, 0, "".join, ""),
            (self.plain, np.flatnonzero(simple & ~feed & (at < n)), 1, self._pieces(self.space), ""),
            (self.plain, np.flatnonzero(simple & feed & (at < n)), 0, lambda g: parts([x[1:] for x in g]), ""),
            (self.plain, np.flatnonzero(simple & ~feed & (at >= n)), 0, self._pieces(""), self.HEAD),
        ):
            order.append(np.asarray(which, np.int64))
            self._strung(tokenizer, [words[i] for i in which], wide, string, key)
        place[np.concatenate(order)] = start + at
        return place

    def _places(self, words: np.ndarray, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of words and heads in the table; those that are new are learnt."""
        asked = words.tolist()
        place = np.fromiter(chain(map(self.known.get, asked, repeat(-1)), map(self.known.get, [self.HEAD + x for x in heads], repeat(-1))), np.int64, len(asked) + len(heads))
        if len(self.known) + np.count_nonzero(place < 0) > self.kept or len(self.ids) > 8 * self.kept:
            # the words met first are the frequent ones: half of the table stays
            half = min(self.kept, len(self.known)) // 2
            while half and self.ends[half] > 4 * self.kept:
                half //= 2
            self.known = dict(islice(self.known.items(), half))
            del self.ids[self.ends[half] :], self.ends[half + 1 :]
            place[place >= half] = -1
        new = np.flatnonzero(place < 0)
        both = asked + heads
        place[new] = self._learn([both[i] for i in new.tolist()], int(np.searchsorted(new, len(asked))))
        return place[: len(words)], place[len(words) :]

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.BinaryArray:
        """The ids of each text, and `end` behind them, as little-endian whole numbers of the width of `kind`."""
        tail = np.array([] if end is None else [end], self.kind)
        if not len(texts):
            return pa.array([], pa.binary())
        if not self.cut:
            return pa.array([np.array(x, self.kind).tobytes() + tail.tobytes() for x in self._library(self.tokenizer, texts.to_pylist())], pa.binary())
        odd = pc.match_substring_regex(texts, self.ODD)
        # texts that Arrow can split come first, the others after them
        lists = [pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " ")]
        if pc.any(odd).as_py():
            lists.append(pa.array([self.cuts(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string())))
        at = np.concatenate(([0], np.cumsum(np.concatenate([np.asarray(pc.list_value_length(x), np.int64) for x in lists]))))
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        index, words = np.array(coded.indices, np.int32), coded.dictionary.to_numpy(zero_copy_only=False)
        first, which = np.unique(index[at[:-1]], return_inverse=True)
        index[at[:-1]] = len(words) + which
        seen = np.zeros(len(words) + len(first), bool)
        seen[index] = True
        asked, place = np.flatnonzero(seen[: len(words)]), np.zeros(len(words), np.int64)
        place[asked], heads = self._places(words[asked], words[first].tolist())
        place = np.concatenate((place, heads))
        # the ids of the slice's distinct words and heads, and the end, as strings of bytes that Arrow gathers
        ends, size = np.frombuffer(self.ends, np.int64), np.dtype(self.kind).itemsize
        start, n = ends[place], ends[place + 1] - ends[place]
        last = np.cumsum(n)
        flat = np.frombuffer(self.ids, self.kind)[np.repeat(start - (last - n), n) + np.arange(last[-1])] if len(self.ids) else tail[:0]
        del ends  # the table cannot grow while a view of it is held
        offsets = np.concatenate(([0], last, [last[-1] + len(tail)])) * size
        index = np.insert(index, at[1:], len(place))
        strings = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.concatenate((flat, tail)).tobytes())])
        taken = strings.take(pa.array(index))
        edges = np.frombuffer(taken.buffers()[1], np.int32)[at + np.arange(len(at))]
        out = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges), taken.buffers()[2]])
        if len(lists) > 1:
            order = np.argsort(np.asarray(odd), kind="stable")
            out = out.take(pa.array(np.argsort(order)))
        return out


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(path: str, end: int | None):
    @tidy
    def run(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, end) not in _ENCODERS:
            _ENCODERS[path, end] = Encoder(path, end=end)
        encoder, part, at, counts = _ENCODERS[path, end], TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        for batch in batches:
            for piece in slices(batch, rows=1 << 14, size=SLICE):
                ids = encoder.encode(pc.fill_null(piece.column("text"), ""), end)
                n = np.asarray(pc.binary_length(ids), np.int64) // np.dtype(encoder.kind).itemsize
                new = np.bincount(np.frombuffer(ids.buffers()[2], encoder.kind, n.sum()), minlength=len(counts))
                new[: len(counts)] += counts
                counts, before = new, at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(before), piece.column("id"), pa.array(n), ids, pa.nulls(len(n), pa.binary())], _STAGED_NAMES)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at]), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([None], pa.binary()), pa.array([np.concatenate((used, counts[used])).tobytes()], pa.binary())], _STAGED_NAMES)

    return run


def _count(batches):
    """Counts of ids, a row a task, to a row an id."""
    for batch in batches:
        for x in batch.column("counts"):
            used, n = np.frombuffer(x.as_py(), np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], ["id", "n"])


_STAGED_NAMES = ["part", "at", "id", "n", "ids", "counts"]
_STAGED = "part int, at long, id long, n long, ids binary, counts binary"
_BLOCK = "start long, n long, docs binary, sizes binary, checkpoints binary, bits binary, part int"


def _blocks(lengths: np.ndarray, offsets: dict[int, int]):
    """Sorted documents to blocks of at least BLOCK_IDS ids, the last of a part
    aside. A document stays in one block, however long."""

    def run(batches):
        code = Code(lengths)
        docs, sizes, ids = [], [], []
        part = start = None

        def block():
            bits, checkpoints = code.encode(np.concatenate(ids))
            steps = np.diff(checkpoints, prepend=0).astype(np.uint16)
            row = [start, sum(sizes), zlib.compress(np.array(docs, np.int64).tobytes(), 1), zlib.compress(np.array(sizes, np.int64).tobytes(), 1), steps.tobytes(), bits, part]
            docs.clear(), sizes.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["start", "n", "docs", "sizes", "checkpoints", "bits", "part"])

        held = 0
        for batch in batches:
            for p, at, doc, n, x in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "id", "n", "ids")), strict=True):
                if docs and (p != part or held >= BLOCK_IDS):
                    yield block()
                if not docs:
                    part, start, held = p, offsets[p] + at, 0
                x = np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32)
                docs.append(doc), sizes.append(len(x)), ids.append(x)
                held += len(x)
        if docs:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Encode every text (null: empty), append `end`, and write code and blocks.

    Blocks lie in folders part=0, part=1, ... of ascending ids, ascending within each.
    Rows with a null id are not documents and are left out; rows that repeat an id are
    written one after the other. No rows give an empty code and no blocks. What
    reaches the driver is a count for each id of the vocabulary and for each part.
    """
    spark = docs.sparkSession
    rows = two(docs, id_col, text_col).where("id is not null")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged = scratch(spark, "ids")
    rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").mapInArrow(_encode(tokenizer or default_tokenizer(), end), _STAGED).write.option("compression", "zstd").parquet(staged)
    swept(spark)  # the shuffle that sorted the texts is no longer needed
    ids = spark.read.schema(_STAGED).parquet(staged)
    counts = ids.where("counts is not null").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    sums = {r.part: r.n for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(sums):
        offsets[p], total = total, total + sums[p]
    seen = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    seen[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    while 1 << limit < np.count_nonzero(seen):
        limit += 1
    lengths = code_lengths(seen, limit)
    used = np.flatnonzero(lengths)
    table_ = pa.table({"id": used.astype(np.int64), "bits": lengths[used].astype(np.int32)})
    spark.createDataFrame(table_, "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    ids.where("counts is null").mapInArrow(_blocks(lengths, offsets), _BLOCK).write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_path(spark, staged)


def _load(spark: SparkSession, path: str) -> np.ndarray:
    code = spark.read.schema("id long, bits int").parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 1, np.uint8)
    lengths[code["id"].to_numpy(np.int64)] = code["bits"].to_numpy(np.uint8)
    return lengths


def _documents(lengths: np.ndarray, digest: bool):
    def run(batches):
        code = Code(lengths)
        for batch in batches:
            for start, n, docs, sizes, steps, bits in zip(batch.column("start").to_pylist(), batch.column("n").to_pylist(), *(batch.column(c) for c in ("docs", "sizes", "checkpoints", "bits")), strict=True):
                docs, sizes = (np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in (docs, sizes))
                ids = code.decode(bits.as_py(), np.cumsum(np.frombuffer(steps.as_py(), np.uint16).astype(np.int64)), n)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                if digest:
                    last = pa.array([zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start + ends[:-1]), pa.array(sizes), last], ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of each document; start counts the ids of all before it."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_documents(_load(spark, path), False), "id long, start long, n_tokens long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_ids, with the crc32 of the ids in place of the ids."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    return blocks.mapInArrow(_documents(_load(spark, path), True), "id long, start long, n_tokens long, ids_crc32 long")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's figures, read back from the files that the documents were written to."""
    path = scratch(spark, "tokens")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path).withColumnRenamed("id", "doc_id")
