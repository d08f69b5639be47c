"""Operator 3: SentencePiece encoding with offsets, and decoding.

Normalisation is done here: at each place of the text the longest source prefix in the model's
compiled character map (a double-array trie over UTF-8, with replacement strings)
is replaced, other characters are kept; white space is handled as the
model asks, and every normalised byte keeps the source byte it came from.
The normalised text is then cut where a mark of a space follows another
character. No piece of the model holds such a place inside (checked when it is loaded), so
no merge crosses a cut, and the library's pieces of the cuts, one after the other, are its
pieces of the text. Cuts repeat, so their pieces are kept in a bounded table. Each
piece is projected through the alignment to the bytes of the original text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from itertools import chain, islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, slices, table, tidy, two

SPACE = "▁"
#: Marks a cut without a space in front; a lone surrogate is in no text.
BARE = "\udc00"
#: Bytes of text that are worked on at once, unless a single text is longer.
SLICE = 1 << 20
#: Distinct cuts that a worker keeps; beyond that half of them stay.
KEPT = 200_000


class CharMap:
    """A compiled character map: uint32 size, a double-array trie, replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at a place."""
        if not self.units:
            return None
        found, node = None, self._base(self.units[0])
        for i in range(at, len(data)):
            b = data[i]
            node ^= b
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != b:
                break
            node ^= self._base(unit)
            if unit & 256:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.strings.index(0, found[1])
        return found[0], self.strings[found[1] : end]


class Pieces(NamedTuple):
    """A text's ids, the source bytes [start, end) of each, the ids in decimals, and the text that they decode to."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    decimal: np.ndarray
    decoded: np.ndarray


class CutTable:
    """A bounded table from cuts to several strings of bytes each, which Arrow gathers for many texts at once."""

    def __init__(self, kept: int, columns: int):
        self.kept, self.known = kept, {}
        self.data, self.ends = [bytearray() for _ in range(columns)], [array("q", [0]) for _ in range(columns)]

    def add(self, cuts: list[str], columns: list[tuple[np.ndarray, bytes]]) -> None:
        self.known.update(zip(cuts, range(len(self.known), len(self.known) + len(cuts)), strict=True))
        for data, ends, (sizes, new) in zip(self.data, self.ends, columns, strict=True):
            ends.frombytes((np.cumsum(sizes) + len(data)).astype(np.int64).tobytes())
            data += new

    def places(self, cuts: list[str], learn) -> np.ndarray:
        place = np.fromiter(map(self.known.get, cuts, repeat(-1)), np.int64, len(cuts))
        if len(self.known) + np.count_nonzero(place < 0) > self.kept or sum(map(len, self.data)) > 128 * self.kept:
            # the cuts met first are the frequent ones: half of the table stays
            half = min(self.kept, len(self.known)) // 2
            while half and sum(ends[half] for ends in self.ends) > 64 * self.kept:
                half //= 2
            self.known = dict(islice(self.known.items(), half))
            for data, ends in zip(self.data, self.ends, strict=True):
                del data[ends[half] :], ends[half + 1 :]
            place[place >= half] = -1
        new = np.flatnonzero(place < 0)
        for i in range(0, len(new), 50_000):
            start = len(self.known)
            learn([cuts[j] for j in new[i : i + 50_000].tolist()])
            place[new[i : i + 50_000]] = np.arange(start, len(self.known))
        return place

    def gathered(self, column: int, places: pa.Array, index: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a column for cuts in the order of texts, and where each text's begin. The first take brings the cuts of
        these texts together, the second one lays them out."""
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.known), [None, pa.py_buffer(self.ends[column]), pa.py_buffer(self.data[column])])
        taken = held.take(places).take(index)
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(index) + 1)[at]
        return np.frombuffer(taken.buffers()[2], np.uint8, int(offsets[-1])), offsets


class Codec:
    """A model with its normaliser, alignment, bounded table of cuts, and decoder."""

    def __init__(self, model_file: str, kept: int = KEPT):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        self.dummy, self.strip, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharMap(spec.precompiled_charsmap)
        if trainer.treat_whitespace_as_suffix or not self.escape or any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces) or any(p.type == 4 for p in model.pieces):
            raise ValueError("only models whose pieces hold spaces in front, and without user symbols, can be cut at spaces")
        # normalisation is done here, so the library is given a copy that does none
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.whole = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.identity = not self.map.units
        self.widths = np.array([1 if self.plain.IsByte(i) else len(self.plain.IdToPiece(i).encode("utf-8")) for i in range(self.plain.GetPieceSize())], np.int64)
        self.table = CutTable(kept, 4)
        self.decimals = pa.array([f"{i},".encode() for i in range(len(self.widths))], pa.binary())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte."""
        data = text.encode("utf-8")
        out, source, i, n = [], [], 0, len(data)
        pieces: list[tuple[bytes, int]] = []
        while i < n:
            hit = self.map.longest(data, i)
            if hit is None:
                width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                pieces.append((data[i : i + width], i))
                i += width
            else:
                pieces.append((hit[1], i))
                i += hit[0]
        if self.strip:
            while pieces and pieces[0][0].strip(b" ") == b"":
                pieces.pop(0)
            while pieces and pieces[-1][0].strip(b" ") == b"":
                n = pieces.pop()[1]
        mark = SPACE.encode()
        if self.dummy and pieces:
            out.append(mark), source.extend([pieces[0][1]] * 3)
        space = self.strip
        for new, at in pieces:
            if self.strip and space:
                new = new.lstrip(b" ")
            if not new:
                continue
            if self.strip:
                new = re.sub(rb" +", b" ", new)
            space = new.endswith(b" ") if self.strip else False
            new = new.replace(b" ", mark)
            out.append(new), source.extend([at] * len(new))
        if self.strip:
            while out and out[-1].endswith(mark) and len(out) > 1:
                out[-1] = out[-1][: -len(mark)]
                del source[-len(mark) :]
                if out[-1]:
                    break
                out.pop()
        source.append(n)
        return b"".join(out).decode("utf-8"), np.array(source, np.int64)

    def cuts(self, text: str) -> tuple[list[str], np.ndarray | None]:
        """The cuts of the normalised text; the alignment, None where it is the
        identity but for the prefix and the width of marks."""
        if self.identity and not self.strip and self.dummy and SPACE not in text:
            if not text:
                return [], None
            parts = text.split(" ")
            if "" in parts:
                parts = [x[1:].replace(" ", SPACE) for x in re.findall(" +[^ ]*", " " + text)]
            return parts, None
        text, source = self.normalise(text)
        parts = re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", text)
        return [x[1:] if x[0] == SPACE else BARE + x for x in parts], source

    def _learn(self, new: list[str]) -> None:
        """Adds cuts to the table: ids, ids as decimals with a comma behind each, source bytes of each piece (the space in
        front counted), and what the ids decode to, with the space in front."""
        coded = self.plain.encode([SPACE + x for x in new], num_threads=1)
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.int64, int(n.sum()))
        source = " ".join(new).replace(SPACE, " ")
        starts, ends = self.spans(source, ids, None)
        wide = ends - starts
        wide[0] += 1  # the one cut without a space in front of it here
        decoded = [b" " + x.encode("utf-8") for x in self.whole.decode(coded, num_threads=1)]
        decimal = self.decimals.take(pa.array(ids))
        edge = np.concatenate(([0], np.cumsum(n)))
        size = np.diff(np.frombuffer(decimal.buffers()[1], np.int32, len(decimal) + 1)[edge])
        self.table.add(new, [(n * 4, ids.astype(np.uint32).tobytes()), (n * 4, wide.astype(np.uint32).tobytes()), (size, decimal.buffers()[2].to_pybytes() if len(ids) else b""), (np.fromiter(map(len, decoded), np.int64, len(decoded)), b"".join(decoded))])

    def pieces(self, texts: pa.Array) -> list[Pieces]:
        """What becomes of each text: texts whose spaces stand alone are cut together and their pieces gathered from the
        table; others are normalised one by one."""
        odd = np.asarray(pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}")) if self.identity and not self.strip and self.dummy else np.ones(len(texts), bool)
        out: list[Pieces | None] = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._one(texts[i].as_py())
        good = np.flatnonzero(~odd)
        if len(good):
            lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
            at = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))))
            coded = lists.flatten().dictionary_encode()
            places = pa.array(self.table.places(coded.dictionary.to_pylist(), self._learn))
            ids, wide, decimal, decoded = (self.table.gathered(c, places, coded.indices, at) for c in range(4))
            edge = ids[1] // 4
            flat, w = ids[0].view(np.uint32), wide[0].view(np.uint32).astype(np.int64)
            w[edge[:-1]] -= 1  # a text's first piece has no space in front
            upto = np.cumsum(w)
            for k, i in enumerate(good.tolist()):
                a, b = edge[k], edge[k + 1]
                ends = upto[a:b] - (upto[a] - w[a])
                out[i] = Pieces(flat[a:b], ends - w[a:b], ends, decimal[0][decimal[1][k] : decimal[1][k + 1] - 1], decoded[0][decoded[1][k] + 1 : decoded[1][k + 1]])
        return out

    def _one(self, text: str) -> Pieces:
        """A text by itself, through its own alignment."""
        parts, source = self.cuts(text)
        coded = self.plain.encode([x[1:] if x[:1] == BARE else SPACE + x for x in parts], num_threads=1)
        ids = np.fromiter(chain.from_iterable(coded), np.uint32)
        starts, ends = self.spans(text, ids, source)
        said = np.frombuffer(",".join(map(str, ids.tolist())).encode(), np.uint8)
        return Pieces(ids, starts, ends, said, np.frombuffer(self.decode([ids])[0].encode("utf-8"), np.uint8))

    def spans(self, text: str, ids: np.ndarray, source: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes [start, end) of each piece. The added prefix has no bytes of its
        own; a byte piece that is part of a character gets its single byte."""
        if source is None:
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            wide = np.where(raw == 0x20, 3, 1)
            source = np.concatenate((np.zeros(3, np.int64), np.repeat(np.arange(len(raw)), wide), [len(raw)])) if text else np.zeros(1, np.int64)
        at = np.concatenate(([0], np.cumsum(self.widths[ids])))
        if len(ids) and at[-1] != len(source) - 1:
            raise ValueError("the pieces do not cover the normalised text")
        edges = source[at]
        return edges[:-1], edges[1:]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode([x.tolist() for x in ids], num_threads=1)


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(kind)))


def _pieces(c: Codec, part: pa.RecordBatch) -> list[Pieces]:
    return c.pieces(pa.array(pc.fill_null(part.column("text"), "")))


def encode_pieces(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, starts, ends) per row: piece ids without begin or end id, and the
    bytes of the original text that each piece covers.

    Null is encoded as empty, which has no ids. Texts of any length are encoded whole; repeated rows and
    null ids each get their row; an empty table gives no rows. The model file must be at the
    same path on every worker, as an installed package is.
    """
    path = model_file or default_model()

    @tidy
    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                got = _pieces(c, part)
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists([g.ids for g in got], np.int32), _lists([g.starts for g in got], np.int32), _lists([g.ends for g in got], np.int32)], ["id", "ids", "starts", "ends"])

    return two(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>, starts array<int>, ends array<int>")


def decode_pieces(coded: DataFrame, model_file: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids decode to an empty text."""
    path = model_file or default_model()

    @tidy
    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(c.decode(ids) if ids else [], pa.string())], ["id", "text"])

    return coded.select(coded[id_col].cast("long").alias("id"), coded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")


def piece_digests(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, covered_bytes, spans_sha256) per row, encoded, projected and
    decoded in one pass; covered_bytes is the number of source bytes that the pieces' spans hold, spans_sha256 the
    digest of all starts and then all ends as little-endian 64-bit numbers."""
    path = model_file or default_model()

    def sha(*parts: np.ndarray) -> str:
        h = hashlib.sha256()
        for x in parts:
            h.update(np.ascontiguousarray(x))
        return h.hexdigest()

    @tidy
    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                got = _pieces(c, part)
                n = pa.array([len(g.ids) for g in got], pa.int64())
                covered = pa.array([int((g.ends - g.starts).sum()) for g in got], pa.int64())
                digests = [pa.array([sha(*parts) for parts in column]) for column in (((g.decimal,) for g in got), ((g.decoded,) for g in got), ((g.starts.astype("<i8", copy=False), g.ends.astype("<i8", copy=False)) for g in got))]
                yield pa.RecordBatch.from_arrays([part.column("id"), n, *digests[:2], covered, digests[2]], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "spans_sha256"])

    return two(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, spans_sha256 string")


def encoded_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Documents as training rows: doc_id, lang, source (null where documents lack them), n_tokens, the piece ids, and
    the source bytes of each. Every row gets its own, also where an id repeats or is null; a null text has no pieces."""
    path = model_file or default_model()
    kept = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]

    @tidy
    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                got = _pieces(c, part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), pa.array([len(g.ids) for g in got], pa.int64()), _lists([g.ids for g in got], np.int32), _lists([g.starts for g in got], np.int32), _lists([g.ends for g in got], np.int32)], ["doc_id", "lang", "source", "n_tokens", "ids", "starts", "ends"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *kept, docs["text"].cast("string").alias("text"))
    return bounded(rows).mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, starts array<int>, ends array<int>")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of ids and decoded texts, and one of the pieces' source bytes."""
    return piece_digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
