"""Operator 8: substring dedup by hashing units of text.

A text is cut into lines or paragraphs, and these at sentence ends, so that a passage put in
the middle of a line is seen too. Units are normalised (lower case A-Z, words joined by one space)
and digested, and so are whole lines. A unit of fewer than `least` words is digested with the words before it in the
text up to that number, so common short sentences count only in the same surroundings. Near the start of
a text there are too few words before it. With `alone` it is then digested alone, as a whole line of so few words is; those short ones
go if an earlier document holds them, but may be repeated inside a document. Without `alone` the words after
it make up the number, so every unit has a digest, copies of a text go whole, and a short line that many texts hold
(a licence, a title) stays where its surroundings are others. Digests are grouped
over all documents; the occurrence that ranks first (least id, then place) stays, all others
are removed. Ranges removed and kept keep their code points in the original text.

The grouping is a pre-aggregated minimum by digest, so a line that a third of all documents
hold is one row from each task. Digests that occur twice are written and joined back, by a join whose hot digests Spark can
split, as both sides are plain tables.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, two

LEAST = 8
_LINE, _PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+"), re.compile(r"(?s).+?(?:\n[\x09\x20]*\n+|$)")
_SENTENCE = re.compile(r"(?s).+?(?:[.!?]+[\"')\]]*(?:[\x20\x09-\x0D]+|$)|$)")


def units(text: str, level: str = "line", sentences: bool = True) -> list[tuple[int, int]]:
    """Code-point ranges that tile a text."""
    out = []
    for m in (_LINE if level == "line" else _PARAGRAPH).finditer(text):
        if sentences:
            out.extend((m.start() + s.start(), m.start() + s.end()) for s in _SENTENCE.finditer(m.group()))
        else:
            out.append(m.span())
    return out


def _digest(words: list[bytes], mark: bytes = b"") -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(b" ".join(words) + mark)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _surrounded(text: str, level: str, sentences: bool, least: int) -> list[tuple[int, int, int, int, int]]:
    """As digests, where a short unit counts with the words around it."""
    lines, flat = [], []
    for m in (_LINE if level == "line" else _PARAGRAPH).finditer(text):
        found = []
        for s, e in units(m.group(), level, sentences):
            words = m.group()[s:e].encode("utf-8").lower().split()
            if words:
                found.append((m.start() + s, m.start() + e, len(flat), len(flat) + len(words)))
                flat += words
        lines.append((m.span(), found))
    out = []
    for span, found in lines:
        for s, e, a, b in found:
            first = a if b - a >= least else max(0, b - least)
            last = max(b, min(len(flat), first + least))
            out.append((s, e, *_digest(flat[first:last], b"" if (first, last) == (a, b) else b"\0%d+%d" % (a - first, b - a)), False))
        if len(found) > 1 and found[-1][3] - found[0][2] >= least:
            out.append((*span, *_digest(flat[found[0][2] : found[-1][3]]), False))
    return out


def digests(text: str, level: str, sentences: bool, least: int, alone: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(start, end, digest high, digest low, short) of the units and whole lines that have words; short: fewer than `least` words,
    digested alone. A line is left out where its only unit has the same digest."""
    if not alone:
        return _surrounded(text, level, sentences, least)
    out, before = [], []
    for m in (_LINE if level == "line" else _PARAGRAPH).finditer(text):
        whole: list[bytes] = []
        alone = worded = 0
        for s, e in units(m.group(), level, sentences):
            words = m.group()[s:e].encode("utf-8").lower().split()
            if words:
                own = before[-(least - len(words)) :] + words if len(words) < least else words
                before = (before + words)[-least:] if len(words) < least else words[-least:]
                short = len(own) < least
                mark = b"" if own is words else b"\0%d" % len(words)
                out.append((m.start() + s, m.start() + e, *_digest(words if short else own, mark), short))
                whole += words
                worded, alone = worded + 1, short or own is words
        if worded > 1 or worded and not alone:
            short = len(whole) < least
            out.append((*m.span(), *_digest(whole, b"\0%d" % len(whole) if short else b""), short))
    return out


def _units(level: str, sentences: bool, least: int, alone: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                found = [digests(t, level, sentences, least, alone) for t in texts]
                n = [len(x) for x in found]
                flat = np.array([u for x in found for u in x], np.int64).reshape(-1, 5)
                ids = np.repeat(np.asarray(part.column("id").to_numpy(zero_copy_only=False)), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(flat[:, i].copy()) for i in range(4)), pa.array(flat[:, 4] == 1)], ["id", "s", "e", "h", "l", "short"])

    return run


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: str = "line", sentences: bool = True, least: int = LEAST, alone: bool = True) -> DataFrame:
    """(id, start, end, first_id, first_start) of each unit that occurred before, in code points.

    A line that occurred before and its units that did are a row each, so ranges may lie in one another.
    Units without words are left alone. Null and empty texts have no units. Rows with a
    null id, and rows that repeat an id, count by id: equal places of one id are one
    occurrence, so repeated rows do not remove each other.
    """
    u = two(docs, id_col, text_col).where("id is not null").mapInArrow(_units(level, sentences, least, alone), "id long, s long, e long, h long, l long, short boolean")
    u = stored(u, "units")
    first = u.groupBy("h", "l").agg(F.min(F.struct("id", "s")).alias("f"), F.max(F.struct("id", "s")).alias("g")).where("f <> g").select("h", "l", F.col("f.id").alias("first_id"), F.col("f.s").alias("first_start"))
    first = stored(first, "digests")
    return u.join(first, ["h", "l"]).where("id <> first_id or not short and s <> first_start").select("id", F.col("s").alias("start"), F.col("e").alias("end"), "first_id", "first_start")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: str = "line", sentences: bool = True, least: int = LEAST, alone: bool = True) -> DataFrame:
    """(id, text, removed, kept) of the documents that lose something: the text without repeated units, and
    both sides' ranges (start, end) in the original's code points. A document's units are gathered
    for that document alone. Rows that repeat an id are each cut alike."""
    gone = repeated_units(docs, id_col, text_col, level, sentences, least, alone).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    both = two(docs, id_col, text_col).join(gone, "id")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = {"id": [], "text": [], "removed": [], "kept": []}
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "gone")), strict=True):
                removed: list[list[int]] = []
                for x in spans:
                    if removed and removed[-1][1] >= x["start"]:
                        removed[-1][1] = max(removed[-1][1], x["end"])
                    else:
                        removed.append([x["start"], x["end"]])
                edges = [0, *(y for x in removed for y in x), len(text or "")]
                kept = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
                out["id"].append(i), out["text"].append("".join((text or "")[a:b] for a, b in kept))
                out["removed"].append([{"start": a, "end": b} for a, b in removed]), out["kept"].append([{"start": a, "end": b} for a, b in kept])
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["removed"], kind), pa.array(out["kept"], kind)], list(out))

    span = "array<struct<start: long, end: long>>"
    return both.mapInArrow(run, f"id long, text string, removed {span}, kept {span}")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed unit: doc_id, its range, and the occurrence that stays. Short units count in their surroundings."""
    out = repeated_units(table(spark, sf_dir, "documents"), alone=False)
    return out.select(F.col("id").alias("doc_id"), "start", "end", F.col("first_id").alias("first_doc_id"), "first_start")
