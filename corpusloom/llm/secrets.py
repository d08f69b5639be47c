"""Operator 6: secret scans through a trigram index.

Each rule's regex is parsed and turned into a Boolean query over trigrams that
every match must hold: a concatenation is an AND of its runs of literal text, an
alternation an OR of its branches. Documents are indexed in segments (a slice of
an Arrow batch): the postings of trigrams are built in one
vectorised pass over the segment's bytes, lower-cased; queries intersect and
unite postings, and only the documents that are left are searched with the
regex. A rule without a mandatory trigram (a run of hex digits) scans every
document. Segments are independent, so a lost executor costs its segments only and
no postings are shuffled.

index_documents() keeps the postings of all trigrams beside the texts, so that further rules are searched without
reading other segments' texts anew; find_secrets() is one search, and posts only the trigrams that its rules name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, slices, table, tidy, two


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the group whose length counts, the least length."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII


#: The base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Kinds that the method adds.
MORE = (
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})", 16, 1),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]{1,64}:([^\x00-\x20/:@]{6,64})@"),
)
RULES = BASE + MORE

ALL = ("and",)  # the query that any document answers


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """("and" | "or", parts...) over lower-case trigrams that any match must hold.

    Literal runs are tracked across concatenation; single characters of a set, or a
    repeat, end a run. ALL where nothing is mandatory.
    """

    def both(parts: list[tuple]) -> tuple:
        flat = [y for x in parts for y in (x[1:] if x[0] == "and" else (x,))]
        return ("and", *dict.fromkeys(flat))

    def either(parts: list[tuple]) -> tuple:
        return ALL if ALL in parts else ("or", *dict.fromkeys(parts))

    def walk(tree) -> tuple:
        found, run = [], ""

        def close() -> None:
            nonlocal run
            grams = [run[i : i + 3] for i in range(len(run) - 2)]
            found.extend(("tri", g) for g in grams if g.isascii())
            run = ""

        for op, arg in tree:
            if op is C.LITERAL:
                run += chr(arg).lower()
            elif op is C.SUBPATTERN:
                inner = list(arg[3])
                if all(o is C.LITERAL for o, _ in inner):
                    run += "".join(chr(a) for _, a in inner).lower()
                else:
                    close()
                    found.append(walk(inner))
            elif op is C.BRANCH:
                close()
                found.append(either([walk(list(b)) for b in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                close()
                if arg[0] >= 1:
                    found.append(walk(list(arg[2])))
            else:
                close()
        close()
        return both([x for x in found if x != ALL])

    return walk(list(parser.parse(pattern, flags)))


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_of(x) for x in query[1:])) if len(query) > 1 else set()


def evaluate(query: tuple, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Sorted row numbers that answer a query."""
    if query[0] == "tri":
        return postings[query[1]]
    parts = [evaluate(x, postings, n) for x in query[1:]]
    if not parts:
        return np.arange(n)
    out = parts[0]
    for x in parts[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.regexes = [re.compile(r.pattern, r.flags) for r in rules]
        # a run of a set with a least length needs no start inside a shorter run
        self.quick = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}", r.flags) if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else x for r, x in zip(rules, self.regexes, strict=True)]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        grams = sorted(set().union(*(trigrams_of(q) for q in self.queries)))
        self.grams = grams
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        heads = np.zeros(65536, bool)
        self.codes = {}
        for g in grams:
            a, b, c = g.encode()
            heads[a << 8 | b] = True
            self.codes[a << 16 | b << 8 | c] = g
        self.heads = heads

    def postings(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Sorted row numbers of a segment by trigram, for the queries' trigrams."""
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        out = dict.fromkeys(self.grams, np.empty(0, np.int64))
        if data is None or at[-1] - at[0] < 3:
            return out
        b = self.lower[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
        at = at - at[0]
        two_ = (b[:-2].astype(np.uint16) << 8) | b[1:-1]
        p = np.flatnonzero(self.heads[two_])
        code = two_[p].astype(np.int64) << 8 | b[p + 2]
        for c, g in self.codes.items():
            hit = p[code == c]
            if len(hit):
                row = np.searchsorted(at, hit, "right") - 1
                out[g] = np.unique(row[hit + 3 <= at[row + 1]])
        return out

    def scan(self, texts: pa.Array, postings: dict[str, np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
        """Spans (start, end, rule number) of each text, in code points."""
        n, found = len(texts), [[] for _ in range(len(texts))]
        postings, strings = self.postings(texts) if postings is None else postings, texts.to_pylist()
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.quick, self.queries, strict=True)):
            for i in evaluate(query, postings, n).tolist():
                for m in regex.finditer(strings[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), m.end(), k))
        for x in found:
            x.sort(key=lambda s: (s[0], s[2], s[1]))
        return found


def all_postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes of the segment's trigrams of ASCII, lower-cased, where each one's rows end, and the rows."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    if data is None or at[-1] - at[0] < 3:
        return np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint16)
    lower = np.arange(256, dtype=np.int64)
    lower[65:91] += 32
    b = lower[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    inside = (row[:-2] == row[2:]) & (np.maximum(np.maximum(b[:-2], b[1:-1]), b[2:]) < 128)
    pair = np.unique(((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) << 16 | row[:-2])[inside])
    codes, n = np.unique(pair >> 16, return_counts=True)
    return codes.astype(np.uint32), np.cumsum(n).astype(np.uint32), (pair & 0xFFFF).astype(np.uint16)


_SEGMENT = "ids array<long>, texts array<string>, codes binary, ends binary, rows binary"


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments: ids and texts of some rows, and the postings of all their trigrams. Written as a table, it serves any
    number of searches; a null text is kept as null and holds no trigram."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = all_postings(pa.array(pc.fill_null(part.column("text"), "")))
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, pa.array(part.column("id"))), pa.ListArray.from_arrays(one, pa.array(part.column("text"))), *(pa.array([x.tobytes()], pa.binary()) for x in made)], ["ids", "texts", "codes", "ends", "rows"])

    return two(docs, id_col, text_col).mapInArrow(run, _SEGMENT)


def search_index(segments: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """What find_secrets gives, from the stored postings."""

    @tidy
    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            for ids, texts, *stored in zip(*(batch.column(c) for c in ("ids", "texts", "codes", "ends", "rows")), strict=True):
                codes, ends, rows = (np.frombuffer(x.as_py(), t) for x, t in zip(stored, (np.uint32, np.uint32, np.uint16), strict=True))
                postings = dict.fromkeys(scanner.grams, np.empty(0, np.int64))
                for code, gram in scanner.codes.items():
                    i = int(np.searchsorted(codes, code))
                    if i < len(codes) and codes[i] == code:
                        postings[gram] = rows[int(ends[i - 1]) if i else 0 : int(ends[i])].astype(np.int64)
                found = scanner.scan(pa.array(pc.fill_null(texts.values, "")), postings)
                spans = pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in x] for x in found], _SPANS)
                yield pa.RecordBatch.from_arrays([ids.values, spans], ["id", "spans"])

    return segments.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(rules: tuple[Rule, ...]):
    @tidy
    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch):
                found = scanner.scan(pa.array(pc.fill_null(part.column(at), "")))
                spans = pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in x] for x in found], _SPANS)
                yield pa.RecordBatch.from_arrays([part.column("id"), spans], ["id", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans) per row: spans are whole matches (kind, start, end) in code points,
    end exclusive, by start, then by the rules' order. Matches of a kind do not
    overlap; kinds may. A null or empty text has none; repeated rows and null ids
    each get their row; an empty table gives no rows."""
    return two(docs, id_col, text_col).mapInArrow(_scan(rules), "id long, spans array<struct<kind: string, start: long, end: long>>")


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, last, end = [], 0, -1
    for s, e in sorted(spans):
        if s > end or end < 0:
            out += [text[last:s], mark]
        last = end = max(end, e)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with secrets replaced by a mark and n_chars counted anew; all rows
    and columns stay, texts without a secret (and nulls) as they are."""
    schema, kinds = docs.schema, rules

    @tidy
    def run(batches):
        scanner = Scanner(kinds)
        for batch in batches:
            at, count = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            for part in slices(batch):
                texts = part.column(at)
                found = scanner.scan(pa.array(pc.fill_null(texts, "")))
                if any(found):
                    new = [redacted(t, [(s, e) for s, e, _ in x]) if x else t for t, x in zip(texts.to_pylist(), found, strict=True)]
                    arrays = list(part.columns)
                    arrays[at] = pa.array(new, part.schema.field(at).type)
                    if count >= 0:
                        lens = pc.cast(pc.utf8_length(arrays[at]), part.schema.field(count).type)
                        arrays[count] = pc.if_else(pa.array([bool(x) for x in found]), lens, arrays[count])
                    part = pa.RecordBatch.from_arrays(arrays, names=part.schema.names)
                yield part

    return bounded(docs).mapInArrow(run, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and digest of the base kinds, and all spans."""
    out = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in base]
    listed = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"].isin(base)), said), ",")
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))
