"""Operator 7: WARC archives and an external merge of their capture index.

Writing: each page is a record of WARC/1.1 in a gzip member of its own, so a record can be read from its offset
alone. A payload of at least 100 bytes that a page of smaller id also has is written as a revisit (profile
identical-payload-digest), its block the HTTP header alone. Tasks pack members into archives of about ARCHIVE_BYTES
(a larger record alone), one row an archive, and Spark's text writer makes each row a file, so files
are committed whole on any file system that Spark knows and a retried task leaves no
half archive. The last byte of a member is the top byte of its size, 0 below 16 MB; the writer's line end
supplies it, and a larger record is split over members.

Index: reading an archive back gives one capture run, sorted by (URL key, timestamp, page) and stored in blocks in that
order. The key space is cut into ranges at quantiles of the blocks' first keys, each block is cut at them, and the blocks of a range,
which are sorted run by run as they were stored, are merged by a loser tree: log2(k)
comparisons a capture. Ranges in order are the global capture history.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from itertools import groupby, pairwise
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table

LEAST = 100
#: Uncompressed bytes of an archive, captures of a merge range, and of a block, about; keys that choose the ranges, at most.
ARCHIVE_BYTES, RANGE_ROWS, BLOCK_ROWS, SAMPLE = 32 << 20, 50_000, 5_000, 100_000
#: Bytes of a record in one gzip member.
MEMBER = 15 << 20
_RUN = "run string, urlkey string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, at long, skip long, size long"


def _clean(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '[\\\\x00-\\\\x20\\\\x7F]', '%20')"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> None:
    """Write one record per row under path.

    A null html is an empty payload, a null url an empty target. White space in a url is
    written as %20. Rows that repeat an id each become a record.
    Rows with a null id are archived under id -1.
    """
    spark = pages.sparkSession
    rows = pages.select(F.coalesce(pages[id_col].cast("long"), F.lit(-1).cast("long")).alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    body = rows.selectExpr("id", "url", "encode(coalesce(html, ''), 'UTF-8') as body").selectExpr("*", "octet_length(body) as n", "sha2(body, 256) as digest")
    same = body.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    same = stored(same, "digests")
    size = same.count()
    small = size <= 200_000  # 72 bytes each: under 16 MB; beyond that the join shuffles
    body = body.join(F.broadcast(same) if small else same, "digest", "left").withColumn("revisit", F.expr("first is not null and first <> id"))
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', n, '\\r\\n\\r\\n')"
    head = f"""concat('WARC/1.1\\r\\nWARC-Type: ', if(revisit, 'revisit', 'response'),
        '\\r\\nWARC-Record-ID: <urn:page:', id, '>\\r\\nWARC-Date: ', date_format(timestamp_seconds(1700000000 + id), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        '\\r\\nWARC-Target-URI: ', {_clean('url')},
        '\\r\\nWARC-Payload-Digest: sha256:', digest,
        if(revisit, concat('\\r\\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\\r\\nWARC-Refers-To: <urn:page:', first, '>'), ''),
        '\\r\\nContent-Type: application/http; msgtype=response\\r\\nContent-Length: ', octet_length(http) + if(revisit, 0, n), '\\r\\n\\r\\n', http)"""
    record = body.selectExpr("*", f"{http} as http").selectExpr(f"concat(cast({head} as binary), if(revisit, cast('' as binary), body), cast('\\r\\n\\r\\n' as binary)) as record")
    packed = record.mapInArrow(_pack, "archive binary").selectExpr("cast(archive as string) as value")
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _members(record: memoryview):
    for i in range(0, max(len(record), 1), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield z.compress(record[i : i + MEMBER]) + z.flush()


def _pack(batches):
    """Records to archives; the last byte of each, which is 0, is left to the writer's line end."""
    held, size = [], 0

    def archive():
        out = pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["archive"])
        held.clear()
        return out

    for batch in batches:
        for record in batch.column("record"):
            raw = record.as_buffer()
            if held and size + raw.size > ARCHIVE_BYTES:
                yield archive()
                size = 0
            held.extend(_members(memoryview(raw)))
            size += raw.size
    if held:
        yield archive()


def surt(url: str) -> str:
    """URL key: host labels reversed, scheme, www and fragment dropped, lower case, query sorted."""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    host = re.sub(r"^www\d*\.", "", m[1].rpartition("@")[2].lower())
    host, _, port = host.partition(":")
    host = ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "")
    query = "?" + "&".join(sorted(m[3].lower().split("&"))) if m[3] else ""
    return f"{host}){unquote(m[2]).lower().rstrip('/') or '/'}{query}"


def read_records(chunks):
    """(offset, skip, size, headers, HTTP header, payload) of each record of an archive given in pieces, whatever its gzip
    members hold: the record begins `skip` bytes into what the member at `offset` (a byte of the file) unpacks to, and has `size` bytes unpacked.
    One record is held at a time."""
    chunks, pending = iter(chunks), b""
    z = None
    buffer, taken, made, at = bytearray(), 0, 0, 0  # bytes of the file and unpacked ones so far; where the next record begins
    members: list[tuple[int, int]] = []  # first unpacked byte, offset

    def more() -> bool:
        nonlocal z, pending, taken, made
        data = pending or next(chunks, b"")
        if not data:
            if z is not None and not z.eof:
                raise ValueError(f"an archive ends inside a member, {taken} bytes in")
            return False
        if z is None or z.eof:
            z = zlib.decompressobj(31)
            members.append((made, taken))
        out = z.decompress(data)
        pending = z.unused_data
        taken += len(data) - len(pending)
        made += len(out)
        buffer.extend(out)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError(f"an archive ends inside a record, {at} bytes in unpacked")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record {at} bytes in unpacked")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        size = end + 4 + n + 4
        while len(buffer) < size:
            if not more():
                raise ValueError(f"an archive ends inside a record, {at} bytes in unpacked")
        block = bytes(buffer[end + 4 : end + 4 + n])
        http, _, payload = block.partition(b"\r\n\r\n")
        while len(members) > 1 and members[1][0] <= at:
            members.pop(0)
        yield members[0][1], at - members[0][0], size, headers, http, payload
        del buffer[:size]
        at += size


def record_at(archive: bytes, at: int, skip: int = 0):
    """(headers, HTTP header, payload) of the record of an archive at an offset, without reading what lies before."""
    view = memoryview(archive)[at:]
    if skip:
        z = zlib.decompressobj(31)
        view = zlib.compress(z.decompress(view)[skip:], wbits=31) + z.unused_data
    return next(read_records(_pieces(view)))[3:]


def _pieces(content, size: int = 1 << 20):
    view = memoryview(content)
    return (view[i : i + size] for i in range(0, len(view), size))


_CAPTURE = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in (x.split() for x in _RUN.split(", "))])
_BLOCKS = "run string, seq int, n long, urlkey string, ts string, page_id long, block binary"
_KEY = ("urlkey", "ts", "page_id")


def _packed(block: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(block)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _runs(batches):
    """Archives to sorted runs of captures, in blocks with their first keys."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            out, name = [], path.as_py().rsplit("/", 1)[-1]
            for at, skip, size, h, http, payload in read_records(_pieces(content.as_buffer())):
                digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"] == "revisit"
                n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if not revisit and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{name}: the payload at {at} is damaged")
                page = int(h["WARC-Record-ID"][10:-1])
                out.append((name, surt(h["WARC-Target-URI"]), h["WARC-Date"], page, n, digest, h["WARC-Type"], int(h["WARC-Refers-To"][10:-1]) if revisit else None, at, skip, size))
            out.sort(key=lambda x: x[1:4])
            for seq, i in enumerate(range(0, len(out), BLOCK_ROWS)):
                rows = out[i : i + BLOCK_ROWS]
                block = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (seq, pa.int32()), (len(rows), pa.int64()), (rows[0][1], pa.string()), (rows[0][2], pa.string()), (rows[0][3], pa.int64()), (_packed(block), pa.binary()))], ["run", "seq", "n", *_KEY, "block"])


def _keys(block: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(block.column(c).to_pylist() for c in _KEY), strict=True))


def _cut(edges: list[tuple]):
    """Blocks to pieces of one range each."""

    def run(batches):
        for batch in batches:
            for name, seq, data in zip(batch.column("run").to_pylist(), batch.column("seq").to_pylist(), batch.column("block"), strict=True):
                block = _unpacked(data.as_py())
                keys = _keys(block)
                cuts = [0, *(bisect_left(keys, e) for e in edges), len(keys)]
                for r, (a, b) in enumerate(pairwise(cuts)):
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((r, pa.int32()), (name, pa.string()), (seq, pa.int32()), (_packed(block.slice(a, b - a)), pa.binary()))], ["range", "run", "seq", "block"])

    return run


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, so the next
    item takes one path from its leaf to the root."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        x = next(self.runs[i], None)
        return None if x is None else (self.key(x), i, x)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at:
            if self.tree[at] < 0:  # the tree is being built: wait for the other side
                self.tree[at] = winner
                return
            if self._beats(self.tree[at], winner):
                winner, self.tree[at] = self.tree[at], winner
            at //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (head := self.heads[i := self.tree[0]]) is not None:
            yield head[2]
            self.heads[i] = self._next(i)
            self._play(i)


def _merge(batches):
    """The pieces of ranges, which arrive range by range and run by run, each run's in order."""

    def merged(pieces: list[tuple[str, bytes]]):
        blocks = [(run, _unpacked(data)) for run, data in pieces]
        table_ = pa.Table.from_batches([b for _, b in blocks])
        keys, runs, at = [k for _, b in blocks for k in _keys(b)], [], 0
        for _, group in groupby(blocks, lambda x: x[0]):
            n = sum(b.num_rows for _, b in group)
            runs.append(range(at, at + n))
            at += n
        yield from table_.take(pa.array(list(LoserTree(runs, keys.__getitem__)))).to_batches(max_chunksize=BLOCK_ROWS)

    now, held = None, []
    for batch in batches:
        for r, run, data in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), batch.column("block"), strict=True):
            if r != now and held:
                yield from merged(held)
                held = []
            now = r
            held.append((run, data.as_py()))
    if held:
        yield from merged(held)


def capture_index(archives: str, spark: SparkSession, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures of the archives under a path in global order of (urlkey, ts,
    page_id): partition i precedes partition i + 1, and so do rows in it. at and skip tell where in its archive a record is.
    No archives, no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,gz}").load(archives).select("path", "content")
    runs = stored(files.mapInArrow(_runs, _BLOCKS), "runs")
    total, blocks = (x or 0 for x in runs.agg(F.sum("n"), F.count("*")).first())
    ranges = max(1, -(-total // range_rows))
    edges: list[tuple] = []
    if ranges > 1:
        first = runs.where(F.pmod(F.xxhash64("run", "seq"), F.lit(blocks // SAMPLE + 1)) == 0).select(*_KEY)
        sample = sorted(tuple(r) for r in first.collect())  # at most about SAMPLE keys
        edges = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)})
    dealt = runs.select("run", "seq", "block").mapInArrow(_cut(edges), "range int, run string, seq int, block binary").repartitionByRange(len(edges) + 1, "range").sortWithinPartitions("range", "run", "seq")
    return dealt.mapInArrow(_merge, _RUN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, from the merged index of archives written from the pages."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    out = capture_index(path, spark)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, cast(octet_length(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from f
"""
