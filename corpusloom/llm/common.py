"""Shared pieces of the training-data operators: scratch tables and vectorised word hashing.

Everything here works on Arrow batches or DataFrames; nothing is collected that
grows with the corpus.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import fresh as scratch
from ..operators.scratch import shared_dir as shared_dir

#: Rows of an Arrow batch that are worked on at once; bounds a worker's memory.
SUB_ROWS = 4096
#: Bytes of text worked on at once, unless a single row is longer.
SUB_BYTES = 4 << 20


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and
    a lost executor costs a reread, not a recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle and checkpoint files that nothing refers to any more; it learns of them when the
    driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that Spark sends to a Python worker, and takes back, at once, unless a single row is longer.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """Holds Arrow's batches in this session to BATCH_BYTES, so that long texts do not fill the memory of either side; a
    smaller setting stays."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is not None and not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and text, under names of our own, so that other columns of any
    name cannot clash."""
    bounded(df)
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))


def tidy(run):
    """A generator over batches that gives freed memory back to the system at its end, so that a worker that waits for
    its next task does not hold what the last one needed."""

    @functools.wraps(run)
    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library trims by itself

    return out


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = SUB_ROWS, size: int = SUB_BYTES):
    """Parts of a batch of at most `rows` rows and about `size` bytes."""
    n = batch.num_rows
    if not n:
        return
    lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    start = total = 0
    for i in range(n):
        if i > start and (i - start >= rows or total + lens[i] > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(lens[i])
    yield batch.slice(start, n - start)


def _table(lower: bool, keep) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    for b in range(256):
        if not keep(b):
            t[b] = 0x20
        elif lower and 0x41 <= b <= 0x5A:
            t[b] = b + 32
    return t


#: Byte tables: words between the six ASCII white-space bytes, lower-cased A-Z.
WORDS = _table(True, lambda b: b != 0x20 and not 9 <= b <= 13)
#: Words of ASCII letters and digits and of everything beyond ASCII, lower-cased A-Z.
ALNUM = _table(True, lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def split_words(texts: pa.Array, byte_table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the offsets of each text's words (null: none)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if texts.offset or not len(texts):
        texts = pa.array(texts.to_pylist(), pa.string())
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    data = pa.py_buffer(byte_table[np.frombuffer(data, np.uint8)])
    listed = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, data))
    words, at = listed.values, np.asarray(listed.offsets, np.int64)
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not full.all():
        words = words.filter(pa.array(full))
        at = np.concatenate(([0], np.cumsum(full)))[at]
    return words, at


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes, each distinct word hashed once per call."""
    coded = words.dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    unique = np.fromiter((h(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return unique[np.asarray(coded.indices)] if len(words) else np.empty(0, np.uint64)


def hashed_words(texts: pa.Array, byte_table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, at = split_words(texts, byte_table)
    return hash_words(words), at


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, by first position."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def id_bitmap(ids: DataFrame, column: str, count: int) -> np.ndarray:
    """A bitmap of hashed ids, built by an aggregation. Its size is fixed by `count`
    and never beyond 2**27 bits (16 MB), whatever the table holds; false
    positives only cost work, since an exact join follows."""
    bits = 1 << 20
    while bits < 16 * count and bits < 1 << 27:
        bits <<= 1
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    rows = (
        ids.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(at % 64))) AS mask"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return out


def bitmap_slot(column: Column, bitmap: np.ndarray) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(len(bitmap) * 64))


def in_bitmap(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1
