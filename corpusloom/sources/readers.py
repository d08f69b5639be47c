"""Sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CORPUS = "source string, id string, license string, tier string, orig_band string, clean double, text string"
SYNTHETIC = "id string, text string, author string, work string, corpus string"


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns that a store lacks come back as nulls, so optional ones can be defaulted."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns]) if columns else df


#: What a shard without these columns means.
SHARD_DEFAULTS = {"dup_frac": 0.0, "region_id": 14, "century_id": 15}


def shards(spark: SparkSession, path: str, defaults: dict = SHARD_DEFAULTS) -> DataFrame:
    """A plane store; columns that it lacks, and nulls in them, get their default."""
    df = spark.read.parquet(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def write_shards(planes: DataFrame, path: str, order: list[str], length: str = "length") -> None:
    """A plane store: arrays with `offset`, the letters of all rows before in order. Offsets come from the sums of range
    partitions, so no task holds all rows; files are in order."""
    spark = planes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = f"{path}/_staged"
    planes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).write.parquet(staged)
    dealt = spark.read.parquet(staged)
    sums = dealt.groupBy("_part").agg(F.sum(length).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    own = F.sum(length).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = dealt.join(F.broadcast(before), "_part").withColumn("offset", F.col("_before") + own - F.col(length))
    out.drop("_part", "_before").write.parquet(f"{path}/rows")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(staged)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def parseable(rows: DataFrame) -> DataFrame:
    """Rows of jsonl() without the lines that could not be parsed."""
    return rows.where("_bad is null").drop("_bad")


def skipped(rows: DataFrame) -> DataFrame:
    """(lines, unparseable, filled) of jsonl(): filled have a value in the first column."""
    return rows.agg(F.count("*").alias("lines"), F.count("_bad").alias("unparseable"), F.count(rows.columns[0]).alias("filled"))


def jsonl_zst(spark: SparkSession, path: str, schema: str, glob: str = "*.zst") -> DataFrame:
    """JSON lines in Zstandard files, which Hadoop's reader does not open here: a file is decompressed by one task, in
    pieces, and its lines go out in batches. A line that cannot be parsed is kept in _bad."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("content")

    def run(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            for content in batch.column("content"):
                rest = b""
                reader = zstandard.ZstdDecompressor().stream_reader(content.as_buffer(), read_across_frames=True)
                while piece := reader.read(8 << 20):
                    *lines, rest = (rest + piece).split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in lines if x.strip()], pa.string())], ["value"])
                if rest.strip():
                    yield pa.RecordBatch.from_arrays([pa.array([rest.decode("utf-8", "replace")], pa.string())], ["value"])

    lines = files.mapInArrow(run, "value string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "true"}
    return lines.select(F.from_json("value", f"{schema}, _bad string", options).alias("x")).select("x.*")


#: Fixed value: the head of a Zstandard frame that readers skip, one byte long; a line end is its byte.
_SKIP = b"\x50\x2a\x4d\x18\x01\x00\x00\x00"
#: Characters of lines that are compressed into one frame, about.
_FRAME = 8 << 20


def write_jsonl_zst(rows: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines, compressed by Zstandard, in folders by columns. Frames are made by the tasks and written by Spark's text
    writer, so files are committed whole on any file system that Spark knows; the line end that it puts behind each
    frame is the content of a frame that readers skip."""
    out = rows.select(*by, F.to_json(F.struct(*[c for c in rows.columns if c not in by])).alias("value")).sortWithinPartitions(*by)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields if f.name in by)

    def run(batches):
        import pyarrow as pa
        import zstandard

        schema, key, held, size = None, None, [], 0

        def frame():
            content = zstandard.ZstdCompressor(level=6).compress("\n".join([*held, ""]).encode()) + _SKIP
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, schema, strict=True)), pa.array([content], pa.binary())], [*by, "content"])

        for batch in batches:
            schema = [batch.schema.field(c).type for c in by]
            for *own, line in zip(*(batch.column(c).to_pylist() for c in (*by, "value")), strict=True):
                if held and (own != key or size > _FRAME):
                    yield frame()
                    size = 0
                key, size = own, size + len(line)
                held.append(line)
        if held:
            yield frame()

    out.mapInArrow(run, f"{kinds}, content binary").select(*by, F.col("content").cast("string").alias("value")).write.partitionBy(*by).text(path)


def rewritten(rows: DataFrame, path: str, version: int) -> DataFrame:
    """A filtered table in place of one that it was read from: written beside it, complete before anyone reads it, and
    read back; the version before stays until it is dropped."""
    target = f"{path.rstrip('/')}-v{version}"
    rows.write.parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


def marked_lines(spark: SparkSession, path: str) -> DataFrame:
    """(plain, marked) of tab-separated lines; lines of fewer than two columns are left out."""
    cells = F.split("value", "\t")
    return spark.read.text(path).select(cells.alias("c")).where("size(c) >= 2").select(F.get("c", F.lit(0)).alias("plain"), F.get("c", F.lit(1)).alias("marked"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines from 0; a file is read by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    return whole.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def benchmark_split(spark: SparkSession, path: str, dev_lines: DataFrame) -> DataFrame:
    """(text, source, task, split) of JSON lines; the lines whose numbers are in dev_lines (line) are dev, the others test."""
    rows = numbered_lines(spark, path).select("line", F.from_json("value", "text string, source string, task string").alias("x")).select("line", "x.*")
    marked = rows.join(dev_lines.select("line").distinct().withColumn("dev", F.lit(True)), "line", "left")
    return marked.select("line", "text", "source", "task", F.when(F.col("dev"), "dev").otherwise("test").alias("split"))


def parallel_lines(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(file, line, a, b) of two folders with files of the same names and numbers of lines; a line that one side lacks is an
    error. Lines that are blank on both sides are left out."""
    x, y = (numbered_lines(spark, p).withColumnRenamed("value", n) for p, n in ((a, "a"), (b, "b")))
    both = x.join(y, ["file", "line"], "full")
    odd = F.raise_error(F.concat(F.lit("numbers of lines differ: "), F.col("file")))
    return both.select("file", "line", F.coalesce("a", odd).alias("a"), F.coalesce("b", odd).alias("b")).where("trim(a) <> '' or trim(b) <> ''")


def catalogue_names(spark: SparkSession, path: str) -> DataFrame:
    """(urn, name) of <record> blocks: author and title; a later record of a urn replaces an earlier one."""
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<record>(.*?)</record>"), F.lit(1))).alias("at", "r"))
    part = lambda tag: F.trim(F.regexp_extract("r", f"(?s)<{tag}>(.*?)</{tag}>", 1))
    rows = blocks.select("at", part("urn_cts").alias("urn"), F.concat(part("author"), F.lit(" — "), part("title_labels")).alias("name"))
    return rows.where("urn <> ''").groupBy("urn").agg(F.max_by("name", "at").alias("name"))




def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lenient: bare NaN is taken, and a line that cannot be parsed is kept in _bad."""
    out = spark.read.schema(f"{schema}, _bad string").option("allowNonNumericNumbers", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return out


def unpivot_text(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, text) of the fields that are not blank."""
    return df.unpivot([id_col], fields, "field", "text").where("trim(text) <> ''")


def id_lookup(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, tm): ids to numbers over the base name of a file that both tables name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    return b.select("id", base(F.col("file")).alias("f")).join(a.select(base(F.col("file")).alias("f"), "tm"), "f").select("id", "tm")


def xml_records(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(groups): captures of a pattern in whole files."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 0)).alias("record"))


def write_folds(df: DataFrame, path: str) -> None:
    df.write.partitionBy("fold", "role").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table; more than `limit` rows are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def report(sections: list[tuple[str, DataFrame]]) -> str:
    """Markdown of small tables under their headings."""
    return "\n\n".join(f"## {title}\n\n{markdown(df)}" for title, df in sections) + "\n"
