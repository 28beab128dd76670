"""Readers. Paths may be anything Spark reads; nothing is opened on the driver but small documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict JSONL: blank lines are passed over, a line that isn't an object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSONL with file and line; the error of a bad line names both.

    Lines are numbered within a file by Spark's row index of the text scan; files aren't split for this.
    """
    lines = spark.read.option("wholetext", "false").option("lineSep", "\n").text(path).select(F.col("value"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("__i"))
    n = lines.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("__i"))).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    bad = ~F.trim(F.col("value")).rlike(r"(?s)^\{.*\}$") | row.isNull() | F.try_parse_json("value").isNull()
    checked = F.when(bad, F.raise_error(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": not a JSON object"))).cast(T.StructType.fromDDL(schema))).otherwise(row)
    return n.withColumn("row", checked).select("file", "line", "row.*")


def json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSONL, told by the first character that isn't blank (S3)."""
    head = spark.read.option("wholetext", "false").text(path).where(F.trim("value") != "").limit(1).collect()
    many = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", many).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the text of those that don't."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    both = lines.withColumn("row", row).withColumn("ok", F.trim("value").rlike(r"(?s)^\{.*\}$") & F.col("row.__bad").isNull())
    return both.where("ok").select("row.*").drop("__bad"), both.where("not ok").select(F.col("value").alias("__bad"))


def jsonl_shards(spark: SparkSession, folder: str, schema: str, prefix: str | None = None, text: str = "prompt") -> DataFrame:
    """part*.json or .jsonl with a global line number in the order of file names; optionally only prompts with a prefix."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/part*.json*").withColumn("file", F.input_file_name()).withColumn("__i", F.monotonically_increasing_id())
    counts = rows.groupBy("file").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__from", F.sum("__n").over(Window.orderBy("file")) - F.col("__n")).drop("__n")  # a row a file
    out = rows.join(F.broadcast(offsets), "file").withColumn("line_number", F.col("__from") + F.row_number().over(Window.partitionBy("file").orderBy("__i"))).drop("__i", "__from")
    return out if prefix is None else out.where(F.startswith(text, F.lit(prefix)))


def parquet(spark: SparkSession, paths: list[str], columns: list[str] | None = None, identity: str | None = None, most: int | None = None, seed: int | None = None) -> DataFrame:
    """Files together, some columns, and a sample in hash order or the head."""
    df = spark.read.parquet(*paths)
    df = df if columns is None else df.select(*columns)
    if most is None:
        return df
    return df.orderBy(F.xxhash64(F.lit(seed), identity), identity).limit(most) if seed is not None else df.orderBy(identity).limit(most)


def within_prompt_length(df: DataFrame, prompt: str, most: int, length=F.char_length) -> DataFrame:
    """Rows whose prompt (role, content), as a chat text with the opening of an answer, is no longer than `most`.

    length: of a text column; characters by default, a tokenizer's count where one is given. A null prompt or content can't be measured, so its row goes.
    """
    turns = F.transform(prompt, lambda m: F.concat(m["role"], F.lit(chr(10)), m["content"], F.lit(chr(10))))
    whole = F.when(~F.exists(turns, lambda x: x.isNull()), F.concat(F.array_join(turns, ""), F.lit("assistant\n")))
    return df.where(F.coalesce(length(whole) <= most, F.lit(False)))


def arrow_ipc(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Arrow stream or file shards, read on executors from Spark's own binary scan, with the row's place in its shard."""
    import io

    import pyarrow as pa

    def load(content: bytes) -> pa.Table:
        try:
            return pa.ipc.open_file(io.BytesIO(content)).read_all()
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(io.BytesIO(content)).read_all()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder)
    first = files.orderBy("path").select("content").limit(1).collect()
    if not first:
        raise ValueError(f"no .arrow shards in {folder}")
    from pyspark.sql.pandas.types import from_arrow_schema

    head = load(bytes(first[0][0])).schema
    wanted = columns or head.names
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("row", T.LongType()), *[f for f in from_arrow_schema(head).fields if f.name in wanted]])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                t = load(content).select([f.name for f in schema.fields[2:]])
                at = 0
                for r in t.to_batches(10_000):
                    n = r.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(at, at + n), pa.int64()), *r.columns], names=schema.names)
                    at += n

    return files.select("path", "content").mapInArrow(run, schema)


def blobs(df: DataFrame, cells: str, sizes: DataFrame | None = None) -> DataFrame:
    """Nested binary cells as rows with length and digest; only of wanted lengths, tested before hashing."""
    flat = df.select(F.explode(cells).alias("content")).where("content is not null").withColumn("n_bytes", F.octet_length("content"))
    if sizes is not None:
        flat = flat.join(sizes.select("n_bytes").distinct(), "n_bytes", "left_semi")
    return flat.withColumn("sha256", F.sha2("content", 256))


def metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    """metric JSON files as (method, dataset, ratio, metric, value): the path is .../method/dataset/ratio.json."""
    parts = F.split(F.input_file_name(), "/")
    rows = spark.read.option("wholetext", "true").text(pattern).select("value", parts.alias("p"))
    m = F.from_json("value", "map<string,double>")
    at = lambda i: F.element_at("p", i)
    return rows.select(at(-3).alias("method"), at(-2).alias("dataset"), F.regexp_extract(at(-1), r"([0-9.]+)\.json", 1).cast("double").alias("ratio"), F.explode(m).alias("metric", "value"))


def result_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON file a job; job_id is the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json").withColumn("job_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def _depth(spark: SparkSession, path: str) -> int:
    """How many parts the full name of a path has, scheme included."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return len(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().split("/"))


def file_index(spark: SparkSession, folder: str, suffixes: str = "jpg|jpeg|png|tif|tiff") -> DataFrame:
    """(name, path, n_bytes) of files below a folder (or a pattern of folders), but for hidden and test folders met below it; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("n_bytes"))
    parts = F.split("path", "/")
    below = F.slice(parts, _depth(spark, folder) + 1, F.greatest(F.size(parts) - _depth(spark, folder) - 1, F.lit(0)))
    pruned = F.exists(below, lambda d: F.startswith(d, F.lit(".")) | F.contains(F.lower(d), F.lit("test")))
    seen = files.where(F.lower("path").rlike(rf"\.({suffixes})$") & ~pruned)
    return seen.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "n_bytes")


def coco(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of COCO documents."""
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    one = lambda c: doc.select(F.explode(c).alias("x")).select("x.*")
    return one("images"), one("annotations"), one("categories")


def evalset(df: DataFrame, task: str, images: str, prompt: str, references: str) -> DataFrame:
    """Any table as (task, images, prompt, references)."""
    ref = F.col(references) if isinstance(df.schema[references].dataType, T.ArrayType) else F.array(references)
    img = F.col(images) if isinstance(df.schema[images].dataType, T.ArrayType) else F.array(images)
    return df.select(F.lit(task).alias("task"), img.alias("images"), F.col(prompt).alias("prompt"), ref.alias("references"))


def base64_images(df: DataFrame, column: str) -> DataFrame:
    """Base64 text as bytes, a data URL's head dropped."""
    return df.withColumn(column, F.unbase64(F.regexp_replace(column, "^data:[^,]*,", "")))
