"""Readers and writers of record files, predictions, manifests and caches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import keep_first, reject_reasons
from .json_array import array_records


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, or, in local mode without one, in a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gradeloom-")
    return f"{root.rstrip('/')}/gradeloom-files/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``scratch`` gave."""
    target, fs = _files(spark, path)
    fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _files(spark, path)
    return bool(fs.exists(target))


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, in any file system Spark reads."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def find_files(spark: SparkSession, root: str) -> list[str]:
    """All files below a folder, sorted."""
    target, fs = _files(spark, root)
    found, walk = [], fs.listFiles(target, True)
    while walk.hasNext():
        found.append(walk.next().getPath().toString())
    return sorted(found)


def find_named(spark: SparkSession, root: str, name: str) -> list[str]:
    """Files of a name below a folder, sorted."""
    return [p for p in find_files(spark, root) if p.rsplit("/", 1)[-1] == name]


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file starts as an array; reads its first bytes only."""
    target, fs = _files(spark, path)
    stream = fs.open(target)
    try:
        while (b := stream.read()) >= 0:
            if chr(b) not in " \t\r\n\ufeffï»¿":
                return chr(b) == "["
    finally:
        stream.close()
    return False


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character; raises on malformed records, or else has nulls there.

    With a schema an array is read by a task for each block of its file; without one, to find it out, by one task.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    array = is_array(spark, path)
    if array and schema is not None:
        return array_records(spark, path).select(F.from_json("text", schema, {"mode": mode}).alias("r")).select("r.*")
    reader = spark.read.option("multiLine", array).option("mode", mode)
    return (reader.schema(schema) if schema else reader).json(path)


def with_ordinal(df: DataFrame, name: str = "source_id") -> DataFrame:
    """Rows numbered 0.. in file order: per-partition counts, then offsets; no sort and no single task."""
    part = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    counts = sorted((r["__p"], r["count"]) for r in part.groupBy("__p").count().collect())
    offsets, at = {}, 0
    for p, n in counts:
        offsets[p], at = at, at + n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    starts = df.sparkSession.createDataFrame(list(offsets.items()), "__q int, __start long")
    return part.join(starts, F.col("__p") == F.col("__q")).withColumn(name, F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")).drop("__p", "__m", "__q", "__start")


def read_document(spark: SparkSession, path: str, default: object = None) -> object:
    """One small JSON document, or the default if there is no file."""
    import json

    if not exists(spark, path):
        return default
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


#: Fields that may hold a prediction's text, in order.
PREDICTION_FIELDS = ("model_output", "prediction", "output", "response", "answer", "text")


def normalize_predictions(df: DataFrame, fields: tuple[str, ...] = PREDICTION_FIELDS) -> DataFrame:
    """``model_output`` from the first field that isn't null, and ``output_field``: which one; '' and null without any."""
    have = [f for f in fields if f in df.columns]
    text = F.coalesce(*(F.col(f) for f in have), F.lit(""))
    which = F.coalesce(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in have), F.lit(None).cast("string"))
    rest = [F.col(c) for c in df.columns if c not in fields]
    return df.select(*rest, text.alias("model_output"), which.alias("output_field"))


def file_hashes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SHA-256 of each file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.sha2("content", 256).alias("sha256"))


def folder_hash(spark: SparkSession, path: str, glob: str | None = None) -> str:
    """One hash of a folder: relative paths and file hashes, in sorted order."""
    root = _files(spark, path)[0].toUri().getPath().rstrip("/") + "/"
    rows = sorted((r.path.split(root, 1)[-1], r.sha256) for r in file_hashes(spark, path, glob).collect())
    out = hashlib.sha256()
    for name, digest in rows:
        out.update(name.encode() + b"\0" + digest.encode())
    return out.hexdigest()


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path; made and written first if it isn't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def validated(df: DataFrame, rules: list[tuple[str, Column]], key: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """The first valid row of each key, and the number of rows for each first failing rule (repeats: ``duplicate``)."""
    marked = reject_reasons(df, rules)
    good = marked.where("reject_reason is null").drop("reject_reason")
    first = keep_first(good, [key], ordinal)
    counts = marked.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))
    extra = good.groupBy(key).agg((F.count("*") - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("reject_reason"), "n").where("n > 0")
    return first, counts.unionByName(extra)


def append_missing(done: DataFrame | None, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` that are not done yet."""
    return wanted if done is None else wanted.join(done.select(key), key, "left_anti")


def manifest_runs(manifest: DataFrame, summaries: DataFrame, run: str = "run_id") -> DataFrame:
    """Every run of a manifest with its summary, or status ``missing_pred``."""
    s = summaries.withColumn("__have", F.lit(1))
    return manifest.join(s, run, "left").withColumn("status", F.when(F.col("__have").isNull(), "missing_pred").otherwise("ok")).drop("__have")


def scan_manifests(spark: SparkSession, glob: str, fields: dict[str, str]) -> DataFrame:
    """Nested fields of JSON manifests by path; unreadable ones get ``error`` set."""
    text = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    tree = F.try_parse_json("value")
    out = [F.try_variant_get(tree, f"$.{p}", "string").alias(n) for n, p in fields.items()]
    return text.select("path", *out, tree.isNull().alias("error"))


def cell_text(x: Column, kind: T.DataType, digits: int = 4) -> Column:
    """A report's cell: fractions without trailing zeros, null and NaN as ``NaN``."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(?<=\.[0-9]{0,9})0+$", ""), r"\.$", "")
        return F.when(x.isNull() | F.isnan(x), "NaN").when(text == "-0", "0").otherwise(text)
    return F.coalesce(x.cast("string"), F.lit("NaN"))


#: The columns of a table of scored predictions.
SCORED_COLUMNS = ("id", "type", "query", "gold_answer", "gold_num", "pred_answer", "pred_num", "rel_error", "score", "extractable", "anchor", "output_field", "model_output")


def write_report_rows(df: DataFrame, path: str, columns: list[str] | tuple[str, ...] = SCORED_COLUMNS, cells: bool = False, bom: bool = False) -> None:
    """A CSV of fixed columns, with header: others are left out, and those that lack are null.

    ``cells``: values as a report shows them; ``bom``: the header starts with a byte order mark.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    have = [F.col(c) if c in kinds else F.lit(None).cast("string") for c in columns]
    named = [(cell_text(x, kinds.get(c, T.StringType())) if cells else x).alias(("\ufeff" if bom and i == 0 else "") + c) for i, (c, x) in enumerate(zip(columns, have))]
    df.select(*named).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_outputs(preds: DataFrame, path: str, gold: DataFrame, answer: str, summary, report: str) -> bool:
    """Writes predictions, and a report by ``summary`` of the gold rows if the first of these has an answer; whether it did."""
    write_predictions(preds, path)
    first = gold.select(answer).first()
    if first is None or first[0] is None:
        return False
    summary(preds, gold).write.mode("overwrite").json(report)
    return True


def write_artifact(rows: DataFrame, error: str, path: str, errors: str) -> None:
    """Appends good rows to an artifact and rows with an error to its log."""
    rows.where(F.col(error).isNull()).drop(error).write.mode("append").parquet(path)
    rows.where(F.col(error).isNotNull()).write.mode("append").parquet(errors)


def report_summaries(reports: DataFrame, tree: str) -> DataFrame:
    """Counts, score and buckets of JSON reports (``summary``), nulls where there is none; a missing bucket is 0."""
    got = lambda p: F.get_json_object(tree, f"$.summary.{p}")
    buckets = F.from_json(got("buckets"), "map<string,bigint>")
    rest = [c for c in reports.columns if c != tree]
    out = reports.where(got("n").isNotNull())
    return out.select(*rest, got("n").cast("long").alias("n"), got("raw_score").cast("long").alias("raw_score"), got("score_10").cast("double").alias("score_10"), *(F.coalesce(F.try_element_at(buckets, F.lit(str(k))), F.lit(0)).alias(f"b{k}") for k in (10, 5, 1, 0)))
