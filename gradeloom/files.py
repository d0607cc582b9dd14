"""Registered queries of the readers and writers: each writes files, reads them back, and returns what it read."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import report as M
from .queries import query, table
from .sources import readers as R
from .sources.readers import scratch


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs = R._files(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


@query("SELECT n_nationkey AS id, n_name AS name, 'lines' AS form FROM nation UNION ALL SELECT n_nationkey, n_name, 'array' FROM nation")
def json_round_trip(spark, sf_dir):
    """Records written as JSON lines and as one array, told apart by the reader; malformed ones would raise."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    lines, array = scratch(spark, "lines"), scratch(spark, "array") + "/all.json"
    R.write_predictions(rows.coalesce(1), lines)
    text = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("t")).first().t
    write_text(spark, array, "\n " + text)
    part = next(p for p in R.find_files(spark, lines) if p.endswith(".json"))
    read = lambda path, form: R.read_records(spark, path, "id int, name string").withColumn("form", F.lit(form))
    return read(part, "lines").unionAll(read(R.first_existing(spark, array + ".missing", array), "array"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END AS model_output, CASE WHEN c_custkey % 3 = 0 THEN 'prediction' WHEN c_custkey % 3 = 1 THEN 'answer' END AS output_field FROM customer")
def prediction_fields(spark, sf_dir):
    """Predictions under alternative field names, written as JSON and read back."""
    c = F.col("c_custkey") % 3
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(c == 0, F.col("c_name")).alias("prediction"), F.when(c == 1, F.col("c_mktsegment")).alias("answer"))
    path = scratch(spark, "predictions")
    R.write_predictions(rows, path)
    return R.normalize_predictions(spark.read.schema("id long, prediction string, answer string").json(path))


@query("SELECT p_partkey AS id, p_name AS name, regexp_replace(regexp_replace(printf('%.4f', p_retailprice), '0+$', ''), '\\.$', '') AS price FROM part")
def csv_round_trip(spark, sf_dir):
    """Report rows with formatted cells as CSV, read back as text."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.lit(1).alias("extra"))
    path = scratch(spark, "csv")
    R.write_report_rows(rows, path, ["id", "name", "price"], cells=True)
    return spark.read.option("header", True).csv(path).select(F.col("id").cast("long").alias("id"), "name", "price")


@query("""WITH r AS (SELECT c_custkey AS id, c_nationkey AS source, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_mktsegment = 'BUILDING' THEN 'building' END AS why FROM customer)
SELECT coalesce(why, 'duplicate') AS reject_reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS p FROM r WHERE why IS NULL UNION ALL SELECT *, 0 FROM r WHERE why IS NOT NULL) WHERE why IS NOT NULL OR p > 1 GROUP BY 1
UNION ALL SELECT 'kept', count(DISTINCT source) FROM r WHERE why IS NULL""")
def artifact_rejects(spark, sf_dir):
    """Rows of an artifact by the first rule they break, and how many are kept: the first of each source."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source"), "c_acctbal", "c_mktsegment")
    kept, counts = R.validated(rows, [("negative", F.col("c_acctbal") < 0), ("building", F.col("c_mktsegment") == "BUILDING")], "source", "id")
    return counts.unionAll(kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("reject_reason"), "n"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def resumed_artifact(spark, sf_dir):
    """An artifact written in two goes: the second one appends what the first has not done."""
    rows, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), scratch(spark, "artifact")
    for some in (rows.where("o_custkey > 500"), rows):
        done = spark.read.parquet(path) if R.exists(spark, path) else None
        R.append_missing(done, some, "o_orderkey").write.mode("append").parquet(path)
    return R.cached(spark, scratch(spark, "cache"), lambda: spark.read.parquet(path))


@query("SELECT r_regionkey AS id, r_name AS name, n AS nations, CASE WHEN n IS NULL THEN 'missing_pred' ELSE 'ok' END AS status FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey != 2 GROUP BY 1) ON n_regionkey = r_regionkey")
def manifest_of_runs(spark, sf_dir):
    """Runs of a manifest with their summaries; one has none.  Both are written as JSON and plucked by path."""
    regions, path = table(spark, sf_dir, "region"), scratch(spark, "manifests")
    for r in regions.orderBy("r_regionkey").limit(M.MOST_ROWS).collect():
        write_text(spark, f"{path}/{r.r_regionkey}.json", f'{{"run": {{"id": {r.r_regionkey}, "name": "{r.r_name}"}}}}')
    found = R.scan_manifests(spark, f"{path}/*.json", {"id": "run.id", "name": "run.name"}).where("not error")
    n = table(spark, sf_dir, "nation").where("n_regionkey != 2").groupBy(F.col("n_regionkey").cast("string").alias("id")).agg(F.count("*").alias("nations"))
    return R.manifest_runs(found.select("id", "name"), n, "id").select(F.col("id").cast("int").alias("id"), "name", "nations", "status")


@query("SELECT n_nationkey::VARCHAR || '.txt' AS name, sha256(n_name) AS sha256 FROM nation")
def hashed_files(spark, sf_dir):
    path = scratch(spark, "files")
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(M.MOST_ROWS).collect():
        write_text(spark, f"{path}/{r.n_nationkey}.txt", r.n_name)
    return R.file_hashes(spark, path, "*.txt").select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS line, '| ' || n_name || ' | ' || n_regionkey || ' |' AS text FROM nation")
def markdown_table(spark, sf_dir):
    """A pipe table's lines behind its head."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", "n_regionkey")
    path = scratch(spark, "md") + "/table.md"
    write_text(spark, path, M.markdown(rows))
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "text"))
    return lines.where("at >= 2 and text != ''").select((F.col("at") - 2).cast("long").alias("line"), "text")


@query("SELECT 'good' AS part, count(*) FILTER (c_acctbal >= 0) AS n FROM customer UNION ALL SELECT 'errors', count(*) FILTER (c_acctbal < 0) FROM customer UNION ALL SELECT 'report', 1")
def artifact_with_errors(spark, sf_dir):
    """Good rows and errors written apart, and a report beside the outputs, for the gold rows have answers."""
    rows = table(spark, sf_dir, "customer").withColumn("error", F.when(F.col("c_acctbal") < 0, "negative"))
    good, errors, out = scratch(spark, "good"), scratch(spark, "errors"), scratch(spark, "outputs")
    R.write_artifact(rows, "error", good, errors)
    R.write_outputs(rows, out, rows, "c_name", lambda p, g: p.agg(F.count("*").alias("n")), out + "-report")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(spark.read.parquet(good), "good").unionAll(count(spark.read.parquet(errors), "errors")).unionAll(count(spark.read.json(out + "-report"), "report"))
