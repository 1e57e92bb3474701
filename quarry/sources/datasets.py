"""Dataset ids, checksums, manifests and idempotent writes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ranking import numbered
from quarry.sources.shared import is_written


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values in a fixed order; nulls are told apart from empty texts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def checksum(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """A checksum per group that does not depend on row order: counts and sums of parts of the row hashes, which are
    partial sums before the shuffle."""
    h = row_hash(columns)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), part(0), part(1), part(2)), 256).alias("checksum"))


def dataset_id(prefix: str, **config: str | int | float) -> Column:
    """A stable id of a configuration: the first 24 hex digits of the SHA-256 of its canonical JSON."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.lit(text), 256), 1, 24))


def report_snapshot(reports: DataFrame) -> DataFrame:
    """report_id and the SHA-256 of the report's metadata as chunks carry it: canonical JSON of five fields, nulls included."""
    fields = F.struct("company_id", F.col("fiscal_year").cast("int").alias("fiscal_year"), "report_id", "report_type", "title")
    return reports.select("report_id", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256).alias("snapshot_sha256"))


def manifest_violations(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Groups whose stored rows or checksum differ from what is there."""
    both = expected.select(key, F.col("rows").alias("r0"), F.col("checksum").alias("c0")).join(actual, key, "full")
    rules = F.array(F.when(F.col("rows").isNull(), "missing"), F.when(F.col("r0").isNull(), "unexpected"), F.when(F.col("r0") != F.col("rows"), "row_count"), F.when(F.col("c0") != F.col("checksum"), "checksum"))
    return both.select(key, F.explode(F.array_compact(rules)).alias("rule_id"))


def write_once(df: DataFrame, path: str) -> bool:
    """Write a dataset, or, where a finished one lies at the path, check that it holds the same rows. A half-written folder
    (no _SUCCESS) is replaced. Returns whether it wrote; other rows under the same path are an error."""
    spark = df.sparkSession
    if not is_written(spark, path):
        df.write.mode("overwrite").parquet(path)
        return True
    names = sorted(df.columns)
    stored = spark.read.parquet(path)
    if sorted(stored.columns) != names or checksum(stored, names, []).first() != checksum(df, names, []).first():
        raise ValueError(f"{path} holds another dataset")
    return False


def case_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON files as (file, line from 1, blank, broken, case): a broken record is a row, not an error."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"), "value")
    rows = numbered(lines, "file", "_at", "line").drop("_at")
    case = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = rows.select("file", F.col("line").cast("long").alias("line"), (F.trim("value") == "").alias("blank"), case.alias("case"))
    broken = ~F.col("blank") & (F.col("case").isNull() | F.col("case._broken").isNotNull())
    return rows.select("file", "line", "blank", broken.alias("broken"), F.when(~F.col("blank") & ~broken, F.col("case").dropFields("_broken")).alias("case"))


def case_violations(lines: DataFrame, key: str = "case_id") -> DataFrame:
    """Blank and broken lines, records without the key, and keys that an earlier line holds (first_line) -> file, line, rule_id, first_line."""
    value = F.col("case")[key]
    wrong = F.when(F.col("blank"), "blank_line").when(F.col("broken"), "broken_record").when(value.isNull(), "no_key")
    bad = lines.select("file", "line", wrong.alias("rule_id"), F.lit(None).cast("long").alias("first_line")).filter("rule_id IS NOT NULL")
    keyed = lines.filter(value.isNotNull()).select("file", "line", value.alias("k"))
    first = keyed.groupBy("file", "k").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = keyed.join(first, ["file", "k"]).filter("line > first_line").select("file", "line", F.lit("repeated_key").alias("rule_id"), "first_line")
    return bad.unionByName(again)


def write_by_report(cases: DataFrame, path: str, key: str = "report_id") -> None:
    """A case set split by report: one folder per report. Rows are dealt to the tasks by report and a part of their hash, so
    that a report of most rows is written by several tasks."""
    parts = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in cases.columns]), F.lit(8))
    cases.withColumn("_part", parts).repartition(key, "_part").drop("_part").write.partitionBy(key).mode("errorifexists").json(path)


#: What the checksum of a chunk dataset covers.
CHUNK_FIELDS = ("chunk_id", "report_id", "company_id", "document_id", "text")


def chunk_manifest_violations(chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """chunks(dataset_id, report_id, company_id, document_id, chunk_id, text), manifests(dataset_id, report_id, company_id,
    document_id, chunk_count, char_total[, checksum]) -> dataset_id, rule_id: counts and totals, repeated ids, chunks of another
    report, company or document, datasets without a manifest or without chunks; with a checksum, as checksum() makes it over
    CHUNK_FIELDS by dataset, contents that differ from it."""
    ids = ("report_id", "company_id", "document_id")
    sums = chunks.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    twice = chunks.groupBy("dataset_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("dataset_id", F.lit("repeated_chunk_id").alias("rule_id")).distinct()
    own = manifests.select("dataset_id", *[F.col(c).alias(f"_{c}") for c in ids], "chunk_count", "char_total", F.lit(True).alias("listed"))
    both = sums.join(own, "dataset_id", "full")
    rules = F.array(F.when(F.col("listed").isNull(), "no_manifest"), F.when(F.col("n").isNull(), "no_chunks"), F.when(F.col("n") != F.col("chunk_count"), "chunk_count"), F.when(F.col("chars") != F.col("char_total"), "char_total"))
    seen = chunks.select("dataset_id", *ids).distinct().join(own, "dataset_id")
    other = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"other_{c}") for c in ids])
    whole = both.select("dataset_id", F.explode(F.array_compact(rules)).alias("rule_id"))
    if "checksum" in manifests.columns:
        now = checksum(chunks, list(CHUNK_FIELDS), ["dataset_id"]).select("dataset_id", F.col("checksum").alias("now"))
        whole = whole.unionByName(manifests.select("dataset_id", "checksum").join(now, "dataset_id").filter("NOT checksum <=> now").select("dataset_id", F.lit("checksum").alias("rule_id")))
    return whole.unionByName(twice).unionByName(seen.select("dataset_id", F.explode(F.array_compact(other)).alias("rule_id")).distinct())


def read_strict(spark, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; a row that breaks it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def register_files(spark, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder with size and SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"))


def register_documents(files: DataFrame, reports: DataFrame, page_counts: DataFrame) -> DataFrame:
    """files(path, file_size_bytes, sha256) of register_files(), reports(report_id, source_path, expected_pdf_page_count),
    page_counts(path, pdf_page_count) -> one manifest row for each report: its document id (of report and hash), file name, page
    counts, page_count_status (matched, mismatched, or not_checked where a count is missing) and validation_status: valid if
    matched, else blocked. A report whose file is not there is blocked without an id; files of no report give no row."""
    own = files.join(page_counts, "path", "left").withColumnRenamed("path", "source_path")
    rows = reports.select("report_id", "source_path", "expected_pdf_page_count").join(own, "source_path", "left")
    both = F.col("pdf_page_count").isNotNull() & F.col("expected_pdf_page_count").isNotNull()
    status = F.when(~both, "not_checked").when(F.col("pdf_page_count") == F.col("expected_pdf_page_count"), "matched").otherwise("mismatched")
    return rows.select(
        F.concat(F.lit("doc_"), "report_id", F.lit("_"), F.substring("sha256", 1, 24)).alias("document_id"), "report_id", "source_path", F.substring_index("source_path", "/", -1).alias("source_filename"), "sha256", "file_size_bytes",
        "pdf_page_count", "expected_pdf_page_count", status.alias("page_count_status"), F.when(status == "matched", "valid").otherwise("blocked").alias("validation_status"),
    )


def find_manifests(spark: SparkSession, root: str, schema: str, name: str = "manifest.json") -> DataFrame:
    """The manifests under a folder, each a JSON file of its own: its folder, and its fields (null where it can't be read)."""
    found = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    return found.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), "*")


def export_pages(wanted: DataFrame, pages: DataFrame, path: str) -> int:
    """Write the text of wanted(report_id, pdf_page) as text files, a folder a report, pages in order under headings. Nothing is
    written where pages are missing: that is an error that names their number; missing_pages() lists them."""
    missing = missing_pages(wanted, pages).count()
    if missing:
        raise ValueError(f"{missing} pages are missing")
    rows = pages.join(wanted.select("report_id", "pdf_page").distinct(), ["report_id", "pdf_page"], "left_semi")
    text = F.concat(F.lit("===== "), "report_id", F.lit(" page "), F.col("pdf_page").cast("string"), F.lit(" =====\n"), F.coalesce("text", F.lit("")))
    shown = rows.select("report_id", "pdf_page", text.alias("value")).repartition("report_id").sortWithinPartitions("report_id", "pdf_page")
    shown.drop("pdf_page").write.mode("errorifexists").partitionBy("report_id").text(path)
    return rows.count()


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merge_cases(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(all cases in key order, keys that more than one row holds)."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.orderBy(key), repeated_keys(whole, [key])


def append_missing(dimension: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(dimension with the rows whose key it lacks, rows whose key it holds with other values)."""
    new = rows.join(dimension.select(key), key, "left_anti").select(*dimension.columns)
    clash = rows.select(*dimension.columns).exceptAll(dimension).join(dimension.select(key), key, "left_semi")
    return dimension.unionByName(new), clash


def append_all_or_none(dimension: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The dimension with new rows: none of their keys is there (they are added), or all are, with the same values (nothing
    changes). Some, or other values, are an error: a half-done merge must be seen, not completed."""
    total = rows.count()
    present = rows.join(dimension.select(key).distinct(), key, "left_semi").count()
    if present == 0:
        return dimension.unionByName(rows.select(*dimension.columns))
    if present < total:
        raise ValueError(f"{present} of {total} keys are there already")
    if not rows.select(*dimension.columns).exceptAll(dimension).isEmpty():
        raise ValueError("keys are there with other values")
    return dimension


def missing_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested (report_id, pdf_page) that are not there."""
    return wanted.join(pages.select("report_id", "pdf_page"), ["report_id", "pdf_page"], "left_anti")


def route_violations(reports: DataFrame, manifests: DataFrame) -> DataFrame:
    """Reports without an index manifest, or with several."""
    n = manifests.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    rows = reports.select("report_id").join(n, "report_id", "left")
    return rows.select("report_id", F.when(F.col("n").isNull(), "no_index").when(F.col("n") > 1, "several_indexes").alias("rule_id")).filter("rule_id is not null")
