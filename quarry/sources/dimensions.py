"""Dimension tables and calculations from JSON lines: typed, nested, with what can't be read as rows of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, IntegerType, StringType, StructType

SCHEMA_VERSION = 1
#: Columns of each dimension; those after the bar may be null. Decimals are strings in the files.
SCHEMAS = {
    "companies": "company_id string, legal_name_cn string, short_name_cn string, stock_code string, exchange string, industry string, status string | created_at timestamp, updated_at timestamp",
    "reports": "report_id string, company_id string, fiscal_year int, report_type string, title string, status string | expected_pdf_page_count int, active_document_id string, notes string, created_at timestamp, updated_at timestamp",
    "mappings": "mapping_id string, report_id string, rule_type string, pdf_page_start int, pdf_page_end int, validation_status string | printed_page_start int, printed_page_end int, offset int, notes string",
    "metrics": "metric_id string, display_name_cn string, period_type string, default_unit string, allowed_scopes array<string>, status string | formula_id string, confusable_metric_ids array<string>, is_core_metric boolean",
    "aliases": "alias_id string, metric_id string, alias string, match_type string, priority int | statement_type string, statement_scope string",
    "facts": "fact_id string, company_id string, report_id string, metric_id string, fiscal_year int, statement_type string, statement_scope string, period_type string, raw_value decimal(38,4), unit_multiplier decimal(38,4), normalized_value decimal(38,4), raw_unit string, normalized_unit string, is_comparative_value boolean, restatement_status string, primary_evidence_id string, validation_status string, created_at timestamp, updated_at timestamp | period_start date, period_end date, as_of_date date, currency string, validated_by string, validated_at timestamp",
    "links": "fact_id string, evidence_id string, support_type string | notes string",
    "evidences": "evidence_id string, report_id string, evidence_type string, attribution_type string, pdf_page int, evidence_text string, source_hash string, validation_status string | chunk_id string, page_id string, statement_type string, statement_scope string, cell_value string, created_at timestamp",
    "calculations": "calculation_id string, metric_id string, formula_id string, result_value decimal(38,4), result_unit string, input_fact_ids array<string>, validation_status string | validated_by string, created_at timestamp",
}


def _as_written(t: DataType) -> DataType:
    """The type a file holds a column in: decimals, dates and times are strings there, whole numbers are read wide."""
    if isinstance(t, ArrayType):
        return ArrayType(_as_written(t.elementType))
    if isinstance(t, DecimalType) or t.typeName() in ("date", "timestamp"):
        return StringType()
    return t



def fields(name: str) -> tuple[StructType, set[str]]:
    """(typed schema of a dimension, its columns that must not be null)."""
    needed, optional = SCHEMAS[name].split(" | ")
    return StructType.fromDDL(f"{needed}, {optional}"), set(StructType.fromDDL(needed).names)


def load(spark: SparkSession, path: str, name: str, version: int = SCHEMA_VERSION) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows) of the JSON lines at a path. Each line is a record with schema_version.

    A rejected row keeps its file and text, and the first rule it breaks: broken_json, schema_version, missing_<column>,
    bad_<column> (a text that is no decimal, date or time). The file is parsed once; both tables come from that."""
    typed, needed = fields(name)
    written = StructType().add("schema_version", IntegerType())
    for f in typed:
        written = written.add(f.name, _as_written(f.dataType))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter("trim(line) <> ''")
    rows = lines.withColumn("r", F.from_json("line", written.add("_broken", StringType()), {"columnNameOfCorruptRecord": "_broken"}))

    def value(f) -> Column:
        c = F.col("r")[f.name]
        return c if _as_written(f.dataType) == f.dataType else c.try_cast(f.dataType)

    rule = F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), "broken_json").when(~F.col("r.schema_version").eqNullSafe(F.lit(version)), "schema_version")
    for f in typed:
        if f.name in needed:
            rule = rule.when(F.col("r")[f.name].isNull(), f"missing_{f.name}")
        if _as_written(f.dataType) != f.dataType:
            rule = rule.when(F.col("r")[f.name].isNotNull() & value(f).isNull(), f"bad_{f.name}")
    judged = rows.withColumn("rule_id", rule)
    good = judged.filter("rule_id IS NULL").select(*[value(f).alias(f.name) for f in typed])
    return good, judged.filter("rule_id IS NOT NULL").select("file", "rule_id", "line")


def load_all(spark: SparkSession, paths: dict[str, str], version: int = SCHEMA_VERSION) -> tuple[dict[str, DataFrame], DataFrame]:
    """({name: typed rows}, one table of all rejected rows) of the dimensions at hand."""
    read = {name: load(spark, path, name, version) for name, path in paths.items()}
    rejected = None
    for name, (_, bad) in read.items():
        bad = bad.select(F.lit(name).alias("table"), "*")
        rejected = bad if rejected is None else rejected.unionByName(bad)
    return {name: good for name, (good, _) in read.items()}, rejected
