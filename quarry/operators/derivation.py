"""Facts, evidence and links derived from specifications: what is claimed must stand in the chunk it is claimed of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.facts import normalize_unit
from quarry.sources.shared import materialize

#: Identity of a chunk: rows of one id must agree in these.
IDENTITY = ("company_id", "report_id", "document_id", "pdf_page", "text")


def from_specs(specs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, evidences, links, violations) of specs(chunk_id, metric_id, fiscal_year, statement_type, statement_scope,
    row_label, column_label, cell_value, raw_value decimal, raw_unit) over chunks(chunk_id, IDENTITY).

    Specs meet the chunks that they name in one join, from which all four tables come. Chunk rows of one id that agree in
    IDENTITY are one chunk. Rules: unknown_chunk, conflicting_chunk, row_label_missing and cell_value_missing (not in the
    text; null or blank is missing), unknown_unit, repeated_fact (the identity of an earlier spec, by row label and value).
    A spec that breaks one gives nothing else. Ids are hashes of what they stand for, so the same spec has the same ids."""
    same = chunks.groupBy("chunk_id").agg(F.min(F.struct(*IDENTITY)).alias("low"), F.max(F.struct(*IDENTITY)).alias("high"))
    wanted = same.join(specs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = specs.join(wanted, "chunk_id", "left").withColumn("chunk", F.col("low"))
    lacks = lambda c: F.coalesce(F.trim(c), F.lit("")).eqNullSafe("") | ~F.coalesce(F.contains(F.col("chunk.text"), F.col(c)), F.lit(False))
    value = normalize_unit(F.col("raw_value"), F.col("raw_unit"))
    short = lambda *c: F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, 24)
    rows = rows.withColumns({
        "normalized_value": value, "fact_id": F.concat(F.lit("fact_"), short("chunk.company_id", "fiscal_year", "metric_id", "statement_type", "statement_scope")),
        "evidence_id": F.concat(F.lit("evidence_"), short("chunk_id", "metric_id", "row_label", "column_label", "cell_value")),
    })
    rule = (
        F.when(F.col("low").isNull(), "unknown_chunk").when(F.col("low") != F.col("high"), "conflicting_chunk").when(lacks("row_label"), "row_label_missing")
        .when(lacks("cell_value"), "cell_value_missing").when(value.isNull(), "unknown_unit")
    )
    judged = materialize(rows.withColumn("rule_id", rule).drop("low", "high"))
    good = judged.filter("rule_id IS NULL")
    order = F.struct("row_label", "cell_value", "chunk_id", "evidence_id")
    first = good.groupBy("fact_id").agg(F.min(order).alias("first"))
    marked = good.join(first, "fact_id").withColumn("own", order == F.col("first"))
    kept = marked.filter("own").dropDuplicates(["fact_id", "evidence_id"])
    again = marked.filter("NOT own").select("chunk_id", "metric_id", F.lit("repeated_fact").alias("rule_id"))
    facts = kept.select("fact_id", F.col("chunk.company_id"), F.col("chunk.report_id"), "metric_id", "fiscal_year", "statement_type", "statement_scope", "raw_value", "raw_unit", "normalized_value", "row_label", "column_label", F.col("evidence_id").alias("primary_evidence_id"))
    evidences = kept.select("evidence_id", F.col("chunk.report_id"), F.col("chunk.document_id"), F.col("chunk.pdf_page"), "chunk_id", "row_label", "column_label", "cell_value", F.col("chunk.text").alias("evidence_text"), F.sha2("chunk.text", 256).alias("source_hash"))
    links = kept.select("fact_id", "evidence_id", F.lit("primary").alias("support_type"))
    return facts, evidences, links, judged.filter("rule_id IS NOT NULL").select("chunk_id", "metric_id", "rule_id").unionByName(again)
