"""Page records: normalisation, content class, page numbers, mapping checks and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.ranking import numbered
from quarry.functions.text import normalize_page_text

#: Fixed value: an error's message is kept up to this many characters.
ERROR_CHARS = 1000
COUNTERS = ("text_block_count", "image_block_count", "embedded_image_count")
BROADCAST_REPORTS = 100_000
CONTENT_TYPES = ("text", "mixed", "scanned", "empty")


def content_class(text: Column, image_ratio: Column, threshold: float = 0.5) -> Column:
    has_text, imaged = F.length(text) > 0, image_ratio >= threshold
    return F.when(has_text & imaged, "mixed").when(has_text, "text").when(image_ratio > 0, "scanned").otherwise("empty")


def image_ratio(boxes: Column, area: Column) -> Column:
    """The largest image's share of the page, within 0 and 1. boxes: array of (w, h)."""
    share = F.transform(boxes, lambda b: F.least(F.greatest(b["w"] * b["h"] / area, F.lit(0.0)), F.lit(1.0)))
    return F.when(area > 0, F.coalesce(F.array_max(share), F.lit(0.0))).otherwise(F.lit(0.0))


def pages_of(documents: DataFrame) -> DataFrame:
    """Pages of reports from documents: report_id = source, pdf_page = place in the source by doc_id."""
    rows = numbered(documents.select("doc_id", F.col("source").alias("report_id"), F.col("text").alias("raw_text")), "report_id", "doc_id", "pdf_page")
    text = normalize_page_text(F.coalesce("raw_text", F.lit("")))
    return rows.select("doc_id", "report_id", "pdf_page", text.alias("text")).withColumn("content_type", content_class(F.col("text"), F.lit(0.0)))


def resolve(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """Printed page of each page by the segment that holds it: identity, offset, or custom (by position). segments are closed
    ranges per report; of several that fit, the first by mapping_id counts.

    A report's segments are one row, which goes to the pages by broadcast up to BROADCAST_REPORTS of them (counted); a page
    picks its segment in place, so pages are not dealt out again."""
    fields = ("mapping_id", "rule_type", "pdf_page_start", "pdf_page_end", "printed_page_start", "offset")
    own = segments.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("segments"))
    small = own.limit(BROADCAST_REPORTS + 1).count() <= BROADCAST_REPORTS
    rows = pages.select("report_id", "pdf_page").join(F.broadcast(own) if small else own, "report_id", "left")
    page, m = F.col("pdf_page"), F.col("m")
    fits = F.filter("segments", lambda s: page.between(s["pdf_page_start"], s["pdf_page_end"]) & s["mapping_id"].isNotNull())
    rows = rows.select("report_id", "pdf_page", F.get(fits, F.lit(0)).alias("m"))
    printed = F.when(m["rule_type"] == "identity", page).when(m["rule_type"] == "offset", page + m["offset"]).when(m["rule_type"] == "custom", m["printed_page_start"] + page - m["pdf_page_start"])
    return rows.select("report_id", "pdf_page", "m.mapping_id", printed.alias("printed_page"), F.when(m.isNull(), "unmapped").otherwise("mapped").alias("mapping_status"))


def audit(resolved: DataFrame) -> DataFrame:
    """Per report: pages, mapped pages, printed pages that several pages share."""
    printed = resolved.groupBy("report_id", "printed_page").agg(F.count(F.lit(1)).alias("n"), F.count("mapping_id").alias("mapped"))
    twice = F.col("printed_page").isNotNull() & (F.col("n") > 1)
    return printed.groupBy("report_id").agg(F.sum("n").alias("pages"), F.sum("mapped").alias("mapped_pages"), F.count_if(twice).alias("shared_printed_pages"))


def unmapped_ranges(resolved: DataFrame) -> DataFrame:
    """The pages of each report that no segment holds, as closed ranges: report_id, first_page, last_page."""
    rows = resolved.filter("mapping_status = 'unmapped'").select("report_id", "pdf_page").distinct()
    island = F.col("pdf_page") - F.row_number().over(Window.partitionBy("report_id").orderBy("pdf_page"))
    return rows.withColumn("_i", island).groupBy("report_id", "_i").agg(F.min("pdf_page").alias("first_page"), F.max("pdf_page").alias("last_page")).drop("_i")


def segment_violations(segments: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Rows that break a rule: ends before its start, ends past the report, overlaps the segment before it."""
    w = Window.partitionBy("report_id").orderBy("pdf_page_start", "pdf_page_end", "mapping_id")
    before = F.max("pdf_page_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.withColumn("before", before).join(page_counts, "report_id", "left")
    rules = F.array(
        F.when(F.col("pdf_page_end") < F.col("pdf_page_start"), "empty_range"),
        F.when(F.col("pdf_page_end") > F.coalesce("pages", F.lit(0)), "past_last_page"),
        F.when(F.col("before") >= F.col("pdf_page_start"), "overlap"),
    )
    return rows.select("report_id", "mapping_id", F.explode(F.array_compact(rules)).alias("rule_id"))


def summary(pages: DataFrame) -> DataFrame:
    """Pages and characters per report and content type, every type present."""
    counts = [F.count_if(F.col("content_type") == t).alias(f"{t}_pages") for t in CONTENT_TYPES]
    return pages.groupBy("report_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.max("pdf_page").alias("last_page"), *counts)


def completeness_violations(pages: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Reports whose pages are not exactly 1 .. n; where pages name their parser (parser_name, parser_version), also those of
    several."""
    parser = [c for c in ("parser_name", "parser_version") if c in pages.columns]
    parsers = F.countDistinct(F.struct(*parser)) if parser else F.lit(1)
    seen = pages.groupBy("report_id").agg(parsers.alias("parsers"), F.count(F.lit(1)).alias("rows"), F.countDistinct("pdf_page").alias("distinct"), F.min("pdf_page").alias("first"), F.max("pdf_page").alias("last"))
    both = page_counts.join(seen, "report_id", "full")
    rules = F.array(
        F.when(F.col("rows").isNull(), "no_pages"), F.when(F.col("rows") > F.col("distinct"), "repeated_page"),
        F.when((F.col("first") != 1) | (F.col("last") != F.col("pages")) | (F.col("distinct") != F.col("pages")), "missing_page"), F.when(F.col("parsers") > 1, "several_parsers"),
    )
    return both.select("report_id", F.explode(F.array_compact(rules)).alias("rule_id"))


def selections(wanted: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted(report_id, pdf_pages), reports(report_id, pages) -> (selections sorted, each page once; those that are empty,
    of an unknown report or have a page out of range, with the rule)."""
    rows = wanted.withColumn("pdf_pages", F.array_sort(F.array_distinct("pdf_pages"))).join(reports.select("report_id", "pages"), "report_id", "left")
    out = F.exists("pdf_pages", lambda p: p.isNull() | (p < 1) | (p > F.col("pages")))
    rule = F.when(F.col("pages").isNull(), "unknown_report").when(F.coalesce(F.size("pdf_pages"), F.lit(0)) <= 0, "no_pages").when(out, "out_of_range")
    rows = rows.withColumn("rule_id", rule)
    return rows.filter("rule_id IS NULL").select("report_id", "pdf_pages"), rows.filter("rule_id IS NOT NULL").select("report_id", "rule_id")


def block_counts(blocks: Column) -> Column:
    """Text and image blocks of a page's array of struct(type): 0 is text, 1 an image; null or no blocks count nothing."""
    n = lambda kind: F.greatest(F.coalesce(F.size(F.filter(blocks, lambda b: b["type"] == kind)), F.lit(0)), F.lit(0))
    return F.struct(n(0).alias("text_blocks"), n(1).alias("image_blocks"))


def mapping_hash(segments: DataFrame) -> DataFrame:
    """SHA-256 of each report's mapping, the same in any row order. A report has a handful of segments."""
    fields = F.struct("pdf_page_start", "pdf_page_end", "mapping_id", "rule_type", "printed_page_start", "offset")
    return segments.groupBy("report_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(fields)), {"ignoreNullFields": "false"}), 256).alias("mapping_sha256"))


def extract(rows: DataFrame, payload: str, extractor: Callable[[object], dict], keep: list[str]) -> DataFrame:
    """One record for each row, whatever its extractor does: keep, parse_status, content_type, raw_text, normalized_text, their
    counts, COUNTERS, max_image_area_ratio, parse_error.

    extractor(payload) gives a dict of text, COUNTERS and max_image_area_ratio; what it leaves out is empty or zero. An
    error of the extractor, or a result that is no such dict, concerns its row alone: status parse_error, type unknown, no
    text, zero counters, and a message of its kind and text cut to ERROR_CHARS. No task fails by it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for value in f[payload]:
                try:
                    made = extractor(value)
                    row = ("" if made.get("text") is None else str(made["text"]), *(int(made.get(c) or 0) for c in COUNTERS), float(made.get("max_image_area_ratio") or 0.0), None)
                except Exception as e:  # whatever it is, the other rows go on
                    row = ("", *(0 for _ in COUNTERS), 0.0, f"{type(e).__name__}: {e}"[:ERROR_CHARS])
                found.append(row)
            extra = pd.DataFrame(found, columns=["raw_text", *COUNTERS, "max_image_area_ratio", "parse_error"], index=f.index)
            yield pd.concat([f[keep], extra], axis=1)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", raw_text string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", max_image_area_ratio double, parse_error string"
    made = rows.select(*{*keep, payload}).mapInPandas(run, schema)
    failed = F.col("parse_error").isNotNull()
    made = made.withColumn("normalized_text", normalize_page_text(F.col("raw_text"))).withColumn("parse_status", F.when(failed, "parse_error").otherwise("success"))
    imaged = F.greatest(F.col("max_image_area_ratio"), F.when((F.col("image_block_count") > 0) | (F.col("embedded_image_count") > 0), F.lit(1e-9)).otherwise(F.lit(0.0)))
    kind = F.when(failed, "unknown").otherwise(content_class(F.col("normalized_text"), imaged))
    counts = [F.length(c).cast("long").alias(n) for c, n in (("raw_text", "raw_char_count"), ("normalized_text", "normalized_char_count"))]
    return made.select(*keep, "parse_status", kind.alias("content_type"), "raw_text", "normalized_text", *counts, *COUNTERS, "max_image_area_ratio", "parse_error")


def source_violations(reports: DataFrame, manifests: DataFrame, pages: DataFrame) -> DataFrame:
    """Page datasets that may not be cut into chunks: reports(report_id, active_document_id, expected_pdf_page_count),
    manifests(report_id, document_id, total_pdf_pages, page_record_count, quality_gate_passed), pages(report_id, document_id,
    page_id, pdf_page, parse_status), dealt to manifests by report -> report_id, rule_id."""
    seen = pages.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("page_id").alias("ids"), F.countDistinct("pdf_page").alias("distinct"), F.min("pdf_page").alias("first"), F.max("pdf_page").alias("last"),
        F.count_if(F.col("parse_status") == "parse_error").alias("errors"), F.min("document_id").alias("low"), F.max("document_id").alias("high"),
    )
    both = manifests.join(reports.select("report_id", "active_document_id", "expected_pdf_page_count", F.lit(True).alias("known")), "report_id", "left").join(seen, "report_id", "left")
    rows, total = F.coalesce("rows", F.lit(0)), F.col("total_pdf_pages")
    rules = F.array(
        F.when(F.col("known").isNull(), "unknown_report"), F.when(F.col("active_document_id") != F.col("document_id"), "not_the_active_document"), F.when(F.col("expected_pdf_page_count") != total, "page_count"),
        F.when(~F.coalesce("quality_gate_passed", F.lit(False)), "quality_gate"), F.when(rows != F.col("page_record_count"), "record_count"),
        F.when((rows != total) | (F.col("distinct") != total) | (F.col("first") != 1) | (F.col("last") != total), "coverage"), F.when(F.col("ids") < rows, "repeated_page_id"),
        F.when((F.col("low") != F.col("document_id")) | (F.col("high") != F.col("document_id")), "page_of_other_document"), F.when(F.col("errors") > 0, "parse_error"),
    )
    return both.select("report_id", F.explode(F.array_compact(rules)).alias("rule_id"))
