"""The readiness gate over cited evidence, and answer packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import compact, near_value

#: Titles by which a statement type is known.
TITLES = {
    "balance_sheet": ("合并资产负债表", "公司资产负债表", "合并及公司资产负债表"),
    "income_statement": ("合并利润表", "公司利润表", "合并及公司利润表"),
    "cash_flow_statement": ("合并现金流量表", "公司现金流量表", "合并及公司现金流量表"),
    "statement_of_changes_in_equity": ("所有者权益变动表", "股东权益变动表"),
    "financial_summary": ("主要财务数据",),
    "note": ("财务报表附注",),
}


def titled(text: Column, statement: Column) -> Column:
    """Whether a text holds a title of the statement type, white space and case aside."""
    low, out = compact(text), F.lit(False)
    for kind, titles in TITLES.items():
        held = F.lit(False)
        for t in titles:
            held = held | F.contains(low, F.lit("".join(t.lower().split())))
        out = F.when(statement == kind, held).otherwise(out)
    return out


def assess(queries: DataFrame, items: DataFrame) -> DataFrame:
    """queries(query_id, metric_name, statement_type, fiscal_year), items(query_id, citation, text) -> status and the
    citations that hold both the statement's title and a value near the metric."""
    both = queries.join(items, "query_id", "left")
    supports = titled(F.col("text"), F.col("statement_type")) & near_value(F.col("text"), F.col("metric_name"), F.col("fiscal_year"))
    found = both.groupBy("query_id").agg(F.count("citation").alias("items"), F.array_sort(F.collect_list(F.when(supports, F.col("citation")))).alias("supporting"))
    return found.select("query_id", F.when(F.col("items") == 0, "no_hits").when(F.size("supporting") > 0, "ready").otherwise("insufficient").alias("status"), "supporting")


def answer_packets(readiness: DataFrame, items: DataFrame, refusal: str = "The evidence does not support an answer.") -> DataFrame:
    """Ready queries get their supporting items only; others a refusal."""
    held = readiness.select("query_id", F.explode("supporting").alias("citation")).join(items, ["query_id", "citation"])
    blocks = held.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("citation", "text"))).alias("items"))
    joined = readiness.join(blocks, "query_id", "left")
    ready = F.col("status") == "ready"
    return joined.select("query_id", F.when(ready, "answer").otherwise("refuse").alias("action"), F.when(ready, F.col("items")).alias("items"), F.when(~ready, F.lit(refusal)).alias("message"))


def final_results(packets: DataFrame, answers: DataFrame) -> DataFrame:
    """packets with their answers (query_id, answer): answered, refused, or missing."""
    both = packets.join(answers, "query_id", "left")
    status = F.when(F.col("action") == "refuse", "refused").when(F.col("answer").isNull(), "missing").otherwise("answered")
    return both.select("query_id", status.alias("status"), F.coalesce("answer", "message").alias("text"), F.when(status == "answered", F.transform("items", lambda i: i["citation"])).alias("citations"))
