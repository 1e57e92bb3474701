"""Metadata filters and query plans: seven lists that rows must be in, and the checks of plans against reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lists of a filter and the field of a row that each holds values of; the narrower fields come first.
LISTS = {"page_ids": "page_id", "document_ids": "document_id", "pdf_pages": "pdf_page", "report_ids": "report_id", "company_ids": "company_id", "fiscal_years": "fiscal_year", "report_types": "report_type"}
#: Labels of statements and scopes in a query, its year and its last word.
STATEMENT_LABELS = {"balance_sheet": "资产负债表", "income_statement": "利润表", "cash_flow_statement": "现金流量表", "statement_of_changes_in_equity": "所有者权益变动表", "financial_summary": "主要财务数据", "note": "财务报表附注"}
SCOPE_LABELS = {"consolidated": "合并", "parent_company": "公司", "group": "集团"}
YEAR_WORD, LAST_WORD = "年度", "金额"
YEARS = (2000, 2100)


def where(rows: DataFrame, **lists: list) -> DataFrame:
    """Rows in every given list, for one filter known to the driver: the lists reach the scan. An empty list is no limit."""
    return reduce(lambda df, x: df.filter(F.col(LISTS[x[0]]).isin(list(x[1]))) if x[1] else df, lists.items(), rows)


def _held(filters: DataFrame) -> dict[str, str]:
    return {name: field for name, field in LISTS.items() if name in filters.columns}


def _size(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def normalize(filters: DataFrame) -> DataFrame:
    """Lists sorted and without repeats; a null list is an empty one."""
    return filters.withColumns({n: F.coalesce(F.array_sort(F.array_distinct(n)), F.array().cast(filters.schema[n].dataType)) for n in _held(filters)})


def violations(filters: DataFrame, key: str = "query_id", years: tuple[int, int] = YEARS) -> DataFrame:
    """Null or empty texts in a list, years out of range, pages below 1."""
    rules = []
    for name in _held(filters):
        if name == "fiscal_years":
            bad = lambda x: x.isNull() | (x < years[0]) | (x > years[1])
        elif name == "pdf_pages":
            bad = lambda x: x.isNull() | (x < 1)
        else:
            bad = lambda x: x.isNull() | (x == F.lit(""))
        rules.append(F.when(F.coalesce(F.exists(name, bad), F.lit(False)), f"bad_{name}"))
    return filters.select(key, F.explode(F.array_compact(F.array(*rules))).alias("rule_id"))


def eligible(filters: DataFrame, rows: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, row's columns) of the rows that satisfy each filter's lists, all at once.

    A filter meets rows by an equi-join on its narrowest list that is not empty; the other lists are conditions of that
    join. A filter without any list takes every row, as it says. A null field is in no list."""
    held = _held(filters)
    lead = reduce(lambda rest, n: F.when(_size(n) > 0, F.lit(n)).otherwise(rest), reversed(list(held)), F.lit(""))
    led = normalize(filters).select(key, *held).withColumn("_lead", lead)
    parts = []
    for name in [r["_lead"] for r in led.select("_lead").distinct().collect()]:  # at most eight names
        some = led.filter(F.col("_lead") == name).drop("_lead")
        others = [f for f in held if f != name]
        own = some.select(key, *[F.col(f).alias(f"_{f}") for f in others], *([F.explode(name).alias(f"_{name}")] if name else []))
        fits = reduce(lambda a, b: a & b, [(F.size(f"_{f}") == 0) | F.array_contains(f"_{f}", F.col(held[f])) for f in others], F.lit(True))
        if name:
            parts.append(rows.join(own, (F.col(held[name]) == F.col(f"_{name}")) & fits).select(key, *rows.columns))
        else:
            parts.append(own.select(key).crossJoin(rows))  # the filters ask for all rows each
    return reduce(DataFrame.unionByName, parts) if parts else rows.join(filters.select(key), F.lit(False)).select(key, *rows.columns)


def _labels(table: dict[str, str], c: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(c)]


def query_plans(intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """intents(query_id, metric_name, fiscal_year, company_id, report_id, report_type, statement_type, statement_scope) ->
    (plans with semantic_query and the four single-valued lists, intents that have no plan with the rule that they break)."""
    name = F.regexp_replace("metric_name", r"(?U)^\s+|\s+$", "")
    rows = intents.withColumns({"metric_name": name, "_t": _labels(STATEMENT_LABELS, "statement_type"), "_s": _labels(SCOPE_LABELS, "statement_scope")})
    rule = F.when(F.coalesce(F.col("metric_name"), F.lit("")) == "", "no_metric_name").when(F.col("_t").isNull(), "statement_type").when(F.col("_s").isNull(), "statement_scope")
    text = F.concat_ws(" ", F.concat("_s", "_t"), F.concat(F.col("fiscal_year").cast("string"), F.lit(YEAR_WORD)), "metric_name", F.lit(LAST_WORD))
    lists = [F.array(LISTS[n]).alias(n) for n in ("company_ids", "report_ids", "fiscal_years", "report_types")]
    rows = rows.withColumn("rule_id", rule)
    return rows.filter("rule_id is null").select(*[c for c in intents.columns], text.alias("semantic_query"), *lists), rows.filter("rule_id is not null").select("query_id", "rule_id")


def plan_violations(plans: DataFrame, reports: DataFrame) -> DataFrame:
    """plans(query_id, report_id, lists) whose lists leave out the report that they are for, or that is not there."""
    fields = {n: LISTS[n] for n in ("report_ids", "company_ids", "fiscal_years", "report_types") if n in plans.columns}
    own = reports.select(F.col("report_id").alias("_known"), *[F.col(f).alias(f"_{f}") for f in fields.values()])
    both = plans.join(own, F.col("report_id") == F.col("_known"), "left")
    rules = [F.when(F.col("_known").isNull(), "unknown_report")]
    rules += [F.when(F.col("_known").isNotNull() & (_size(n) > 0) & ~F.coalesce(F.array_contains(n, F.col(f"_{f}")), F.lit(False)), f"other_{f}") for n, f in fields.items()]
    return both.select("query_id", F.explode(F.array_compact(F.array(*rules))).alias("rule_id"))


def disagreements(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields in which rows of both tables with the same keys differ (two nulls agree), and keys that one table lacks:
    hits against chunks, expansions against queries, or two indexes' manifests."""
    a = left.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = right.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    rules = [F.when(F.col("_a").isNull(), "only_right"), F.when(F.col("_b").isNull(), "only_left")]
    rules += [F.when(F.col("_a") & F.col("_b") & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), f"other_{f}") for f in fields]
    return a.join(b, keys, "full").select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("rule_id"))


def outdated(hits: DataFrame, reports: DataFrame) -> DataFrame:
    """Hits from another document than the active one of their report; a report without an active one takes any."""
    active = reports.filter("active_document_id is not null").select("report_id", "active_document_id")
    return hits.join(active, "report_id").filter(~F.col("document_id").eqNullSafe(F.col("active_document_id"))).select(*hits.columns, "active_document_id")
