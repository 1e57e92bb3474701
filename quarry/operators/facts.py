"""Financial facts: contracts, integrity, growth, ratios with exact decimals, and quality signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import let

METRICS = ("revenue", "operating_cost", "tax")
#: Codes of money units and their multipliers.
UNITS = {"CNY": 1, "CNY_thousand": 1_000, "CNY_ten_thousand": 10_000, "CNY_million": 1_000_000, "CNY_hundred_million": 100_000_000}


def facts_of(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, part: DataFrame) -> DataFrame:
    """Yearly facts per company (a supplier nation): revenue, operating cost and tax. One row for each."""
    rows = lineitem.join(orders.select("o_orderkey", F.year("o_orderdate").alias("fiscal_year")), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(supplier.select("s_suppkey", F.col("s_nationkey").alias("company_id")), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    cents = lambda c: F.round(c, 2).cast("decimal(20,2)")
    exact = lambda c, n=12: F.col(c).cast(f"decimal({n},2)")
    net = exact("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - exact("l_discount", 4))
    year = rows.groupBy("company_id", "fiscal_year").agg(
        F.sum(cents(net)).cast("decimal(20,2)").alias("revenue"),
        F.sum(cents(exact("l_quantity") * exact("p_retailprice") * F.lit("0.5").cast("decimal(2,1)"))).cast("decimal(20,2)").alias("operating_cost"),
        F.sum(cents(net * exact("l_tax", 4))).cast("decimal(20,2)").alias("tax"),
        F.min(F.struct("l_orderkey", "l_linenumber")).alias("line"),
    )
    stacked = F.expr("stack(3, 'revenue', revenue, 'operating_cost', operating_cost, 'tax', tax) AS (metric_id, normalized_value)")
    return year.select("company_id", "fiscal_year", "line", stacked).withColumn("fact_id", F.format_string("fact_%d_%d_%s", "company_id", "fiscal_year", "metric_id"))


def wide(facts: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per company and year with a column for each metric."""
    return facts.groupBy("company_id", "fiscal_year").pivot("metric_id", list(metrics)).agg(F.first("normalized_value"))


def ratio(n: Column, d: Column, ok: Column, times: int = 1) -> Column:
    """n / d (times 100 for percent) of decimals with up to four places, exactly rounded half up at four places; null where
    the guard fails or an input has more than 26 digits before the point."""
    big = lambda c: F.abs(c.try_cast("decimal(30,4)"))
    steps = F.call_function("div", big(n) * F.lit(2 * times * 10_000).cast("decimal(7,0)") + big(d), big(d) * F.lit(2).cast("decimal(1,0)"))
    signed = F.when((n < 0) != (d < 0), -steps).otherwise(steps)
    return F.when(ok & (d != 0), (signed.cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(38,4)"))


def growth_percent(current: Column, previous: Column) -> Column:
    return ratio(current - previous, previous, previous > 0, 100)


def growth(facts: DataFrame) -> DataFrame:
    """Growth on the year before, where there is one: company_id, metric_id, fiscal_year, growth."""
    before = facts.select("company_id", "metric_id", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("normalized_value").alias("previous"))
    return facts.join(before, ["company_id", "metric_id", "fiscal_year"]).select("company_id", "metric_id", "fiscal_year", growth_percent(F.col("normalized_value"), F.col("previous")).alias("growth"))


def ratios(facts: DataFrame) -> DataFrame:
    """Gross margin, cost to revenue and effective tax rate, each null where its guard fails."""
    r, c, t = F.col("revenue"), F.col("operating_cost"), F.col("tax")
    return wide(facts).select(
        "company_id", "fiscal_year", ratio(r - c, r, (r > 0) & (c >= 0), 100).alias("gross_margin"),
        ratio(c, r, F.lit(True)).alias("cost_ratio"), ratio(t, r - c, r != c, 100).alias("tax_rate"),
    )


#: Names of formulas. Number of inputs, and (numerator, denominator, guard, times) of their values in order.
FORMULAS = {
    "growth": (2, lambda a, b: (a - b, b, b > 0, 100)),
    "gross_profit_margin_formula": (2, lambda r, c: (r - c, r, (r > 0) & (c >= 0), 100)),
    "expense_ratio": (3, lambda r, s, d: (s + d, r, (r > 0) & (s >= 0) & (d >= 0), 100)),
    "cash_flow_to_net_profit": (2, lambda c, p: (c, p, p != 0, 1)),
    "current_ratio_formula": (2, lambda a, l: (a, l, (a >= 0) & (l > 0), 1)),
    "debt_to_equity_ratio_formula": (2, lambda l, e: (l, e, (l >= 0) & (e != 0), 1)),
    "effective_tax_rate": (2, lambda t, p: (t, p, p != 0, 100)),
}


#: What inputs of one calculation must agree in; growth compares two years, so these may differ there.
CONTEXT = ("company_id", "report_id", "fiscal_year", "statement_scope", "period_type", "period_start", "period_end", "as_of_date")
ACROSS_YEARS = ("report_id", "fiscal_year", "period_start", "period_end", "as_of_date")
#: Unit and currency that money must be in.
MONEY = {"normalized_unit": "CNY", "currency": "CNY"}


def dispatch(formula_id: Column, inputs: Column, fields: list[str]) -> Column:
    """struct(status, result_value) of a formula over inputs, an array of structs with normalized_value, verified and those
    of CONTEXT and MONEY that `fields` names; null inputs are missing. Also inside a lambda over rows of rows.

    The first rule that fails is the status: unknown_formula, input_count, input_missing, input_not_verified, other_context
    (growth: same company, scope and kind of period, and years that follow each other), other_currency, guard_failed."""
    result, wanted = F.lit(None).cast("decimal(38,4)"), F.lit(None).cast("int")
    for name, (count, formula) in FORMULAS.items():
        mine = formula_id == name
        result = F.when(mine, ratio(*formula(*[F.get(inputs, k)["normalized_value"] for k in range(count)]))).otherwise(result)
        wanted = F.when(mine, F.lit(count)).otherwise(wanted)
    first, no = F.get(inputs, 0), F.lit(False)

    def other_than(field: str, value: Column) -> Column:
        return F.exists(inputs, lambda x: ~x[field].eqNullSafe(value))

    def differ(names) -> Column:
        return reduce(lambda a, b: a | b, [other_than(f, first[f]) for f in names if f in fields], no)

    years = (first["fiscal_year"] - F.get(inputs, 1)["fiscal_year"] != 1) if "fiscal_year" in fields else no
    other = F.when(formula_id == "growth", differ([f for f in CONTEXT if f not in ACROSS_YEARS]) | F.coalesce(years, F.lit(True))).otherwise(differ(CONTEXT))
    foreign = reduce(lambda a, b: a | b, [other_than(f, F.lit(v)) for f, v in MONEY.items() if f in fields], no)
    rules = (
        F.when(wanted.isNull(), "unknown_formula").when(F.size(inputs) != wanted, "input_count").when(F.exists(inputs, lambda x: x["normalized_value"].isNull()), "input_missing")
        .when(~F.forall(inputs, lambda x: F.coalesce(x["verified"], no)), "input_not_verified").when(other, "other_context").when(foreign, "other_currency")
    )

    def told(x: Column) -> Column:
        status = F.coalesce(x["broken"], F.when(x["result"].isNull(), "guard_failed").otherwise("done"))
        return F.struct(status.alias("status"), F.when(status == "done", x["result"]).alias("result_value"))

    return let(F.struct(rules.alias("broken"), result.alias("result")), told)


def context_fields(facts: DataFrame) -> list[str]:
    return [c for c in (*CONTEXT, *MONEY) if c in facts.columns]


def calculate(calculations: DataFrame, facts: DataFrame) -> DataFrame:
    """calculations(calculation_id, formula_id, input_fact_ids), facts(fact_id, normalized_value, verified boolean, and what
    they have of CONTEXT and MONEY) -> calculation_id, formula_id, status, result_value, as dispatch() says."""
    fields = context_fields(facts)
    known = facts.select("fact_id", F.struct("normalized_value", "verified", *fields).alias("_fact"))
    asked = calculations.select("calculation_id", F.posexplode("input_fact_ids").alias("_pos", "fact_id")).join(known, "fact_id", "left")
    inputs = asked.groupBy("calculation_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "_fact"))).alias("_inputs"))  # a formula's inputs
    rows = calculations.join(inputs, "calculation_id", "left")
    given = F.coalesce(F.transform("_inputs", lambda x: x["_fact"]), F.array().cast(f"array<{known.schema['_fact'].dataType.simpleString()}>"))
    return rows.select("calculation_id", "formula_id", dispatch(F.col("formula_id"), given, fields).alias("_r")).select("calculation_id", "formula_id", "_r.status", "_r.result_value")


def profit_cost_signal(facts: DataFrame) -> DataFrame:
    """Years in which revenue rose while the margin (revenue less cost) fell: the gap of the two growths and its severity."""
    year = wide(facts).withColumn("profit", F.col("revenue") - F.col("operating_cost"))
    before = year.select("company_id", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("revenue").alias("r0"), F.col("profit").alias("p0"))
    both = year.join(before, ["company_id", "fiscal_year"]).select("company_id", "fiscal_year", growth_percent(F.col("revenue"), F.col("r0")).alias("up"), growth_percent(F.col("profit"), F.col("p0")).alias("down"))
    gap = F.col("up") - F.col("down")
    fired = both.filter((F.col("up") > 0) & (F.col("down") < 0)).withColumn("gap", gap.cast("decimal(38,4)"))
    return fired.withColumn("severity", F.when(F.col("gap") >= 20, "high").when(F.col("gap") >= 5, "medium").otherwise("low"))


def normalize_unit(raw: Column, unit: Column) -> Column:
    """raw x multiplier(unit); null for an unknown unit."""
    table = F.create_map(*[F.lit(x) for u, m in UNITS.items() for x in (u, m)])
    return (raw.cast("decimal(24,4)") * F.element_at(table, unit).cast("decimal(12,0)")).cast("decimal(38,4)")


def link_violations(facts: DataFrame, links: DataFrame, evidences: DataFrame) -> DataFrame:
    """facts(fact_id, report_id, primary_evidence_id), links(fact_id, evidence_id, support_type), evidences(evidence_id, report_id)
    -> fact_id, rule_id: no primary evidence, a link to no fact or no evidence, a repeated link, evidence of another
    report, a primary link that is not the fact's primary evidence."""
    bare = facts.join(links.filter("support_type = 'primary'"), "fact_id", "left_anti").select("fact_id", F.lit("no_primary_evidence").alias("rule_id"))
    dangling = links.join(facts, "fact_id", "left_anti").select("fact_id", F.lit("unknown_fact").alias("rule_id"))
    unknown = links.join(evidences, "evidence_id", "left_anti").select("fact_id", F.lit("unknown_evidence").alias("rule_id"))
    twice = links.groupBy("fact_id", "evidence_id", "support_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fact_id", F.lit("repeated_link").alias("rule_id"))
    both = links.distinct().join(facts.select("fact_id", "report_id", "primary_evidence_id"), "fact_id").join(evidences.select("evidence_id", F.col("report_id").alias("held_by")), "evidence_id", "left")
    rules = F.array(F.when(F.col("report_id") != F.col("held_by"), "other_report"), F.when((F.col("support_type") == "primary") & (F.col("evidence_id") != F.col("primary_evidence_id")), "primary_differs"))
    differs = both.select("fact_id", F.explode(F.array_compact(rules)).alias("rule_id"))
    return bare.unionByName(dangling).unionByName(unknown).unionByName(twice).unionByName(differs)


def foreign_key_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, entity: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(keys, child_key, "left_anti").select(F.col(entity).cast("string").alias("entity_id"), F.lit(f"{child_key}_unknown").alias("rule_id"))


def reference_violations(aliases: DataFrame, metrics: DataFrame, mappings: DataFrame, reports: DataFrame) -> DataFrame:
    """Aliases of metrics and page mappings of reports that do not exist."""
    a = foreign_key_violations(aliases, metrics, "metric_id", "metric_id", "alias_id")
    return a.unionByName(foreign_key_violations(mappings, reports, "report_id", "report_id", "mapping_id"))


def find(facts: DataFrame, **keys) -> DataFrame:
    """Facts by any of QUERY_KEYS; a key that is None is no condition. The conditions reach the scan."""
    unknown = set(keys) - set(QUERY_KEYS)
    if unknown:
        raise ValueError(f"no such keys: {sorted(unknown)}")
    for k, v in keys.items():
        facts = facts if v is None else facts.filter(F.col(k) == v)
    return facts


def disputed(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Business keys with more than one value."""
    return values.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).filter("n_values > 1")


def contract_violations(facts: DataFrame, years: tuple[int, int] = (1990, 2100), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row for each rule that a fact breaks: what the dataset promises of its fiscal years and metrics. The contract of a
    fact by itself is integrity.FACT_RULES."""
    rules = F.array(
        F.when(F.col("normalized_value").isNull(), "value_missing"), F.when(~F.col("metric_id").isin(*metrics), "metric_unknown"),
        F.when((F.col("metric_id") == "revenue") & (F.col("normalized_value") < 0), "revenue_negative"),
        F.when(~F.col("fiscal_year").between(*years), "year_out_of_range"),
        F.when(F.col("fact_id") != F.format_string("fact_%d_%d_%s", "company_id", "fiscal_year", "metric_id"), "id_differs"),
    )
    return facts.select("fact_id", F.explode(F.array_compact(rules)).alias("rule_id"))


QUERY_KEYS = ["company_id", "report_id", "metric_id", "fiscal_year", "statement_scope", "statement_type"]


def resolve(queries: DataFrame, facts: DataFrame, evidences: DataFrame, items: DataFrame) -> DataFrame:
    """The facts that a query's context supports, each by the first item that does.

    queries(query_id, QUERY_KEYS); facts(fact_id, QUERY_KEYS, primary_evidence_id, validation_status);
    evidences(evidence_id, report_id, chunk_id or null, pdf_page, validation_status); items(query_id, context_order, origin,
    chunk_id, report_id, pdf_page), from hits alone or widened. Only verified facts with verified evidence count; evidence that
    names its chunk is found by it alone, other evidence by report and page.
    -> query_id, fact_id, evidence_id, context_order, origin."""
    trusted = evidences.filter("validation_status = 'verified'").select("evidence_id", F.col("report_id").alias("held_by"), F.col("chunk_id").alias("held_chunk"), F.col("pdf_page").alias("held_page"))
    wanted = queries.join(facts.filter("validation_status = 'verified'").select("fact_id", *QUERY_KEYS, F.col("primary_evidence_id").alias("evidence_id")), QUERY_KEYS)
    wanted = wanted.select("query_id", "fact_id", "evidence_id").join(trusted, "evidence_id")
    own = items.select("query_id", "context_order", "origin", "chunk_id", "report_id", "pdf_page")
    by_chunk = wanted.filter("held_chunk IS NOT NULL").withColumnRenamed("held_chunk", "chunk_id").join(own, ["query_id", "chunk_id"])
    by_page = wanted.filter("held_chunk IS NULL").select("query_id", "fact_id", "evidence_id", F.col("held_by").alias("report_id"), F.col("held_page").alias("pdf_page")).join(own, ["query_id", "report_id", "pdf_page"])
    columns = ["query_id", "fact_id", "evidence_id", "context_order", "origin"]
    found = by_chunk.select(*columns).unionByName(by_page.select(*columns))
    return found.groupBy("query_id", "fact_id", "evidence_id").agg(F.min(F.struct("context_order", "origin")).alias("x")).select("query_id", "fact_id", "evidence_id", "x.context_order", "x.origin")


def resolution_views(queries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per query: facts found in the hits themselves, facts that only the widened context holds, and whether there is one."""
    kind = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.col("fact_id"))))
    views = resolved.groupBy("query_id").agg(kind(F.col("origin") == "retrieved").alias("base_facts"), kind(F.col("origin") != "retrieved").alias("expanded_facts"))
    none = F.array().cast("array<string>")
    out = queries.select("query_id").join(views, "query_id", "left").select("query_id", F.coalesce("base_facts", none).alias("base_facts"), F.coalesce("expanded_facts", none).alias("expanded_facts"))
    return out.withColumn("resolved", F.size("base_facts") + F.size("expanded_facts") > 0)


def ranking(facts: DataFrame, metric: str) -> DataFrame:
    """Companies by a metric within each year, largest first, ties by id."""
    w = Window.partitionBy("fiscal_year").orderBy(F.desc("normalized_value"), "company_id")
    return facts.filter(F.col("metric_id") == metric).select("fiscal_year", F.row_number().over(w).alias("place"), "company_id", "normalized_value")
