"""Financial-fact queries over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import contracts, filters, integrity
from quarry.operators import facts as f
from quarry.operators import questions
from quarry.sources.shared import materialize
from quarry.sources.tables import table


def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: the order tables are read once however often a query uses its facts, and no filter on what is made of a
    fact's company and year is moved below the joins, where it would run for every order line."""
    return materialize(f.facts_of(*[table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "part")]))


def k_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_table(spark, sf_dir).select("fact_id", F.col("company_id").cast("long").alias("company_id"), F.col("fiscal_year").cast("long").alias("fiscal_year"), "metric_id", "normalized_value")


def k1_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by foreign key that point to nothing: of orders and their lines, and of labels and pages to each other."""
    orders, customer, lineitem, labels, pages = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "labels", "pages"))
    a = f.foreign_key_violations(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), customer, "c_custkey", "c_custkey", "o_orderkey")
    b = f.foreign_key_violations(lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), orders, "o_orderkey", "o_orderkey", "o_orderkey")
    c = f.foreign_key_violations(labels.select(F.col("doc_id").alias("page_id")), pages, "page_id", "page_id", "page_id")
    d = f.foreign_key_violations(pages.select(F.col("page_id").alias("label_id")), labels, "label_id", "doc_id", "label_id")
    return a.unionByName(b).unionByName(c).unionByName(d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("rows"))


def described(facts: DataFrame) -> DataFrame:
    """Facts with what the tables at hand say of their report, scope, statement, evidence and state: a fifth is not verified."""
    return facts.select(
        "fact_id", F.col("company_id").cast("long").alias("company_id"), F.col("fiscal_year").cast("long").alias("fiscal_year"), "metric_id", "normalized_value", "line",
        F.concat_ws("_", "company_id", "fiscal_year").alias("report_id"), F.when(F.col("company_id") % 2 == 0, "consolidated").otherwise("parent_company").alias("statement_scope"),
        F.when(F.col("metric_id") == "tax", "note").otherwise("income_statement").alias("statement_type"), F.concat(F.lit("ev_"), "fact_id").alias("primary_evidence_id"),
        F.when((F.col("company_id") + F.col("fiscal_year")) % 5 == 0, "pending").otherwise("verified").alias("validation_status"),
    )


def evidence_of(facts: DataFrame) -> DataFrame:
    """Evidence of described facts: the first order line; an even order is known by its chunk, others by page."""
    chunk = F.when(F.col("line.l_orderkey") % 2 == 0, F.concat_ws("_", F.lit("ck"), "line.l_orderkey", "metric_id"))
    return facts.select(F.col("primary_evidence_id").alias("evidence_id"), "report_id", chunk.alias("chunk_id"), F.col("line.l_linenumber").cast("long").alias("pdf_page"), F.when(F.col("line.l_linenumber") == 7, "pending").otherwise("verified").alias("validation_status"))


def k3_link_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of facts to evidence, of which every seventh report has none, taxes of 1996 point to the year before, revenues of
    1997 are linked twice and costs of 1998 to evidence that does not exist."""
    facts = described(fact_table(spark, sf_dir))
    other = F.when((F.col("metric_id") == "tax") & (F.col("fiscal_year") == 1996), F.format_string("ev_fact_%d_1995_tax", "company_id")).when((F.col("metric_id") == "operating_cost") & (F.col("fiscal_year") == 1998), F.lit("ev_none")).otherwise(F.col("primary_evidence_id"))
    twice = F.sequence(F.lit(1), F.when((F.col("metric_id") == "revenue") & (F.col("fiscal_year") == 1997), 2).otherwise(1))
    links = facts.filter((F.col("company_id") + F.col("fiscal_year")) % 7 != 0).select("fact_id", other.alias("evidence_id"), F.lit("primary").alias("support_type"), F.explode(twice)).drop("col")
    return f.link_violations(facts, links, evidence_of(facts))


def resolved_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, resolved facts): one query per fact; its context holds a chunk for each fact of the report, in metric order."""
    facts = described(fact_table(spark, sf_dir))
    queries = facts.select(F.concat(F.lit("q_"), "fact_id").alias("query_id"), *f.QUERY_KEYS)
    order = F.when(F.col("m") == "operating_cost", 1).when(F.col("m") == "revenue", 2).otherwise(3)
    held = facts.select("report_id", F.col("metric_id").alias("m"), "line").select("report_id", order.cast("long").alias("context_order"), F.concat_ws("_", F.lit("ck"), "line.l_orderkey", "m").alias("chunk_id"), (F.col("line.l_linenumber") + order - 1).cast("long").alias("pdf_page"))
    items = queries.select("query_id", "report_id").join(held, "report_id").withColumn("origin", F.when(F.col("context_order") == 1, "retrieved").otherwise("adjacent_page"))
    return queries, f.resolve(queries, facts, evidence_of(facts), items)


def k6_resolve_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_facts(spark, sf_dir)[1]


def k8_resolution_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f.resolution_views(*resolved_facts(spark, sf_dir))
    return out.select("query_id", F.array_join("base_facts", ",").alias("base_facts"), F.array_join("expanded_facts", ",").alias("expanded_facts"), "resolved")


def m10_formula_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine calculations for each company and year: every formula on the metrics at hand, one with an unknown formula, one
    with an input too few. Facts of described() that are not verified, and years without a predecessor, fail."""
    facts = described(fact_table(spark, sf_dir)).select("fact_id", "company_id", "fiscal_year", "normalized_value", (F.col("validation_status") == "verified").alias("verified"))
    year = facts.select("company_id", "fiscal_year").distinct()
    fact = lambda metric, back=0: F.format_string(f"fact_%d_%d_{metric}", "company_id", F.col("fiscal_year") - back)
    r, c, t, r0 = fact("revenue"), fact("operating_cost"), fact("tax"), fact("revenue", 1)
    asked = (("growth", r, r0), ("gross_profit_margin_formula", r, c), ("expense_ratio", r, c, t), ("cash_flow_to_net_profit", c, r), ("current_ratio_formula", r, c), ("debt_to_equity_ratio_formula", c, r), ("effective_tax_rate", t, c), ("no_such_formula", r, c), ("expense_ratio", r, c))
    rows = F.array(*[F.struct(F.lit(str(k)).alias("k"), F.lit(name).alias("formula_id"), F.array(*ids).alias("input_fact_ids")) for k, (name, *ids) in enumerate(asked)])
    calculations = year.select("company_id", "fiscal_year", F.inline(rows)).select(F.concat_ws("_", "company_id", "fiscal_year", "k").alias("calculation_id"), "formula_id", "input_fact_ids")
    return f.calculate(calculations, facts)


def k9_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts outside the years 1993 to 1996, which the dataset would promise, and other breaches."""
    return f.contract_violations(fact_table(spark, sf_dir), (1993, 1996)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("facts"))


def s5_dimension_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of contracts, keys and references in dimensions made of the facts, by table and rule. Planted: company 24 and
    the metric tax are not listed, reports of companies of rest 5 by 8 have another year, revenues of 1997 another
    multiplier, every third company no currency, evidence of lines 7 is lost, companies below 2 are listed twice."""
    facts = described(fact_table(spark, sf_dir))
    text, line, year = F.col("company_id").cast("string"), F.col("line.l_linenumber"), F.col("fiscal_year").cast("int")
    off = (F.col("metric_id") == "revenue") & (year == 1997)
    tables = {
        "companies": facts.select(text.alias("company_id")).distinct().filter("company_id <> '24'").select("company_id", F.explode(F.when(F.col("company_id").cast("int") < 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col"),
        "reports": facts.select("report_id", text.alias("company_id"), (year + F.when(F.col("company_id") % 8 == 5, 1).otherwise(0)).alias("fiscal_year")).distinct().withColumns({c: F.lit(None).cast("timestamp") for c in ("created_at", "updated_at")}),
        "metrics": facts.select("metric_id").distinct().filter("metric_id <> 'tax'").select("metric_id", F.lit("duration").alias("period_type"), F.lit("CNY").alias("default_unit"), F.array(F.lit("consolidated")).alias("allowed_scopes")),
        "facts": facts.select(
            "fact_id", text.alias("company_id"), "report_id", "metric_id", year.alias("fiscal_year"), "statement_type", "statement_scope", F.lit("duration").alias("period_type"), F.make_date(year, F.lit(1), F.lit(1)).alias("period_start"),
            F.make_date(year, F.lit(12), F.lit(31)).alias("period_end"), F.lit(None).cast("date").alias("as_of_date"), F.col("normalized_value").cast("decimal(30,4)").alias("raw_value"), F.when(off, F.lit(1000)).otherwise(F.lit(1)).alias("unit_multiplier"),
            "normalized_value", F.lit("CNY").alias("raw_unit"), F.lit("CNY").alias("normalized_unit"), F.when(F.col("company_id") % 3 != 0, "CNY").alias("currency"), F.lit(False).alias("is_comparative_value"), F.lit("not_applicable").alias("restatement_status"),
            "primary_evidence_id", "validation_status", F.when(line != 5, "reader").alias("validated_by"), *[F.lit("2024-01-01").cast("timestamp").alias(c) for c in ("validated_at", "created_at", "updated_at")],
        ),
        "evidences": facts.filter(line != 7).select(F.col("primary_evidence_id").alias("evidence_id"), "report_id"),
        "links": facts.select("fact_id", F.col("primary_evidence_id").alias("evidence_id")),
    }
    return integrity.dimension_violations(tables).groupBy("table", "rule_id").agg(F.count(F.lit(1)).alias("rows"))


def k5_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = described(fact_table(spark, sf_dir))
    return contracts.size_report({"fact": facts, "evidence": evidence_of(facts), "company": facts.select("company_id").distinct(), "report": facts.select("report_id").distinct()}, {"company": 6, "report": 12, "fact": 1, "evidence": 1_000_000_000})


def k11_evidence_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rules broken, by rule. Taxes come from notes and have no section; lines 6 lack a row label, lines 5 a reader."""
    facts = described(fact_table(spark, sf_dir))
    line = F.col("line.l_linenumber")
    rows = facts.select(
        F.col("primary_evidence_id").alias("evidence_id"), F.when(F.col("metric_id") == "tax", "financial_note").otherwise("financial_statement_cell").alias("evidence_type"),
        F.when(line == 4, "management_statement").otherwise("report_disclosure").alias("attribution_type"), "statement_type", F.when(line == 3, "unknown").otherwise(F.col("statement_scope")).alias("statement_scope"),
        F.lit("t").alias("table_name"), F.when(line != 6, F.col("metric_id")).alias("row_label"), F.lit("c").alias("column_label"), F.col("normalized_value").cast("string").alias("cell_value"),
        F.lit(None).cast("string").alias("section_title"), "validation_status", F.when(line != 5, F.lit("reader")).alias("validated_by"), line.alias("printed_page"),
    )
    return contracts.evidence_violations(rows).groupBy("rule_id").agg(F.count(F.lit(1)).alias("rows"))


def l7_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps answers from being used: each query's trace holds all facts of its report and their evidence, but that of
    order lines 7; every 11th company has no trace, every 13th an unfinished one."""
    facts = described(fact_table(spark, sf_dir))
    queries = facts.select(F.concat(F.lit("q_"), "fact_id").alias("query_id"), *f.QUERY_KEYS)
    own = facts.groupBy("report_id").agg(F.collect_list("fact_id").alias("fact_ids"), F.collect_list(F.when(F.col("line.l_linenumber") != 7, F.col("primary_evidence_id"))).alias("evidence_ids"))
    status = F.when(F.col("company_id") % 13 == 0, "failed").otherwise("completed")
    traces = queries.filter("company_id % 11 <> 0").select("query_id", "report_id", status.alias("status")).join(own, "report_id").drop("report_id")
    return contracts.provenance_violations(queries, traces, facts)


def f9_query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query text per fact, or the rule that leaves it without one: every seventh company's scope is not known."""
    facts = described(fact_table(spark, sf_dir))
    scope = F.when(F.col("company_id") % 7 == 0, "unknown").otherwise(F.col("statement_scope"))
    intents = facts.select(F.concat(F.lit("q_"), "fact_id").alias("query_id"), F.concat(F.lit(" "), "metric_id").alias("metric_name"), "fiscal_year", "company_id", "report_id", F.lit("annual").alias("report_type"), "statement_type", scope.alias("statement_scope"))
    plans, bad = filters.query_plans(intents)
    own = plans.select("query_id", "semantic_query", F.lit(None).cast("string").alias("rule_id"))
    return own.unionByName(bad.select("query_id", F.lit(None).cast("string").alias("semantic_query"), "rule_id"))


def k13_unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(f.UNITS)
    unit = F.element_at(F.array(*[F.lit(u) for u in sorted(f.UNITS)]), (F.pmod("o_orderkey", F.lit(n)) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(20,2)").alias("raw"), unit.alias("unit"))
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("rows"), F.sum(f.normalize_unit(F.col("raw"), F.col("unit"))).cast("decimal(38,4)").alias("total"))


def k16_disputed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.disputed(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_discount")


def m1_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(f.growth(fact_table(spark, sf_dir)))


def m3_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(f.ratios(fact_table(spark, sf_dir)))


def q1_profit_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(f.profit_cost_signal(fact_table(spark, sf_dir)))


def l5_fact_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(f.ranking(fact_table(spark, sf_dir), "revenue").withColumn("place", F.col("place").cast("long")))


def cases_of(facts: DataFrame) -> DataFrame:
    """For each company and year: retrieve this year's and last year's revenue and the cost; calculate growth and the ratio
    of revenue to cost; answer. Planted: answers of companies of rest 3 by 5 refer to a result that no step has; companies
    of rest 4 by 9 ask for the ratio before they retrieve the cost; every eleventh company has no query for its cost."""
    name = lambda metric, back=0: F.format_string(f"fact_%d_%d_{metric}", "company_id", F.col("fiscal_year") - back)
    strings = lambda *x: F.array(*[F.lit(c) if isinstance(c, str) else c for c in x]).cast("array<string>")
    none = F.lit(None).cast("string")
    r, r0, c, key = name("revenue"), name("revenue", 1), name("operating_cost"), F.concat_ws("_", "company_id", "fiscal_year")

    def step(i, action, target=None, inputs=(), depends=(), out=none, formula=None):
        made = (F.concat(F.lit(f"calc_{i}_"), key), F.lit(formula)) if formula else (none, none)
        return F.struct(F.lit(i).alias("step_id"), F.lit(action).alias("action"), strings(*([target] if target is not None else [])).alias("target_fact_ids"), strings(*inputs).alias("input_refs"), strings(*depends).alias("depends_on"),
                        (target if target is not None else F.lit(out) if isinstance(out, str) else out).alias("output_ref"), made[0].alias("calculation_id"), made[1].alias("formula_id"))

    query = lambda fact: F.struct(F.concat(F.lit("q_"), fact).alias("query_id"), fact.alias("target_fact_id"))
    s1, s2, s3 = step("s1", "retrieve", r), step("s2", "retrieve", r0), step("s3", "retrieve", c)
    s4 = step("s4", "calculate", None, (r, r0), ("s1", "s2"), "growth", "growth")
    s5 = step("s5", "calculate", None, (r, c), ("s1", "s3"), "ratio", "current_ratio_formula")
    s6 = lambda second: step("s6", "answer", None, ("growth", second), ("s4", "s5"), "answer")
    last = F.when(F.col("company_id") % 5 == 3, s6("nothing")).otherwise(s6("ratio"))
    order = F.when(F.col("company_id") % 9 == 4, F.array(s1, s2, s4, s5, s3, last)).otherwise(F.array(s1, s2, s3, s4, s5, last))
    queries = F.when(F.col("company_id") % 11 == 10, F.array(query(r), query(r0))).otherwise(F.array(query(r), query(r0), query(c)))
    return facts.filter("metric_id = 'revenue'").select(F.concat(F.lit("case_"), key).alias("case_id"), queries.alias("queries"), order.alias("steps"))


def case_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of described(); costs of every sixth company are zero, a fifth of the facts is not verified."""
    facts = described(fact_table(spark, sf_dir))
    value = F.when((F.col("metric_id") == "operating_cost") & (F.col("company_id") % 6 == 0), F.lit(0).cast("decimal(20,2)")).otherwise(F.col("normalized_value"))
    return facts.withColumn("normalized_value", value).withColumn("verified", F.col("validation_status") == "verified")


def executed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases, run on a trace for each fact; searches for revenues of 1995 of every seventh company failed."""
    facts = case_facts(spark, sf_dir)
    lost = (F.col("company_id") % 7 == 0) & (F.col("fiscal_year") == 1995) & (F.col("metric_id") == "revenue")
    found = facts.select(F.concat(F.lit("q_"), "fact_id").alias("query_id"), F.when(lost, "failed").otherwise("completed").alias("status"), F.when(lost, "timeout").alias("error"), F.when(lost, F.array().cast("array<string>")).otherwise(F.array("fact_id")).alias("fact_ids"))
    asked = questions.sub_queries(cases_of(facts)).select("query_id").distinct()
    traces = asked.join(found, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("completed")))  # a search that finds nothing
    return questions.run_cases(questions.plans(cases_of(facts)), traces, facts.select("fact_id", "company_id", "fiscal_year", "statement_scope", "normalized_value", "verified"))


def l12_case_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts that cases break, by rule. Planted beside those of cases_of(): companies of rest 1 by 10 compare nothing, every
    fourth case is called hard, every twelfth report has another company, companies of rest 6 by 13 leave a calculation out
    of the gold, cases of 1994 are verified by nobody, answers of 1993 cite a fact that is not gold."""
    cases = cases_of(case_facts(spark, sf_dir))
    company, year = F.split_part("case_id", F.lit("_"), F.lit(2)), F.split_part("case_id", F.lit("_"), F.lit(3)).cast("int")
    number, key = company.cast("int"), F.substring("case_id", 6, 100)
    name = lambda metric, back=0: F.concat(F.lit("fact_"), company, F.lit("_"), (year - back).cast("string"), F.lit(f"_{metric}"))
    gold = F.array(name("revenue"), name("revenue", 1), name("operating_cost"))
    report = F.concat(F.when(number % 12 == 7, F.lit("x")).otherwise(company), F.lit("_"), year.cast("string"))
    made = F.array(F.concat(F.lit("calc_s4_"), key), *[F.concat(F.lit("calc_s5_"), key)])
    asked = F.transform("queries", lambda q: F.struct(q["query_id"], q["target_fact_id"], F.lit("q").alias("baseline_query"), company.alias("company_id"), report.alias("report_id"), year.alias("fiscal_year")))
    verified = year != 1996
    rows = cases.select(
        "case_id", F.lit("q").alias("question"), F.when(number % 10 == 1, "cross_company_comparison").otherwise("single_company_multi_metric").alias("question_type"), F.when(number % 4 == 0, "hard").otherwise("easy").alias("difficulty"), F.array(company).alias("company_ids"),
        F.array(report, F.concat(company, F.lit("_"), (year - 1).cast("string"))).alias("report_ids"), F.array(year, year - 1).alias("fiscal_years"), asked.alias("queries"), "steps", gold.alias("gold_fact_ids"), F.array().cast("array<string>").alias("gold_evidence_ids"),
        F.when(number % 13 == 6, F.slice(made, 1, 1)).otherwise(made).alias("gold_calculation_ids"),
        F.struct(F.when(year == 1993, F.array(name("tax"))).otherwise(gold).alias("supporting_fact_ids"), F.array().cast("array<string>").alias("evidence_ids"), F.array().cast("array<string>").alias("supporting_calculation_ids")).alias("answer"),
        F.when(verified, "verified").otherwise("pending").alias("validation_status"), F.when(verified & (year != 1994), "reader").alias("validated_by"), *[F.when(verified, F.lit("2024-01-01").cast("timestamp")).alias(c) for c in ("validated_at", "created_at", "updated_at")],
    )
    return integrity.broken_rows(rows, "cases", "case_id", integrity.CASE_RULES).groupBy("rule_id").agg(F.count(F.lit(1)).alias("cases"))


def l11_case_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches between cases, facts, evidence, links and orders, by rule: every reference of a kind leaves its table in one
    pass and meets its parent in one join. Planted beside those of cases_of(): evidence of order lines 7 is lost."""
    facts = case_facts(spark, sf_dir)
    cases = cases_of(facts)
    evidences = facts.filter(F.col("line.l_linenumber") != 7).select(F.col("primary_evidence_id").alias("evidence_id"), "report_id", F.col("line.l_orderkey").alias("order"))
    tables = {"cases": cases, "facts": facts, "evidences": evidences, "orders": table(spark, sf_dir, "orders"), "links": facts.select("fact_id", F.col("primary_evidence_id").alias("evidence_id"))}
    references = [
        integrity.Reference("target_fact", "cases", "transform(queries, q -> q.target_fact_id)", "facts", "fact_id", many=True),
        integrity.Reference("step_fact", "cases", "flatten(transform(steps, s -> s.target_fact_ids))", "facts", "fact_id", many=True),
        integrity.Reference("company", "cases", "queries[0].target_fact_id", "facts", "fact_id", {"company_id": "split_part(case_id, '_', 2)"}),
        integrity.Reference("primary_evidence", "facts", "primary_evidence_id", "evidences", "evidence_id", {"report_id": "report_id"}),
        integrity.Reference("link_evidence", "links", "evidence_id", "evidences", "evidence_id"), integrity.Reference("link_fact", "links", "fact_id", "facts", "fact_id"),
        integrity.Reference("order", "evidences", "order", "orders", "o_orderkey"),
    ]
    rows = {"cases": {"query_without_step": "size(array_except(transform(queries, q -> q.target_fact_id), flatten(transform(steps, s -> s.target_fact_ids)))) > 0",
                      "step_without_query": "size(array_except(flatten(transform(steps, s -> s.target_fact_ids)), transform(queries, q -> q.target_fact_id))) > 0",
                      "depends_on_nothing": "size(array_except(flatten(transform(steps, s -> s.input_refs)), transform(steps, s -> s.output_ref))) > 0"}}
    found = integrity.check(tables, {"cases": "case_id", "facts": "fact_id", "evidences": "evidence_id", "links": "concat_ws('/', fact_id, evidence_id)"}, rows, references, {"cases": "case_id"})
    return found.groupBy("table", "rule_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("entities"))


def l2_case_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every case with its references rewritten, and the rule that one of them breaks."""
    made = questions.plans(cases_of(case_facts(spark, sf_dir)))
    bad = questions.reference_violations(made).groupBy("case_id", "step_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rule_id", "reference"))), ",").alias("broken"))
    steps = questions.plan_steps(made).join(bad, ["case_id", "step_id"], "left")
    return steps.select("case_id", F.col("pos").cast("long").alias("pos"), "step_id", "action", "query_id", F.array_join("input_refs", ",").alias("input_refs"), "output_ref", "broken")


def l4_case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = questions.case_results(executed_cases(spark, sf_dir))
    return out.withColumn("failed_at", F.col("failed_at").cast("long")).withColumn("answer_ids", F.array_join("answer_ids", ","))


def l4_case_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cases calculated."""
    return executed_cases(spark, sf_dir).filter("result_value IS NOT NULL").select("case_id", "step_id", "result_value")


def l8_topology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = questions.plan_steps(questions.plans(cases_of(case_facts(spark, sf_dir)))).withColumnRenamed("depends_on", "depends")
    bad = questions.topology_violations(steps).groupBy("case_id").agg(F.count(F.lit(1)).alias("violations"))
    return steps.groupBy("case_id").agg(F.count(F.lit(1)).alias("steps")).join(bad, "case_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0)).cast("long"))


def l10_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.run_summary(l4_case_results(spark, sf_dir).withColumn("fiscal_year", F.substring_index("case_id", "_", -1)), ["fiscal_year"])


def _longs(df: DataFrame) -> DataFrame:
    return df.withColumn("company_id", F.col("company_id").cast("long")).withColumn("fiscal_year", F.col("fiscal_year").cast("long"))


QUERIES = {q.__name__: q for q in (k_facts, k1_foreign_keys, k3_link_violations, k6_resolve_facts, k8_resolution_views, k9_contract_violations, s5_dimension_violations, k5_size_report, k11_evidence_contracts, l7_provenance, f9_query_plans, k13_unit_normalize, k16_disputed_values, m1_growth, m3_ratios, m10_formula_dispatch, q1_profit_signal, l12_case_contracts, l11_case_integrity, l2_case_plans, l4_case_results, l4_case_calculations, l5_fact_ranking, l8_topology_violations, l10_run_summary)}

FACTS = """
yr AS (SELECT s_nationkey::BIGINT AS company_id, year(o_orderdate) AS fiscal_year,
  sum(round(l_extendedprice::DECIMAL(12,2) * (1::DECIMAL(4,2) - l_discount::DECIMAL(4,2)), 2)::DECIMAL(20,2))::DECIMAL(20,2) AS revenue,
  sum(round(l_quantity::DECIMAL(12,2) * p_retailprice::DECIMAL(12,2) * 0.5::DECIMAL(2,1), 2)::DECIMAL(20,2))::DECIMAL(20,2) AS operating_cost,
  sum(round(l_extendedprice::DECIMAL(12,2) * (1::DECIMAL(4,2) - l_discount::DECIMAL(4,2)) * l_tax::DECIMAL(4,2), 2)::DECIMAL(20,2))::DECIMAL(20,2) AS tax, min((l_orderkey, l_linenumber)) AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
fa AS (SELECT company_id, fiscal_year, line, metric_id, normalized_value, format('fact_{}_{}_{}', company_id, fiscal_year, metric_id) AS fact_id FROM (
  SELECT company_id, fiscal_year, line, 'revenue' AS metric_id, revenue AS normalized_value FROM yr UNION ALL SELECT company_id, fiscal_year, line, 'operating_cost', operating_cost FROM yr
  UNION ALL SELECT company_id, fiscal_year, line, 'tax', tax FROM yr))"""


def _ratio(n: str, d: str, ok: str, times: int = 1) -> str:
    n, d = f"(({n})::DECIMAL(24,2) * 100)::HUGEINT", f"(({d})::DECIMAL(24,2) * 100)::HUGEINT"
    steps = f"(2 * abs({n}) * {times * 10_000} + abs({d})) // (2 * abs({d}))"
    return f"CASE WHEN ({ok}) AND {d} <> 0 THEN ((CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END * ({steps}))::DECIMAL(30,0) * 0.0001::DECIMAL(4,4))::DECIMAL(38,4) END"


DESCRIBED = FACTS + """,
ds AS (SELECT *, company_id || '_' || fiscal_year AS report_id, 'ev_' || fact_id AS ev, (company_id + fiscal_year) % 5 <> 0 AS verified, line[1] AS okey, line[2]::BIGINT AS page FROM fa),
ev AS (SELECT ev AS evidence_id, report_id, CASE WHEN okey % 2 = 0 THEN 'ck_' || okey || '_' || metric_id END AS chunk_id, page AS pdf_page, page <> 7 AS ok FROM ds)"""
RESOLVED = DESCRIBED + """,
it AS (SELECT *, CASE metric_id WHEN 'operating_cost' THEN 1 WHEN 'revenue' THEN 2 ELSE 3 END AS o FROM ds),
rs AS (SELECT 'q_' || ds.fact_id AS query_id, ds.fact_id, ds.ev AS evidence_id, min(it.o)::BIGINT AS context_order, CASE WHEN min(it.o) = 1 THEN 'retrieved' ELSE 'adjacent_page' END AS origin
  FROM ds JOIN ev ON ev.evidence_id = ds.ev JOIN it ON it.report_id = ds.report_id
  WHERE ds.verified AND ev.ok AND CASE WHEN ev.chunk_id IS NOT NULL THEN ev.chunk_id = 'ck_' || it.okey || '_' || it.metric_id ELSE ev.pdf_page = it.page + it.o - 1 END GROUP BY ds.fact_id, ds.ev)"""
CASES = FACTS + f""",
cv AS (SELECT company_id, fiscal_year, revenue, CASE WHEN company_id % 6 = 0 THEN 0 ELSE operating_cost END::DECIMAL(20,2) AS cost, (company_id + fiscal_year) % 5 <> 0 AS verified FROM yr),
cs AS (SELECT 'case_' || a.company_id || '_' || a.fiscal_year AS case_id, a.*, b.revenue AS before, coalesce(b.verified, FALSE) AS verified_before, a.company_id % 9 = 4 AS early, a.company_id % 11 = 10 AS unasked, a.company_id % 5 = 3 AS dangling,
  a.company_id % 7 = 0 AND a.fiscal_year = 1995 AS lost, a.company_id % 7 = 0 AND a.fiscal_year = 1996 AS lost_before, a.company_id || '_' || a.fiscal_year AS key
  FROM cv a LEFT JOIN cv b ON a.company_id = b.company_id AND b.fiscal_year = a.fiscal_year - 1),
cr AS (SELECT *, {_ratio('revenue - before', 'before', 'before > 0', 100)} AS growth, {_ratio('revenue', 'cost', 'revenue >= 0 AND cost > 0')} AS ratio FROM cs),
cf AS (SELECT *, CASE WHEN lost THEN (0, 'retrieval', 'timeout') WHEN before IS NOT NULL AND lost_before THEN (1, 'retrieval', 'timeout') WHEN before IS NULL THEN (1, 'retrieval', 'no_fact')
  WHEN unasked AND NOT early THEN (2, 'planning', 'no_query') WHEN NOT verified OR NOT verified_before THEN (CASE WHEN early THEN 2 ELSE 3 END, 'calculation', 'input_not_verified')
  WHEN growth IS NULL THEN (CASE WHEN early THEN 2 ELSE 3 END, 'calculation', 'guard_failed') WHEN early THEN (3, 'planning', 'unknown_reference') WHEN ratio IS NULL THEN (4, 'calculation', 'guard_failed')
  WHEN dangling THEN (5, 'planning', 'unknown_reference') END AS f FROM cr),
cx AS (SELECT *, f[1]::BIGINT AS failed_at, f[2] AS failure_stage, f[3] AS message FROM cf),
stp AS (SELECT *, CASE WHEN early THEN [1, 2, 4, 5, 3, 6] ELSE [1, 2, 3, 4, 5, 6] END AS o FROM cx),
sn AS (SELECT *, o[p + 1] AS s, p FROM stp, (SELECT unnest(range(6)) AS p))"""
FORMULA_SQL = {
    0: ("growth", "y.revenue - p.revenue", "p.revenue", "p.revenue > 0", 100), 1: ("gross_profit_margin_formula", "y.revenue - y.operating_cost", "y.revenue", "y.revenue > 0 AND y.operating_cost >= 0", 100),
    2: ("expense_ratio", "y.operating_cost + y.tax", "y.revenue", "y.revenue > 0", 100), 3: ("cash_flow_to_net_profit", "y.operating_cost", "y.revenue", "TRUE", 1),
    4: ("current_ratio_formula", "y.revenue", "y.operating_cost", "y.operating_cost > 0", 1), 5: ("debt_to_equity_ratio_formula", "y.operating_cost", "y.revenue", "TRUE", 1), 6: ("effective_tax_rate", "y.tax", "y.operating_cost", "TRUE", 100),
}


def _dispatch_sql() -> str:
    known = " UNION ALL ".join(
        f"""SELECT y.company_id || '_' || y.fiscal_year || '_{k}' AS calculation_id, '{name}' AS formula_id, {"p.revenue IS NULL" if k == 0 else "FALSE"} AS lost,
  (y.company_id + y.fiscal_year) % 5 = 0 {"OR (y.company_id + y.fiscal_year - 1) % 5 = 0" if k == 0 else ""} AS unsure, FALSE AS other, {_ratio(n, d, ok, times)} AS v FROM yr y LEFT JOIN yr p ON p.company_id = y.company_id AND p.fiscal_year = y.fiscal_year - 1"""
        for k, (name, n, d, ok, times) in FORMULA_SQL.items()
    )
    return f"""WITH {FACTS}, c AS ({known}),
s AS (SELECT calculation_id, formula_id, CASE WHEN lost THEN 'input_missing' WHEN unsure THEN 'input_not_verified' WHEN other THEN 'other_context' WHEN v IS NULL THEN 'guard_failed' ELSE 'done' END AS status, v FROM c
  UNION ALL SELECT company_id || '_' || fiscal_year || '_7', 'no_such_formula', 'unknown_formula', NULL FROM yr UNION ALL SELECT company_id || '_' || fiscal_year || '_8', 'expense_ratio', 'input_count', NULL FROM yr)
SELECT calculation_id, formula_id, status, CASE WHEN status = 'done' THEN v END AS result_value FROM s"""


ORACLES = {
    "s5_dimension_violations": f"""WITH {DESCRIBED}, r AS (SELECT DISTINCT company_id, fiscal_year FROM ds),
v AS (SELECT 'companies' AS t, 'repeated_key' AS rule_id, TRUE AS ok FROM (SELECT DISTINCT company_id FROM ds WHERE company_id < 2) UNION ALL SELECT 'reports', unnest(['id_differs', 'company_unknown']), unnest([company_id % 8 = 5, company_id = 24]) FROM r
  UNION ALL SELECT 'links', 'evidence_unknown', page = 7 FROM ds UNION ALL SELECT 'facts', unnest(['company_unknown', 'metric_unknown', 'scope_not_allowed', 'multiplier_differs', 'value_differs', 'currency_missing', 'verified_by_nobody', 'primary_evidence_unknown']),
    unnest([company_id = 24, metric_id = 'tax', metric_id <> 'tax' AND company_id % 2 = 1, metric_id = 'revenue' AND fiscal_year = 1997, metric_id = 'revenue' AND fiscal_year = 1997 AND normalized_value <> 0, company_id % 3 = 0, verified AND page = 5, page = 7]) FROM ds)
SELECT t AS "table", rule_id, count(*) AS rows FROM v WHERE ok GROUP BY ALL""",
    "k5_size_report": f"""WITH {DESCRIBED}, n AS (SELECT 'fact' AS object, count(*) AS rows, count(*) FILTER (verified) AS verified, 1::BIGINT AS least FROM ds UNION ALL SELECT 'evidence', count(*), count(*) FILTER (ok), 1000000000 FROM ev
  UNION ALL SELECT 'company', count(DISTINCT company_id), NULL, 6 FROM ds UNION ALL SELECT 'report', count(DISTINCT report_id), NULL, 12 FROM ds) SELECT *, rows >= least AS enough FROM n""",
    "k11_evidence_contracts": f"""WITH {DESCRIBED}, r AS (SELECT unnest([CASE WHEN page = 4 THEN 'attribution_without_statement' END, CASE WHEN page = 3 THEN 'unknown_scope' END, CASE WHEN metric_id <> 'tax' AND page = 6 THEN 'table_without_row_label' END,
  CASE WHEN metric_id = 'tax' THEN 'narrative_without_section' END, CASE WHEN verified AND page = 5 THEN 'verified_by_nobody' END]) AS rule_id FROM ds) SELECT rule_id, count(*) AS rows FROM r WHERE rule_id IS NOT NULL GROUP BY 1""",
    "l7_provenance": f"""WITH {DESCRIBED}, q AS (SELECT 'q_' || fact_id AS query_id, * FROM ds), t AS (SELECT q.query_id, q.metric_id AS asked, d.* FROM q JOIN ds d USING (report_id) WHERE q.company_id % 11 <> 0)
SELECT query_id, NULL AS fact_id, CASE WHEN company_id % 11 = 0 THEN 'no_trace' ELSE 'unfinished' END AS rule_id FROM q WHERE company_id % 11 = 0 OR company_id % 13 = 0
UNION ALL SELECT query_id, fact_id, 'not_verified' FROM t WHERE NOT verified UNION ALL SELECT query_id, fact_id, 'other_identity' FROM t WHERE metric_id <> asked UNION ALL SELECT query_id, fact_id, 'evidence_not_retrieved' FROM t WHERE page = 7""",
    "f9_query_plans": f"""WITH {DESCRIBED} SELECT 'q_' || fact_id AS query_id, CASE WHEN company_id % 7 <> 0 THEN CASE WHEN company_id % 2 = 0 THEN '合并' ELSE '公司' END || CASE WHEN metric_id = 'tax' THEN '财务报表附注' ELSE '利润表' END
  || ' ' || fiscal_year || '年度 ' || metric_id || ' 金额' END AS semantic_query, CASE WHEN company_id % 7 = 0 THEN 'statement_scope' END AS rule_id FROM ds""",
    "k3_link_violations": f"""WITH {DESCRIBED}, ln AS (SELECT ds.*, CASE WHEN metric_id = 'tax' AND fiscal_year = 1996 THEN 'ev_fact_' || company_id || '_1995_tax' WHEN metric_id = 'operating_cost' AND fiscal_year = 1998 THEN 'ev_none' ELSE ev END AS linked
  FROM ds WHERE (company_id + fiscal_year) % 7 <> 0)
SELECT fact_id, 'no_primary_evidence' AS rule_id FROM ds WHERE (company_id + fiscal_year) % 7 = 0
UNION ALL SELECT fact_id, 'unknown_evidence' FROM ln WHERE linked NOT IN (SELECT evidence_id FROM ev)
UNION ALL SELECT fact_id, 'repeated_link' FROM ln WHERE metric_id = 'revenue' AND fiscal_year = 1997
UNION ALL SELECT fact_id, 'other_report' FROM ln JOIN ev ON evidence_id = linked WHERE ev.report_id <> ln.report_id
UNION ALL SELECT fact_id, 'primary_differs' FROM ln WHERE linked <> ev""",
    "k6_resolve_facts": f"WITH {RESOLVED} SELECT * FROM rs",
    "k8_resolution_views": f"""WITH {RESOLVED} SELECT 'q_' || ds.fact_id AS query_id, CASE WHEN origin = 'retrieved' THEN ds.fact_id ELSE '' END AS base_facts,
  CASE WHEN origin = 'adjacent_page' THEN ds.fact_id ELSE '' END AS expanded_facts, origin IS NOT NULL AS resolved FROM ds LEFT JOIN rs ON rs.fact_id = ds.fact_id""",
    "m10_formula_dispatch": _dispatch_sql(),
    "k_facts": f"WITH {FACTS} SELECT fact_id, company_id, fiscal_year, metric_id, normalized_value FROM fa",
    "k1_foreign_keys": """WITH v AS (SELECT 'c_custkey_unknown' AS rule_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'o_orderkey_unknown' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'page_id_unknown' FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT 'label_id_unknown' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)) SELECT rule_id, count(*) AS rows FROM v GROUP BY rule_id""",
    "k9_contract_violations": f"WITH {FACTS} SELECT 'year_out_of_range' AS rule_id, count(*) AS facts FROM fa WHERE fiscal_year NOT BETWEEN 1993 AND 1996 HAVING count(*) > 0 UNION ALL SELECT 'revenue_negative', count(*) FROM fa WHERE metric_id = 'revenue' AND normalized_value < 0 HAVING count(*) > 0",
    "k13_unit_normalize": """WITH m AS (SELECT * FROM (VALUES ('CNY', 0, 1), ('CNY_hundred_million', 1, 100000000), ('CNY_million', 2, 1000000), ('CNY_ten_thousand', 3, 10000), ('CNY_thousand', 4, 1000)) v(unit, k, times))
SELECT unit, count(*) AS rows, sum(round(o_totalprice, 2)::DECIMAL(20,2)::DECIMAL(24,4) * times::DECIMAL(12,0))::DECIMAL(38,4) AS total FROM orders JOIN m ON o_orderkey % 5 = k GROUP BY unit""",
    "k16_disputed_values": "SELECT l_partkey, l_suppkey, count(DISTINCT l_discount) AS n_values FROM lineitem GROUP BY ALL HAVING n_values > 1",
    "m1_growth": f"WITH {FACTS} SELECT a.company_id, a.metric_id, a.fiscal_year, {_ratio('a.normalized_value - b.normalized_value', 'b.normalized_value', 'b.normalized_value > 0', 100)} AS growth FROM fa a JOIN fa b ON a.company_id = b.company_id AND a.metric_id = b.metric_id AND a.fiscal_year = b.fiscal_year + 1",
    "m3_ratios": f"WITH {FACTS} SELECT company_id, fiscal_year, {_ratio('revenue - operating_cost', 'revenue', 'revenue > 0 AND operating_cost >= 0', 100)} AS gross_margin, {_ratio('operating_cost', 'revenue', 'TRUE')} AS cost_ratio, {_ratio('tax', 'revenue - operating_cost', 'TRUE', 100)} AS tax_rate FROM yr",
    "q1_profit_signal": f"""WITH {FACTS}, b AS (SELECT a.company_id, a.fiscal_year, {_ratio('a.revenue - p.revenue', 'p.revenue', 'p.revenue > 0', 100)} AS up,
  {_ratio('(a.revenue - a.operating_cost) - (p.revenue - p.operating_cost)', 'p.revenue - p.operating_cost', 'p.revenue > p.operating_cost', 100)} AS down FROM yr a JOIN yr p ON a.company_id = p.company_id AND a.fiscal_year = p.fiscal_year + 1)
SELECT company_id, fiscal_year, up, down, (up - down)::DECIMAL(38,4) AS gap, CASE WHEN up - down >= 20 THEN 'high' WHEN up - down >= 5 THEN 'medium' ELSE 'low' END AS severity FROM b WHERE up > 0 AND down < 0""",
    "l12_case_contracts": f"""WITH {CASES}, v AS (SELECT unnest(['below_two_companies', 'not_hard', 'report_of_no_company', 'query_facts_differ', 'plan_calculations_differ', 'input_not_made', 'verified_by_nobody', 'answer_of_other_fact']) AS rule_id,
  unnest([company_id % 10 = 1, company_id % 4 = 0, company_id % 12 = 7, unasked, company_id % 13 = 6, early OR dangling, fiscal_year = 1994, fiscal_year = 1993]) AS ok FROM cs) SELECT rule_id, count(*) AS cases FROM v WHERE ok GROUP BY 1""",
    "l11_case_integrity": f"""WITH {CASES}, lost AS (SELECT fact_id FROM (SELECT *, line[2] AS page FROM fa) WHERE page = 7),
v AS (SELECT 'cases' AS t, r AS rule_id, case_id AS e FROM cs, (VALUES ('target_fact_unknown'), ('step_fact_unknown')) x(r) WHERE before IS NULL UNION ALL SELECT 'cases', 'step_without_query', case_id FROM cs WHERE unasked
  UNION ALL SELECT 'cases', 'depends_on_nothing', case_id FROM cs WHERE dangling UNION ALL SELECT 'facts', 'primary_evidence_unknown', fact_id FROM lost UNION ALL SELECT 'links', 'link_evidence_unknown', fact_id FROM lost)
SELECT t AS "table", rule_id, count(*) AS rows, count(DISTINCT e) AS entities FROM v GROUP BY ALL""",
    "l2_case_plans": f"""WITH {CASES}, q AS (SELECT *, 'fact_' || company_id || '_' || fiscal_year || '_revenue' AS r, 'fact_' || company_id || '_' || (fiscal_year - 1) || '_revenue' AS r0, 'fact_' || company_id || '_' || fiscal_year || '_operating_cost' AS c FROM sn),
m AS (SELECT *, 'retrieval_result_q_' || r AS mr, 'retrieval_result_q_' || r0 AS m0, CASE WHEN unasked THEN c ELSE 'retrieval_result_q_' || c END AS mc FROM q)
SELECT case_id, p AS pos, 's' || s AS step_id, CASE WHEN s <= 3 THEN 'retrieve' WHEN s <= 5 THEN 'calculate' ELSE 'answer' END AS action, CASE s WHEN 1 THEN 'q_' || r WHEN 2 THEN 'q_' || r0 WHEN 3 THEN CASE WHEN NOT unasked THEN 'q_' || c END END AS query_id,
  CASE s WHEN 4 THEN mr || ',' || m0 WHEN 5 THEN mr || ',' || mc WHEN 6 THEN CASE WHEN dangling THEN 'growth,nothing' ELSE 'growth,ratio' END ELSE '' END AS input_refs,
  CASE s WHEN 1 THEN mr WHEN 2 THEN m0 WHEN 3 THEN mc WHEN 4 THEN 'growth' WHEN 5 THEN 'ratio' ELSE 'answer' END AS output_ref,
  CASE WHEN s = 3 AND unasked THEN 'no_query' WHEN s = 5 AND early THEN 'later_reference:' || mc WHEN s = 6 AND dangling THEN 'unknown_reference:nothing' END AS broken FROM m""",
    "l4_case_results": f"""WITH {CASES} SELECT case_id, count(*) AS steps, count(*) FILTER (failed_at IS NULL OR p < failed_at) AS done, count(*) FILTER (p = failed_at) AS failed, count(*) FILTER (p > failed_at) AS not_run,
  any_value(failed_at) AS failed_at, any_value(failure_stage) AS failure_stage, any_value(message) AS message, count(*) FILTER (s <= 3) AS planned_queries, count(*) FILTER (s <= 3 AND (failed_at IS NULL OR p <= failed_at)) AS executed_queries,
  count(*) FILTER (s <= 3 AND (failed_at IS NULL OR p < failed_at)) AS resolved_queries, count(*) FILTER (s IN (4, 5) AND (failed_at IS NULL OR p < failed_at)) AS calculated,
  CASE WHEN any_value(failed_at) IS NULL THEN 'calc_s4_' || any_value(key) || ',calc_s5_' || any_value(key) END AS answer_ids,
  CASE WHEN any_value(failed_at) IS NULL THEN 'completed' ELSE 'failed' END AS case_status FROM sn GROUP BY case_id""",
    "l4_case_calculations": f"WITH {CASES} SELECT case_id, 's' || s AS step_id, CASE s WHEN 4 THEN growth ELSE ratio END AS result_value FROM sn WHERE s IN (4, 5) AND (failed_at IS NULL OR p < failed_at)",
    "l8_topology_violations": f"WITH {CASES} SELECT case_id, 6::BIGINT AS steps, early::BIGINT AS violations FROM cs",
    "l10_run_summary": f"""WITH {CASES} SELECT fiscal_year::VARCHAR AS fiscal_year, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) FILTER (failed_at IS NULL) AS completed, count(*) FILTER (failed_at IS NULL OR p < failed_at) AS steps_done,
  count(*) FILTER (p = failed_at) AS failed_steps, count(*) FILTER (p > failed_at) AS not_run, count(*) FILTER (s IN (4, 5) AND (failed_at IS NULL OR p < failed_at)) AS calculated FROM sn GROUP BY 1""",
    "l5_fact_ranking": f"WITH {FACTS} SELECT fiscal_year, row_number() OVER (PARTITION BY fiscal_year ORDER BY normalized_value DESC, company_id) AS place, company_id, normalized_value FROM fa WHERE metric_id = 'revenue'",
}
