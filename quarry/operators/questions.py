"""Multi-step questions as tables of steps: topology, execution and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import let
from quarry.operators.facts import context_fields, dispatch


def steps_of(cases: DataFrame) -> DataFrame:
    """cases(case_id, steps array of struct(step_id, action, fact_id, depends)) -> one row per step with its place."""
    return cases.select("case_id", F.posexplode("steps").alias("pos", "s")).select("case_id", "pos", "s.*")


def topology_violations(steps: DataFrame) -> DataFrame:
    """Repeated step ids, dependencies that are not earlier steps of the case, a last step that is not an answer."""
    w = Window.partitionBy("case_id").orderBy("pos")
    rows = steps.withColumn("earlier", F.collect_list("step_id").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.lead("pos").over(w))
    rules = F.array(
        F.when(F.array_contains("earlier", F.col("step_id")), "repeated_step"), F.when(F.size(F.array_except("depends", "earlier")) > 0, "depends_on_later_step"),
        F.when(F.col("next").isNull() & (F.col("action") != "answer"), "last_step_is_no_answer"),
    )
    return rows.select("case_id", "step_id", F.explode(F.array_compact(rules)).alias("rule_id"))


def sub_queries(cases: DataFrame) -> DataFrame:
    """cases(case_id, queries array of structs with query_id and target_fact_id) -> a row for each query of a case, without
    what gives its answer away."""
    hidden = ("target_fact_id", "gold_pdf_pages")
    rows = cases.select("case_id", F.posexplode("queries").alias("pos", "q"))
    return rows.select("case_id", "pos", *[F.col(f"q.{f}").alias(f) for f in rows.schema["q"].dataType.names if f not in hidden])


RESULT = "retrieval_result_"


def plans(cases: DataFrame) -> DataFrame:
    """cases(case_id, queries array<struct<query_id, target_fact_id, ...>>, steps array<struct<step_id, action,
    target_fact_ids, input_refs, depends_on, output_ref, calculation_id, formula_id>>) -> case_id, steps, in which every
    reference to a query's target fact is one to that query's result, and a retrieve step names its query.

    Of several queries for one fact the last counts; a retrieve step takes nothing and depends on nothing; other references
    stay as they are. A retrieve step without a query has a null query_id."""

    def asked(ref: Column) -> Column:
        return F.get(F.reverse(F.filter("queries", lambda q: q["target_fact_id"] == ref)), 0)["query_id"]

    def mapped(ref: Column) -> Column:
        return F.coalesce(F.concat(F.lit(RESULT), asked(ref)), ref)

    none = F.array().cast("array<string>")

    def rewritten(s: Column) -> Column:
        retrieves = s["action"] == "retrieve"
        query = F.when(retrieves, asked(F.get(s["target_fact_ids"], 0)))
        refs = lambda name, take: F.when(retrieves, none).otherwise(F.coalesce(take(s[name]), none)).alias(name)
        return F.struct(
            s["step_id"].alias("step_id"), s["action"].alias("action"), query.alias("query_id"), refs("input_refs", lambda x: F.transform(x, mapped)), refs("depends_on", lambda x: x),
            F.when(retrieves, F.coalesce(F.concat(F.lit(RESULT), query), s["output_ref"])).otherwise(mapped(s["output_ref"])).alias("output_ref"),
            s["calculation_id"].alias("calculation_id"), s["formula_id"].alias("formula_id"),
        )

    return cases.select("case_id", F.transform("steps", rewritten).alias("steps"))


def plan_steps(made: DataFrame) -> DataFrame:
    """plans() -> one row for each step with its place."""
    return made.select("case_id", F.posexplode("steps").alias("pos", "s")).select("case_id", "pos", "s.*")


def reference_violations(made: DataFrame) -> DataFrame:
    """plans() -> case_id, step_id, reference, rule_id: a retrieve step without a query, an input that no step of the case puts
    out (unknown_reference) or that a later step or the step itself does (later_reference), an output put out before."""
    rows = made.select("case_id", "steps", F.posexplode("steps").alias("pos", "s"))
    outputs = lambda keep: F.transform(F.filter("steps", keep), lambda x: x["output_ref"])
    earlier, every = F.transform(F.slice("steps", 1, F.col("pos")), lambda x: x["output_ref"]), outputs(lambda x: x["output_ref"].isNotNull())
    told = lambda ref, rule: F.struct(ref.cast("string").alias("reference"), F.lit(rule).alias("rule_id"))
    lost = F.when((F.col("s.action") == "retrieve") & F.col("s.query_id").isNull(), F.array(told(F.lit(None), "no_query")))
    bad = F.transform(F.filter("s.input_refs", lambda r: ~F.array_contains(earlier, r)), lambda r: F.when(F.array_contains(every, r), told(r, "later_reference")).otherwise(told(r, "unknown_reference")))
    twice = F.when(F.array_contains(earlier, F.col("s.output_ref")), F.array(told(F.col("s.output_ref"), "repeated_output")))
    none = F.array().cast("array<struct<reference:string,rule_id:string>>")
    return rows.select("case_id", "s.step_id", F.inline(F.concat(F.coalesce(lost, none), bad, F.coalesce(twice, none))))


def run_cases(made: DataFrame, traces: DataFrame, registry: DataFrame) -> DataFrame:
    """Every step of plans(), run in its order: case_id, pos, step_id, action, status, stage, message, ids, result_value.

    traces(query_id, status, error, fact_ids): a retrieve step takes the first fact. registry(fact_id, normalized_value,
    verified, and context fields as facts.calculate takes them). A calculate step is computed from the facts of its inputs;
    other steps pass on what their inputs hold: results of calculations and facts. A step fails with its stage and message:
    planning (a reference or a query that is not there), retrieval (the trace failed or found nothing), calculation (an
    input that is no fact, or a rule of facts.dispatch). The first failure fails the case: later steps are not_run.

    A case is one row while it runs: its traces and facts are brought to it by two joins, and its steps are folded in order
    with what they put out, so depth costs no further shuffle. The size of a row is that of the case."""
    fields = context_fields(registry)
    fact = registry.select(F.col("fact_id").alias("_id"), F.struct(F.col("fact_id").alias("id"), "normalized_value", "verified", *fields).alias("fact"))
    wanted = plan_steps(made).filter("action = 'retrieve' and query_id is not null").select("case_id", "query_id").distinct()
    got = wanted.join(traces.select("query_id", "status", "error", F.get("fact_ids", F.lit(0)).alias("_id")), "query_id").join(fact, "_id", "left")
    held = got.groupBy("case_id").agg(F.collect_list(F.struct("query_id", "status", "error", F.col("_id").alias("id"), "fact")).alias("held"))
    entry = held.schema["held"].dataType.simpleString()
    rows = made.join(held, "case_id", "left").withColumn("held", F.coalesce("held", F.array().cast(entry)))
    item = "array<struct<id:string,value:decimal(38,4)>>"
    line = "struct<step_id:string,action:string,status:string,stage:string,message:string,items:" + item + ",result_value:decimal(38,4)>"
    start = F.struct(F.lit(False).alias("failed"), F.array().cast(f"array<struct<ref:string,items:{item}>>").alias("refs"), F.array().cast(f"array<{line}>").alias("log"))
    none = F.array().cast(item)

    def step(state: Column, s: Column) -> Column:
        """Each part is computed once and bound to a name before the next one uses it."""
        trace = F.get(F.filter("held", lambda h: h["query_id"] == s["query_id"]), 0)
        inputs = F.transform(s["input_refs"], lambda r: F.get(F.filter(state["refs"], lambda x: x["ref"] == r), 0)["items"])
        found = F.struct(trace.alias("trace"), F.exists(inputs, lambda x: x.isNull()).alias("lost"), F.flatten(F.filter(inputs, lambda x: x.isNotNull())).alias("items"))
        known = lambda t: F.transform(t["items"], lambda i: F.get(F.filter("held", lambda h: h["id"] == i["id"]), 0)["fact"])
        return let(found, lambda t: let(known(t), lambda facts_in: let(dispatch(s["formula_id"], facts_in, fields), lambda made_it: let(outcome(s, t, facts_in, made_it), lambda o: logged(state, s, t, made_it, o)))))

    def outcome(s: Column, t: Column, facts_in: Column, made_it: Column) -> Column:
        retrieve, compute, trace = s["action"] == "retrieve", s["action"].isin("calculate", "normalize_unit"), t["trace"]
        planning = F.when(retrieve & s["query_id"].isNull(), "no_query").when(retrieve & trace["query_id"].isNull(), "no_trace").when(t["lost"], "unknown_reference")
        retrieval = F.when(retrieve & (trace["status"] == "failed"), F.coalesce(trace["error"], F.lit("failed"))).when(retrieve & trace["fact"].isNull(), "no_fact")
        calculation = F.when(compute & F.exists(facts_in, lambda f: f.isNull()), "input_is_no_fact").when(compute & (made_it["status"] != "done"), made_it["status"])
        stage = lambda name, message: F.struct(F.lit(name).alias("stage"), message.alias("message"))
        return F.get(F.filter(F.array(stage("planning", planning), stage("retrieval", retrieval), stage("calculation", calculation)), lambda x: x["message"].isNotNull()), 0)

    def logged(state: Column, s: Column, t: Column, made_it: Column, o: Column) -> Column:
        retrieve, compute, trace = s["action"] == "retrieve", s["action"].isin("calculate", "normalize_unit"), t["trace"]
        one = lambda i, v: F.array(F.struct(i.alias("id"), v.cast("decimal(38,4)").alias("value")))
        out = F.when(retrieve, one(trace["id"], trace["fact"]["normalized_value"])).when(compute, one(s["calculation_id"], made_it["result_value"])).otherwise(t["items"])
        off, ok = state["failed"], ~state["failed"] & o.isNull()

        def said(items: Column) -> Column:
            line = F.struct(
                s["step_id"].alias("step_id"), s["action"].alias("action"), F.when(off, "not_run").when(ok, "done").otherwise("failed").alias("status"), F.when(~off, o["stage"]).alias("stage"),
                F.when(~off, o["message"]).alias("message"), items.alias("items"), F.when(ok & compute, made_it["result_value"]).alias("result_value"),
            )
            refs = F.concat(state["refs"], F.when(ok, F.array(F.struct(s["output_ref"].alias("ref"), items.alias("items")))).otherwise(F.array().cast(f"array<struct<ref:string,items:{item}>>")))
            return F.struct((off | o.isNotNull()).alias("failed"), refs.alias("refs"), F.concat(state["log"], F.array(line)).alias("log"))

        return let(F.when(ok, out).otherwise(none), said)

    done = rows.select("case_id", F.posexplode(F.aggregate("steps", start, step)["log"]).alias("pos", "l"))
    return done.select("case_id", "pos", "l.step_id", "l.action", "l.status", "l.stage", "l.message", F.transform("l.items", lambda i: i["id"]).alias("ids"), "l.result_value")


def case_results(executed: DataFrame) -> DataFrame:
    """run_cases() -> one row per case: status, stage, step and message of the failure, steps by status, planned and executed
    queries, and what the last step holds (null if it was not reached)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    bad, asks = F.col("status") == "failed", F.col("action") == "retrieve"
    first = lambda c: F.max(F.when(bad, F.col(c)))
    out = executed.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("steps"), n("done"), n("failed"), n("not_run"), first("pos").alias("failed_at"), first("stage").alias("failure_stage"), first("message").alias("message"),
        F.count_if(asks).alias("planned_queries"), F.count_if(asks & (F.col("status") != "not_run")).alias("executed_queries"), F.count_if(asks & (F.col("status") == "done")).alias("resolved_queries"),
        F.count_if(F.col("result_value").isNotNull()).alias("calculated"), F.max_by(F.when(F.col("status") == "done", F.col("ids")), "pos").alias("answer_ids"),
    )
    return out.withColumn("case_status", F.when(F.col("failed") > 0, "failed").otherwise("completed"))


def run_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Completion over groups of cases."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("case_status") == "completed").alias("completed"), F.sum("done").alias("steps_done"), F.sum("failed").alias("failed_steps"), F.sum("not_run").alias("not_run"), F.sum("calculated").alias("calculated"))


def exact_matches(results: DataFrame, gold: DataFrame) -> DataFrame:
    """results and gold (case_id, answer, fact_ids): counts of equal answers and equal fact lists."""
    both = gold.select("case_id", F.col("answer").alias("a0"), F.array_sort("fact_ids").alias("f0")).join(results.select("case_id", "answer", F.array_sort("fact_ids").alias("fact_ids")), "case_id", "left")
    return both.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("a0") == F.col("answer")).alias("answers_equal"), F.count_if(F.col("f0") == F.col("fact_ids")).alias("facts_equal"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Status changes of cases between two runs (case_id, case_status)."""
    both = before.select("case_id", F.col("case_status").alias("was")).join(after.select("case_id", F.col("case_status").alias("now")), "case_id", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").when(F.col("now") == "completed", "recovered").otherwise("regressed")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("cases"))


def run_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs' case results side by side (case_status, planned_queries, resolved_queries): completion and resolution rates and
    how much they changed, in one row."""
    def rates(run: DataFrame, name: str) -> DataFrame:
        done, asked = F.count_if(F.col("case_status") == "completed"), F.sum("planned_queries")
        rate = lambda n, d: F.when(d > 0, F.round(n / d, 6))
        return run.agg(F.count(F.lit(1)).alias(f"cases_{name}"), rate(done, F.count(F.lit(1))).alias(f"completion_{name}"), rate(F.sum("resolved_queries"), asked).alias(f"resolution_{name}"))

    both = rates(before, "before").join(F.broadcast(rates(after, "after")))  # a row each
    change = lambda c: F.round(F.col(f"{c}_after") - F.col(f"{c}_before"), 6).alias(f"{c}_change")
    return both.select("*", change("completion"), change("resolution"))
