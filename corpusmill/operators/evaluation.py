"""Evaluation: parsing of judges' replies, cost, agreement, caps and guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clamp, fenced_json
from corpusmill.operators.stats import exact_quantiles

# Dollars per million input and output tokens, in the order in which names are tried.
PRICES = (
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4.1-mini", 0.40, 1.60),
    ("claude-3-5-haiku-20241022", 0.80, 4.00),
    ("claude-3-5-sonnet-20241022", 3.00, 15.00),
    ("claude-3-haiku-20240307", 0.25, 1.25),
    ("gpt-oss:20b", 0.07, 0.30),
    ("gpt-oss:120b", 0.15, 0.60),
)
DEFAULT_PRICE = (0.15, 0.60)


def metric_score(reply: Column) -> Column:
    """score in [0, 1]; 0 where the reply has none."""
    return F.coalesce(clamp(F.get_json_object(fenced_json(reply), "$.score").try_cast("double"), 0.0, 1.0), F.lit(0.0))


def rubric_scores(replies: DataFrame, rubrics: DataFrame, key: str, reply: str) -> DataFrame:
    """key, name, score for every rubric: those a reply leaves out get 0."""
    kind = "struct<scores: array<struct<name: string, score: double>>>"
    got = replies.select(key, F.explode(F.from_json(fenced_json(F.col(reply)), kind)["scores"]).alias("s")).select(key, F.col("s.name").alias("name"), clamp(F.col("s.score"), 0.0, 1.0).alias("score"))
    got = got.groupBy(key, "name").agg(F.max("score").alias("score"))
    asked = replies.select(key).crossJoin(F.broadcast(rubrics))
    return asked.join(got, [key, "name"], "left").select(key, "name", F.coalesce("score", F.lit(0.0)).alias("score"))


def truth(c: Column) -> Column:
    """true, yes, pass, 1 in any case, or a number of at least one half."""
    low = F.lower(F.trim(c))
    return F.coalesce(low.isin("true", "yes", "pass", "1"), F.lit(False)) | F.coalesce(low.try_cast("double") >= 0.5, F.lit(False))


def quality_verdict(reply: Column) -> dict[str, Column]:
    """quality 1 to 5 (1 where missing), groundedness 0 to 1, does_pass."""
    j = fenced_json(reply)
    return {"quality": F.coalesce(clamp(F.get_json_object(j, "$.quality").try_cast("double"), 1.0, 5.0), F.lit(1.0)), "groundedness": F.coalesce(clamp(F.get_json_object(j, "$.groundedness").try_cast("double"), 0.0, 1.0), F.lit(0.0)), "does_pass": truth(F.get_json_object(j, "$.does_pass"))}


def recorded_verdict(answers: Column) -> dict[str, Column]:
    """From nested recorded answers: quality level from 0 to a 1-5 scale, pass probability in [0, 1], whether it is one half at least, and grounding."""
    get = lambda path: F.get_json_object(answers, path).try_cast("double")
    return {"quality": level_to_quality(get("$.quality.score")), "does_pass": F.coalesce(get("$.does_pass.noul") >= 0.5, F.lit(False)), "pass_probability": F.coalesce(clamp(get("$.does_pass.noul"), 0.0, 1.0), F.lit(0.0)), "groundedness": F.coalesce(clamp(get("$.grounded.noul"), 0.0, 1.0), F.lit(0.0))}


def recorded_cost(payload: Column, rate_in: float = DEFAULT_PRICE[0], rate_out: float = DEFAULT_PRICE[1], per_call: float = 0.002) -> Column:
    """Dollars of a recorded call from its usage (input and output tokens); without usage what a call costs."""
    get = lambda path: F.get_json_object(payload, path).try_cast("double")
    tokens_in, tokens_out = get("$.usage.input_tokens"), get("$.usage.output_tokens")
    return F.when(tokens_in.isNull() & tokens_out.isNull(), F.lit(per_call)).otherwise((F.coalesce(tokens_in, F.lit(0.0)) * rate_in + F.coalesce(tokens_out, F.lit(0.0)) * rate_out) / 1e6)


def level_to_quality(level: Column) -> Column:
    return clamp(F.coalesce(level, F.lit(0.0)) + 1.0, 1.0, 5.0)


def quality_to_unit(quality: Column) -> Column:
    return clamp((quality - 1.0) / 4.0, 0.0, 1.0)


def cost(calls: DataFrame, prices: DataFrame, per_call: float = 0.002) -> DataFrame:
    """calls: model, tokens_in, tokens_out; prices: ordinal, name, rate_in, rate_out. The price of the first name that the model contains, else the default; calls without tokens cost ``per_call``. Prices are joined to the distinct models only."""
    models = calls.select("model").distinct()
    hits = models.join(F.broadcast(prices), F.col("model").contains(F.col("name"))).groupBy("model").agg(F.min_by(F.struct("rate_in", "rate_out"), "ordinal").alias("p"))
    rows = calls.join(hits, "model", "left")
    rate_in, rate_out = F.coalesce("p.rate_in", F.lit(DEFAULT_PRICE[0])), F.coalesce("p.rate_out", F.lit(DEFAULT_PRICE[1]))
    return rows.withColumn("cost_usd", F.when(F.col("tokens_in").isNull() | F.col("tokens_out").isNull(), F.lit(per_call)).otherwise((F.col("tokens_in") * rate_in + F.col("tokens_out") * rate_out) / 1e6)).drop("p")


def majority(votes: Column) -> Column:
    """At least half true; false for none. An aggregate expression."""
    return F.coalesce(F.count_if(votes) >= F.ceil(F.count_if(votes.isNotNull()) / 2), F.lit(False)) & (F.count_if(votes.isNotNull()) > 0)


def references(cases: DataFrame, verdicts: DataFrame, preferred: str) -> DataFrame:
    """case_id, reference: the human oracle, else the majority of the preferred judge, else of all judges."""
    own = verdicts.filter(F.col("judge") == preferred).groupBy("case_id").agg(majority(F.col("does_pass")).alias("own"))
    every = verdicts.groupBy("case_id").agg(majority(F.col("does_pass")).alias("every"))
    return cases.join(own, "case_id", "left").join(every, "case_id", "left").select("case_id", F.coalesce("oracle_pass", "own", "every", F.lit(False)).alias("reference"))


def judge_summary(verdicts: DataFrame, refs: DataFrame) -> DataFrame:
    """Per judge: agreement with the reference, mean within-case variance of quality, repeatability, their product, latency, cost, quality, pass rate and the most used model. Cases without calls count as 0."""
    judges = verdicts.select("judge").distinct()
    per_case = verdicts.groupBy("judge", "case_id").agg(F.coalesce(F.var_samp("quality"), F.lit(0.0)).alias("var"), F.avg(F.col("does_pass").cast("int")).alias("p"))
    grid = judges.crossJoin(refs.select("case_id")).join(per_case, ["judge", "case_id"], "left")
    a = grid.groupBy("judge").agg(F.avg(F.coalesce("var", F.lit(0.0))).alias("variance"), F.avg(F.coalesce(F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p")), F.lit(0.0))).alias("repeatability"))
    b = verdicts.join(refs, "case_id").groupBy("judge").agg(
        F.avg((F.col("does_pass") == F.col("reference")).cast("int")).alias("agreement"), F.avg("latency_ms").alias("latency"), F.sum("cost_usd").alias("cost"), F.avg("quality").alias("quality"), F.avg(F.col("does_pass").cast("int")).alias("pass_rate")
    )
    m = verdicts.groupBy("judge", "model").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).groupBy("judge").agg(F.max_by("model", F.struct("n", (-F.col("ord")).alias("o"))).alias("model"))
    q = exact_quantiles(verdicts.join(refs, "case_id", "left_semi"), "judge", "latency_ms", {"p50": 0.5, "p95": 0.95})
    return a.join(b, "judge").join(q, "judge").join(m, "judge").withColumn("signal", F.col("agreement") * F.col("repeatability"))


def within_budget(calls: DataFrame, cap: float, *order: str, block: int = 1 << 20) -> DataFrame:
    """Calls in order until the cost so far reaches the cap; the one that crosses it is kept. Costs are summed by block of ``ord`` first, so that no task sums the whole table."""
    rows = calls.withColumn("block", F.floor(F.col("ord") / block))
    sums = rows.groupBy("block").agg(F.sum("cost_usd").alias("s"))
    before = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    inside = F.coalesce(F.sum("cost_usd").over(Window.partitionBy("block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("inside", inside).join(before, "block").filter(F.round(F.col("base") + F.col("inside"), 9) < cap).drop("block", "inside", "base")


def budget_stop(calls: DataFrame, cap: float, *order: str, **options) -> DataFrame:
    """One row: calls made, what they cost, and whether the cap stopped others."""
    made = within_budget(calls, cap, *order, **options).agg(F.count("*").alias("made"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"))
    return made.crossJoin(calls.agg(F.count("*").alias("asked"))).select("made", "spent", (F.col("made") < F.col("asked")).alias("stopped"))


def head_to_head(summary: DataFrame, a: str, b: str) -> DataFrame:
    """Ratios of judge a to judge b; 0 where b has 0."""
    pick = lambda who, c: F.max(F.when(F.col("judge") == who, F.col(c)))
    return summary.agg(*[F.when(pick(b, c) == 0, F.lit(0.0)).otherwise(pick(a, c) / pick(b, c)).alias(f"{c}_ratio") for c in ("variance", "latency", "cost")])


def guardrails(checks: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """checks: id, check, flagged, confidence. passed, score per check; a failed check (null flag) passes with one half."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for p in thresholds.items() for x in p]), F.col("check"))
    bad = F.col("flagged").isNull()
    return checks.withColumns({"passed": bad | ~(F.col("flagged") & (F.col("confidence") >= limit)), "score": F.when(bad, 0.5).when(F.col("flagged"), 1 - F.col("confidence")).otherwise(1.0)})


#: Checks that can block, in order, of a question and of an answer. Personal data in a question only warn.
BLOCKING = {"input": ("injection",), "output": ("toxicity", "pii")}


def blocking_reason(graded: DataFrame) -> DataFrame:
    """graded: id, side (input or output), check, passed. id, side, allowed, reason (the first failed check of those that block), warnings (failed checks that don't)."""
    order = F.create_map(*[F.lit(x) for side, checks in BLOCKING.items() for i, c in enumerate(checks) for x in (f"{side}:{c}", i)])
    at = F.when(~F.col("passed"), F.try_element_at(order, F.concat_ws(":", "side", "check")))
    rows = graded.withColumn("at", at)
    warned = F.collect_set(F.when(~F.col("passed") & F.col("at").isNull(), F.col("check")))
    return rows.groupBy("id", "side").agg((F.count("at") == 0).alias("allowed"), F.min_by(F.when(F.col("at").isNotNull(), F.col("check")), "at").alias("reason"), F.array_join(F.array_sort(warned), ",").alias("warnings"))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "phone": r"\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"}


def pii_types(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in PII.items()]))
