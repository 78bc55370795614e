"""Prompt contexts, conversation histories, templates and reply parsing as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clamp, strip

NOTHING = "No relevant context found."


def contexts(results: DataFrame, queries: DataFrame, style: str = "numbered", max_length: int = 4000) -> DataFrame:
    """results: query_id, rank, content, source, score. query_id, context: ranked chunks as numbered, bullet, xml or plain text, cut with '...'."""
    lines = {
        "numbered": lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["content"], F.when(x["source"].isNotNull(), F.concat(F.lit("\n\n    Source: "), x["source"])).otherwise("")),
        "bullet": lambda x: F.concat(F.lit("• "), x["content"]),
        "xml": lambda x: F.concat(F.lit('<source id="'), x["rank"].cast("string"), F.lit('" score="'), F.format_string("%.3f", x["score"]), F.lit('">\n'), x["content"], F.lit("\n</source>")),
        "plain": lambda x: x["content"],
    }
    # Of a query's chunks only those that begin before the cut are gathered.
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    results = results.withColumn("__before", F.coalesce(F.sum(F.length("content")).over(w), F.lit(0))).filter(F.col("__before") <= max_length)
    g = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "source", "score"))).alias("c")).select("query_id", F.array_join(F.transform("c", lines[style]), "\n\n").alias("t"))
    text = F.when(F.length("t") > max_length, F.concat(F.substring("t", 1, max_length), F.lit("..."))).otherwise(F.col("t"))
    return queries.select("query_id").join(g, "query_id", "left").select("query_id", F.coalesce(text, F.lit(NOTHING)).alias("context"))


def histories(turns: DataFrame, max_turns: int = 5) -> DataFrame:
    """conv_id, history: the last 2 * max_turns messages as 'Role: text' lines."""
    last = turns.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).filter(F.col("nth") <= 2 * max_turns)
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), "text").alias("line")))), lambda s: s["line"]), "\n").alias("history"))


def conversation_state(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), (F.floor(F.count("*") / 2) + 1).alias("conversation_turn"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def variables(template: Column) -> Column:
    """Names in braces, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))))


def missing(template: Column, given: Column) -> Column:
    return F.array_except(variables(template), given)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """Known variables replaced, unknown ones left."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(v, F.lit("")))
    return template


def listed_queries(reply: Column, most: int = 3, longer_than: int = 10) -> Column:
    lines = F.transform(F.split(reply, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^([0-9]+\.|[-•])\s*", ""), "^[\"']+|[\"']+$", ""))
    return F.slice(F.filter(lines, lambda x: F.length(x) > longer_than), 1, most)


def plan_steps(reply: Column, default: str = "Answer the question") -> Column:
    steps = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.regexp_extract(F.trim(x), r"^\d+[.)]\s*(.+)$", 1)), lambda x: x != "")
    return F.when(F.size(steps) == 0, F.array(F.lit(default))).otherwise(steps)


def _first(reply: Column, pattern: str) -> Column:
    """The first group of the pattern's first match; null without one."""
    got = F.regexp_extract_all(reply, F.lit(pattern), F.lit(1))
    return F.try_element_at(got, F.lit(1))


def _score(reply: Column, default: float) -> Column:
    """A number after SCORE: in capitals, in [0, 1]; the default where there is none or it isn't one."""
    return F.coalesce(clamp(_first(reply, r"SCORE:\s*([\d.]+)").try_cast("double"), 0.0, 1.0), F.lit(default))


def grade_fields(reply: Column) -> dict[str, Column]:
    """grade, score in [0, 1], reasoning, needs_correction. Grade and yes or no are read in any case, the other labels in capitals; a reply without a grade is relevant, without a score 0.7, and what it doesn't say of correction follows from its grade."""
    grade = F.coalesce(F.lower(_first(reply, r"(?i)GRADE:\s*(highly_relevant|relevant|partially_relevant|irrelevant)")), F.lit("relevant"))
    said = F.lower(_first(reply, r"(?i)NEEDS_CORRECTION:\s*(yes|no)"))
    reasoning = strip(F.coalesce(_first(reply, r"(?s)REASONING:\s*(.+?)(?=NEEDS_CORRECTION:|\z)"), F.lit("")))
    return {"grade": grade, "score": _score(reply, 0.7), "reasoning": reasoning, "needs_correction": F.coalesce(said == "yes", grade.isin("irrelevant", "partially_relevant"))}


def critique_fields(reply: Column) -> dict[str, Column]:
    """relevance, support, utility, score, critique, needs_refinement of a self-critique: medium, partially supported, partially useful and 0.6 where a reply doesn't say; refinement follows from support and utility where it doesn't."""
    relevance = F.coalesce(F.lower(_first(reply, r"(?i)RELEVANCE:\s*(high|medium|low)")), F.lit("medium"))
    support = F.coalesce(F.lower(_first(reply, r"(?i)SUPPORT:\s*(supported|partially_supported|unsupported)")), F.lit("partially_supported"))
    utility = F.coalesce(F.lower(_first(reply, r"(?i)UTILITY:\s*(useful|partially_useful|not_useful)")), F.lit("partially_useful"))
    critique = strip(F.coalesce(_first(reply, r"(?s)CRITIQUE:\s*(.+?)(?:NEEDS_REFINEMENT:|\z)"), F.lit("")))
    said = F.lower(_first(reply, r"(?i)NEEDS_REFINEMENT:\s*(yes|no)"))
    return {"relevance": relevance, "support": support, "utility": utility, "score": _score(reply, 0.6), "critique": critique, "needs_refinement": F.coalesce(said == "yes", (support != "supported") | (utility == "not_useful"))}


def step_fields(reply: Column) -> dict[str, Column]:
    """thought, action, answer of a reasoning step, labels in any case, and the tool and input of the action: name[input] or name(input), else a search for the whole of it."""
    part = lambda label, ends: strip(F.coalesce(_first(reply, rf"(?is){label}:\s*(.+?)(?={ends}\z)"), F.lit("")))
    action = part("Action", "Observation:|Thought:|Answer:|")
    tool = F.regexp_extract(action, r"^(\w+)\s*[\[(](.+?)[\])]", 1)
    given = strip(F.regexp_extract(action, r"^(\w+)\s*[\[(](.+?)[\])]", 2))
    return {"thought": part("Thought", "Action:|Answer:|"), "action": action, "answer": part("Answer", ""), "tool": F.when(tool != "", F.lower(tool)).otherwise("search"), "tool_input": F.when(tool != "", given).otherwise(action)}


def acceptable(supported: Column, utility: Column, refinements: Column, most: int = 2) -> Column:
    return (supported & utility.isin("useful", "partially_useful")) | (refinements >= most)


def route(reply: Column) -> Column:
    return F.when(F.lower(reply).contains("global"), "global").otherwise("local")
