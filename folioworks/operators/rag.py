"""Evidence, prompts, citations and policies for question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import page_tag
from ..functions.text import token_count, truncate_tokens

# Sizes of evidence budgets, the marker of an answer without evidence, chat bounds.
CONTEXT_BUFFER, LEAST_BUDGET = 512, 256
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"
UNKNOWN_CITATION = "unknown_provider_citation_removed"
MAX_TURNS, MAX_TURN_CHARS = 20, 8000


def evidence_budget(context: Column, output: Column, external: Column, external_most: int) -> Column:
    own = context - output - CONTEXT_BUFFER
    return F.greatest(F.lit(LEAST_BUDGET), F.when(external, F.least(own, F.lit(external_most))).otherwise(own))


def select_evidence(hits: DataFrame, budget: int, per_content: int, most: int) -> DataFrame:
    """Evidence blocks of each question in rank order.

    ``hits(question_id, rank, content_id, text)`` becomes ``question_id, alias,
    rank, content_id, text, tokens``.  A block is taken while there are fewer
    than ``most``, fewer than ``per_content`` of its content, and it fits the
    token budget; the very first one is cut to the budget instead.  The fold is
    bounded by the hits of one question.
    """
    own = hits.withColumn("text", F.trim("text")).withColumn("n", token_count(F.col("text")))
    lists = own.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content_id", "n"))).alias("hits"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<rank:int,content_id:string,n:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        mine = F.size(F.filter(s["out"], lambda o: o["content_id"] == x["content_id"]))
        first = F.size(s["out"]) == 0
        take = (F.size(s["out"]) < most) & (mine < per_content) & (x["n"] > 0) & (first | (s["total"] + x["n"] <= budget))
        cost = F.least(x["n"], F.lit(budget).cast("long"))
        block = F.struct(x["rank"].cast("int").alias("rank"), x["content_id"].alias("content_id"), cost.alias("n"))
        return F.when(take, F.struct((s["total"] + cost).alias("total"), F.concat(s["out"], F.array(block)).alias("out"))).otherwise(s)

    taken = lists.select("question_id", F.posexplode(F.aggregate("hits", start, step, lambda s: s["out"])).alias("pos", "b"))
    taken = taken.select("question_id", F.concat(F.lit("E"), (F.col("pos") + 1).cast("string")).alias("alias"), F.col("b.rank").alias("rank"), F.col("b.n").alias("tokens"))
    out = taken.join(own.drop("n"), ["question_id", "rank"])
    return out.withColumn("text", truncate_tokens(F.col("text"), budget))


def evidence_totals(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("question_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.length("text")).alias("characters"), F.count(F.lit(1)).alias("blocks"))


def grounded_prompt(blocks: DataFrame, rules: str) -> DataFrame:
    """``question_id, prompt``: the rules, then one line a block with alias, file name and pages.

    ``blocks`` may carry ``name, page_start, page_end``; an empty or null name is left out.
    """
    name = F.when(F.coalesce("name", F.lit("")) == "", "").otherwise(F.concat(F.lit(" (file: "), "name", F.lit(")")))
    line = F.concat(F.lit("["), "alias", F.lit("]"), name, page_tag(F.col("page_start"), F.col("page_end")), F.lit(" "), "text")
    lines = blocks.withColumn("line", line).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return lines.select("question_id", F.concat(F.lit(rules + "\n\nEvidence:\n"), F.array_join(F.transform("l", lambda r: r["line"]), "\n")).alias("prompt"))


def aliases_in(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r"\[(E\d+)\]"), F.lit(1))


def map_citations(answers: DataFrame, aliases: str = "aliases", answer: str = "answer") -> DataFrame:
    """``answers`` with ``citations`` (known aliases by first appearance), the rewritten answer and warnings."""
    found = F.array_distinct(aliases_in(F.col(answer)))
    known = F.filter(found, lambda a: F.array_contains(aliases, a))
    unknown = F.filter(found, lambda a: ~F.array_contains(aliases, a))
    out = answers.withColumns({"citations": known, "_unknown": unknown})
    numbered = F.transform("citations", lambda a, i: F.struct(F.concat(F.lit("["), a, F.lit("]")).alias("mark"), F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("to")))
    cleaned = F.aggregate("_unknown", F.col(answer), lambda s, a: F.replace(s, F.concat(F.lit("["), a, F.lit("]")), F.lit("")))
    rewritten = F.aggregate(numbered, cleaned, lambda s, x: F.replace(s, x["mark"], x["to"]))
    warnings = F.when(F.size("_unknown") > 0, F.array(F.lit(UNKNOWN_CITATION))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"rewritten": rewritten, "warnings": warnings}).drop("_unknown")


def answer_status(answer: Column, refusal: Column) -> Column:
    return F.when(refusal.isNotNull(), "refused").when(F.contains(F.trim(answer), F.lit(INSUFFICIENT)), "insufficient_evidence").otherwise("completed")


def source_policies(evidence: DataFrame, locations: DataFrame) -> DataFrame:
    """Distinct sources of each question with their policy; unknown sources deny."""
    own = evidence.select("question_id", "location_id").distinct()
    return own.join(locations.select("location_id", "policy"), "location_id", "left").withColumn("policy", F.coalesce("policy", F.lit("deny")))


def external_decision(questions: DataFrame, policies: DataFrame) -> DataFrame:
    """``questions(question_id, external, external_enabled, acknowledged)`` with ``decision`` and ``denied_sources``."""
    denied = policies.groupBy("question_id").agg(F.count_if(F.col("policy") != "allow").alias("denied"))
    out = questions.join(denied, "question_id", "left").withColumn("denied", F.coalesce("denied", F.lit(0).cast("long")))
    decision = (
        F.when(~F.col("external"), "allowed")
        .when(~F.col("external_enabled"), "denied")
        .when(F.col("denied") > 0, "denied")
        .when(~F.col("acknowledged"), "confirmation_required")
        .otherwise("allowed")
    )
    counted = F.when(F.col("external") & F.col("external_enabled"), F.col("denied")).otherwise(F.lit(0).cast("long"))
    return out.withColumns({"decision": decision, "denied_sources": counted}).drop("denied")


def payload(attempted: Column, blocks: Column, characters: Column, citations: Column) -> Column:
    """What left the machine; all zero unless a request was attempted."""
    zero = lambda c: F.when(attempted, c).otherwise(F.lit(0).cast("long"))
    return F.struct(attempted.alias("question_sent"), zero(blocks).alias("blocks_sent"), zero(characters).alias("characters_sent"), zero(citations).alias("citation_ids_sent"))


def history_problem(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, problem``: too many turns, a turn too long or empty, an unknown role, or null."""
    bad = (F.length("text") > MAX_TURN_CHARS) | F.col("text").isNull() | (F.length("text") == 0)
    out = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(bad).alias("bad"), F.count_if(~F.col("role").isin("user", "assistant") | F.col("role").isNull()).alias("odd"))
    problem = F.when(F.col("turns") > MAX_TURNS, "too_many_turns").when(F.col("bad") > 0, "bad_turn").when(F.col("odd") > 0, "bad_role")
    return out.select("conv_id", "turns", problem.alias("problem"))
