"""Asking for judgements: retries, what an unreachable judge means, scope before and after, prescriptions and relevance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.scope import in_scope

T = TypeVar("T")
A = TypeVar("A")


class Unreachable(RuntimeError):
    """The judge wasn't reached: asking again would ask the same silence."""


def answer_in_halves(ask: Callable[[Sequence[T]], list[A]], questions: Sequence[T], _again: bool = False) -> list[A | None]:
    """The answers to a chunk of questions, asked in one request; a failed request is cut in halves, a lone question asked once more and then given up.

    Questions whose requests failed have the answer None; an unreachable judge is an error of the whole chunk. Runs on
    the driver, where requests are sent.
    """
    try:
        return list(ask(questions))
    except Unreachable:
        raise
    except Exception:
        if len(questions) <= 1:
            if _again:
                return [None] * len(questions)
            return answer_in_halves(ask, questions, True)
        half = -(-len(questions) // 2)
        return answer_in_halves(ask, questions[:half]) + answer_in_halves(ask, questions[half:])


def ask_fewer(ask: Callable[[Sequence[T]], A], candidates: Sequence[T]) -> tuple[A, int]:
    """(answer, how many were considered): the first half is asked again as long as a request is refused; a lone or unreachable one fails."""
    many = list(candidates)
    while True:
        try:
            return ask(many), len(many)
        except Unreachable:
            raise
        except Exception:
            if len(many) <= 1:
                raise
            many = many[: max(1, -(-len(many) // 2))]


def unavailable_policy(rule: str | None, run: str | None, declared: str) -> str:
    """What a silent judge means for a rule, 'report', 'propagate' or 'count': the rule's own setting, else the run's, else what the rule declares."""
    chosen = rule or run or declared
    if chosen not in ("report", "propagate", "count"):
        raise ValueError(chosen)
    return chosen


def unreached(planned: DataFrame, policy: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(drops, notes) for planned questions that a silent judge left: 'propagate' skips each rule with one note, 'count' also counts its candidates, 'report' leaves both to the reader."""
    notes = planned.select("rule").distinct().withColumn("reason", F.lit(reason))
    drops = planned.select("rule", "subject", F.lit("unanswered").alias("stage"))
    if policy == "report":
        return drops.limit(0), notes.limit(0)
    return (drops, notes) if policy == "count" else (drops.limit(0), notes)


def scoped_plans(planned: DataFrame, place: str, changed: DataFrame | None, moved: DataFrame | None = None) -> DataFrame:
    """Only what the run is about is asked."""
    return in_scope(planned, place, changed, moved)


def scoped_findings(findings: DataFrame, place: str, changed: DataFrame | None, moved: DataFrame | None = None) -> DataFrame:
    """Only what the run is about is reported, whatever a rule returns."""
    return in_scope(findings, place, changed, moved)


def settled_drops(drops: DataFrame, subject: str, stage: str, outside: DataFrame, over_budget: DataFrame) -> DataFrame:
    """Drops as they are to be counted: one 'unreadable' because it wasn't in scope goes, one that the budget left is a 'budget' drop."""
    unread = F.col(stage) == "unreadable"
    far = outside.select(F.col(subject)).distinct().withColumn("_outside", F.lit(True))
    over = over_budget.select(F.col(subject)).distinct().withColumn("_over", F.lit(True))
    marked = drops.join(far, subject, "left").join(over, subject, "left")
    kept = marked.where(~(F.coalesce(unread, F.lit(False)) & F.col("_outside").isNotNull()))
    return kept.withColumn(stage, F.when(unread & F.col("_over").isNotNull(), "budget").otherwise(F.col(stage))).drop("_outside", "_over")


def prescription(role: Column, relationship: Column) -> Column:
    """What to do about copies: those that can reach each other keep one; across packages a contract stays, a concept is shared, glue is left, the rest is hoisted."""
    return (
        F.when(relationship.isin("same_module", "same_package"), "keep one")
        .when(role == "wire_contract", "expected").when(role == "domain_concept", "share").when(role == "framework_glue", "leave")
        .otherwise("hoist")
    )


def cluster_facts(members: DataFrame, cluster: str, file: str, overlap: str, typed: str) -> DataFrame:
    """(cluster, members, files, overlap, typed): how many files it lies in, the greatest overlap, and whether any member has types."""
    return members.groupBy(cluster).agg(F.count("*").alias("members"), F.count_distinct(file).alias("files"), F.max(overlap).alias("overlap"), F.bool_or(F.coalesce(F.col(typed), F.lit(False))).alias("typed"))


def described_members(members: DataFrame, cluster: str, order: list[str], name: str, changed: str, most: int = 12) -> DataFrame:
    """(cluster, names): the members shown, those that changed first, otherwise in order; at most `most`, which is what a description holds."""
    row = F.struct(F.when(F.col(changed), 0).otherwise(1).alias("_late"), *order, F.col(name).alias("_name"))
    # the smallest `most` of each cluster are merged piece by piece, so a cluster of any size fits
    pieces = members.withColumn("_piece", F.pmod(F.xxhash64(*order, name), F.lit(64))).groupBy(cluster, "_piece").agg(F.slice(F.array_sort(F.collect_list(row)), 1, most).alias("_rows"))
    joined = pieces.groupBy(cluster).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_rows"))), 1, most).alias("_rows"))
    return joined.select(cluster, F.transform("_rows", lambda r: r["_name"]).alias("names"))


def anchored_drift(fields: DataFrame, field: str, type_text: str, file: str, line: str) -> DataFrame:
    """(field, n_types, places, file, line): fields with several type texts, anchored at their first declaration."""
    got = fields.groupBy(field).agg(F.count_distinct(type_text).alias("n_types"), F.count_distinct(file, line).alias("places"), F.min(F.struct(file, line)).alias("_a"))
    return got.where("n_types > 1").select(field, "n_types", "places", F.col(f"_a.{file}").alias(file), F.col(f"_a.{line}").alias(line))


def run_totals(requests: DataFrame, replayed: str, tokens: str, by: list[str]) -> DataFrame:
    """(by..., requests, replayed, calls, tokens): what a run cost; a replayed request is no call and its tokens don't count."""
    fresh = ~F.coalesce(F.col(replayed), F.lit(False))
    return requests.groupBy(*by).agg(F.count("*").alias("requests"), F.count(F.when(~fresh, 1)).alias("replayed"), F.count(F.when(fresh, 1)).alias("calls"), F.coalesce(F.sum(F.when(fresh, F.col(tokens))), F.lit(0)).alias("tokens"))


def relevance(candidates: DataFrame, answers: DataFrame, key: str, probability: str, exists: float, most: int = 10) -> DataFrame:
    """(key, confidence, exists): candidates by the probability that each answers the question; without an answer 0. The top `most` are the feature; ties go by key."""
    got = candidates.select(key).join(answers.select(key, F.col(probability).alias("confidence")), key, "left")
    return got.select(key, F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit(float(exists)).alias("exists")).orderBy(F.col("confidence").desc(), key).limit(most)
