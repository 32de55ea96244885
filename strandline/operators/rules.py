"""Rules: candidates, facts, questions, answers, findings.

A rule plans candidates with the facts a judgement needs and says which labels are violations. Planning is
lazy and distributed; equal questions are asked once; answers are joined from a table; what isn't answered
is counted as a drop and never guessed.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.hashing import canonical_json, sha16
from strandline.operators import gates


@dataclass(frozen=True)
class Rule:
    """A rule's candidates are rows (subject, path, facts): facts is JSON with what a judgement may look at."""

    id: str
    plan: Callable[[dict[str, DataFrame]], DataFrame] | None
    violations: tuple[str, ...]
    severity: str = "warning"
    version: str = "1"
    #: a rule that judges by itself returns findings (subject, path, score) and asks nothing
    run: Callable[[dict[str, DataFrame]], DataFrame] | None = None


@dataclass
class Registry:
    """Rules by id; a module that fails to load leaves a note and never silence."""

    rules: dict[str, Rule] = field(default_factory=dict)
    notes: list[tuple[str, str]] = field(default_factory=list)

    def add(self, rule: Rule) -> Rule:
        if rule.id in self.rules:
            raise ValueError(f"two rules have the id {rule.id}")
        if not rule.violations:
            raise ValueError(f"{rule.id} declares no violations")
        self.rules[rule.id] = rule
        return rule

    def load(self, module: str) -> None:
        try:
            for rule in importlib.import_module(module).RULES:
                self.add(rule)
        except Exception as error:  # noqa: BLE001
            self.notes.append((module, f"{type(error).__name__}: {error}"))

    def configured(self, severities: dict[str, str]) -> list[Rule]:
        """The rules that aren't off; own settings over the rule's default."""
        kept = [replace(r, severity=severities.get(r.id, r.severity)) for r in self.rules.values()]
        return [r for r in kept if r.severity != "off"]


def plans(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, subject, path, fact, question): the candidates of all rules with the address of their facts and the key of their question."""
    union = None
    for rule in rules:
        if rule.plan is None:
            continue
        part = rule.plan(tables).select(F.lit(rule.id).alias("rule"), F.lit(rule.version).alias("version"), F.col("subject").cast("string").alias("subject"), "path", canonical_json(F.col("facts")).alias("facts"))
        union = part if union is None else union.unionByName(part)
    keyed = union.withColumn("fact", F.concat(F.lit("a"), sha16("facts")))
    return keyed.withColumn("question", sha16(F.concat_ws("\0", "rule", "version", "fact"))).drop("version")


def questions(planned: DataFrame) -> DataFrame:
    """Each different question once, with its facts."""
    return planned.groupBy("question").agg(F.min("rule").alias("rule"), F.min("fact").alias("fact"), F.min("facts").alias("facts"))


def missing(planned: DataFrame, answers: DataFrame) -> DataFrame:
    """The questions that no answer is stored for."""
    return questions(planned).join(answers.select(F.col("key").alias("question")), "question", "left_anti")


def judged(planned: DataFrame, answers: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(findings, drops) of planned candidates: findings (rule, subject, path, score, band, severity), drops (rule, subject, stage)."""
    violating = F.create_map(*[x for r in rules for x in (F.lit(r.id), F.array(*[F.lit(v) for v in r.violations]))])
    severity = F.create_map(*[x for r in rules for x in (F.lit(r.id), F.lit(r.severity))])
    stored = answers.select(F.col("key").alias("question"), "label", "probabilities", "confidence")
    both = planned.join(stored, "question", "left")
    mass = F.aggregate(F.map_values(F.map_filter("probabilities", lambda k, v: F.array_contains(violating[F.col("rule")], k))), F.lit(0.0), lambda a, x: a + x)
    score = F.when(F.col("probabilities").isNotNull(), F.least(F.greatest(mass, F.lit(0.0)), F.lit(1.0))).when(F.col("label").isNotNull(), F.array_contains(violating[F.col("rule")], F.col("label")).cast("double"))
    scored = both.withColumns({"score": score, "gap": gates.margin(F.col("probabilities"))})
    banded = scored.withColumn("band", F.when(F.col("score").isNull(), "unanswered").otherwise(gates.quality(F.col("score"), F.col("gap"), F.col("confidence"))))
    kept = banded.where("band in ('act', 'review')").select("rule", "subject", "path", "score", "band", F.when(F.col("band") == "review", "info").otherwise(severity[F.col("rule")]).alias("severity"))
    dropped = banded.where("band not in ('act', 'review')").select("rule", "subject", F.when(F.col("band") == "drop", "gate").otherwise("unanswered").alias("stage"))
    return kept, dropped


def self_judged(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame | None:
    """The findings of rules that answer themselves, in the form of judged(); None without such a rule."""
    union = None
    for rule in rules:
        if rule.run is None:
            continue
        part = rule.run(tables).select(F.lit(rule.id).alias("rule"), F.col("subject").cast("string").alias("subject"), "path", F.col("score").cast("double").alias("score"), F.lit("act").alias("band"), F.lit(rule.severity).alias("severity"))
        union = part if union is None else union.unionByName(part)
    return union


def stub_answers(planned: DataFrame, labels: dict[str, tuple[str, ...]], otherwise: str = "fine") -> DataFrame:
    """Answers for tests, (key, label, probabilities, confidence): made of the question's key alone, so always the same, and in no way a judgement."""
    share = F.pmod(F.xxhash64("question"), F.lit(1000)) / 1000.0
    label = F.create_map(*[x for rule, names in labels.items() for x in (F.lit(rule), F.lit(names[0]))])[F.col("rule")]
    asked = questions(planned)
    return asked.select(F.col("question").alias("key"), F.when(share >= 0.5, label).otherwise(F.lit(otherwise)).alias("label"), F.create_map(label, share, F.lit(otherwise), 1 - share).alias("probabilities"), F.lit(None).cast("double").alias("confidence"))


def faults(rules: list[Rule], allowed: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, str]]:
    """(rule, fault) of rules that break what is expected of their authors, except where `allowed` names the fault for a rule.

    Expected: violations are declared, each once; the rule is described; it asks or judges, and not both; a version is given.
    """
    allowed = allowed or {}
    found = []
    for rule in rules:
        checks = {
            "no-violations": not rule.violations, "repeated-violation": len(set(rule.violations)) < len(rule.violations), "no-version": not rule.version,
            "unknown-severity": rule.severity not in ("error", "warning", "info", "off"), "asks-and-judges": rule.run is not None and rule.plan is not None,
        }
        found += [(rule.id, name) for name, broken in checks.items() if broken and name not in allowed.get(rule.id, ())]
    return found


def merged_config(*layers: dict) -> dict:
    """Configurations from the most general to one's own: later ones win, rule by rule; lists of patterns add up, each once."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if isinstance(value, dict):
                out[key] = {**out.get(key, {}), **value}
            elif isinstance(value, list):
                out[key] = [*out.get(key, []), *(x for x in value if x not in out.get(key, []))]
            else:
                out[key] = value
    return out
