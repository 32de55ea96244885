"""What an author of rules needs, in one place: rules, their registry, the names of tables and the helpers of their tests."""

from strandline.operators.rule_set import CATALOGUE, registry
from strandline.operators.rules import Registry, Rule, faults, judged, missing, plans, questions, self_judged, stub_answers

__all__ = ["CATALOGUE", "Registry", "Rule", "faults", "judged", "missing", "plans", "questions", "registry", "self_judged", "stub_answers"]
