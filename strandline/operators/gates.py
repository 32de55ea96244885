"""Judgements: margins, verdicts, quality gates, severities, calibration. All are expressions over stored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values of the gates: least score, least margin, least confidence
SCORE, MARGIN, CONFIDENCE = 0.5, 0.25, 0.6


def margin(probabilities: Column) -> Column:
    """The greatest probability less the second; 1 with a single option, null without any."""
    ordered = F.sort_array(F.map_values(probabilities), asc=False)
    return F.when(F.size(ordered) == 1, F.lit(1.0)).when(F.size(ordered) > 1, F.element_at(ordered, 1) - F.try_element_at(ordered, F.lit(2)))


def violating_mass(probabilities: Column, violating: list[str], label: Column) -> Column:
    """The probability of the violating labels, within 0..1; without probabilities 1 or 0 by the label."""
    mass = F.aggregate(F.map_values(F.map_filter(probabilities, lambda k, v: k.isin(violating))), F.lit(0.0), lambda a, x: a + x)
    return F.when(probabilities.isNull(), F.when(label.isin(violating), 1.0).otherwise(0.0)).otherwise(F.least(F.greatest(mass, F.lit(0.0)), F.lit(1.0)))


def agreement_margin(agreement: Column) -> Column:
    """The margin of a repeated yes/no: 2 agreement - 1, and 1 if it wasn't repeated."""
    return F.coalesce(2 * agreement - 1, F.lit(1.0))


def quality(score: Column, gap: Column, confidence: Column) -> Column:
    """'drop', 'review' or 'act'. A missing margin or confidence skips its test."""
    return F.when(score < SCORE, "drop").when(gap < MARGIN, "review").when(confidence < CONFIDENCE, "review").otherwise("act")


def severity(band: Column, expected: Column, places: Column, least_places: int = 3) -> Column:
    """'info' for what is under review, expected, or in few places; else 'warning'."""
    return F.when((band == "review") | expected | (places < least_places), "info").otherwise("warning")


def normal_rating(rating: Column, levels: Column, fallback: Column) -> Column:
    """A rating on 0..levels-1 as a share, else the fallback."""
    return F.coalesce(rating / F.when(levels > 1, levels - 1), fallback)


def derived_operation(candidate: Column, one_thing: Column, difference: Column) -> Column:
    """The table's answer: 'overloaded' splits, 'misplaced' moves; a duplicate that is one thing merges if a value differs and moves if the meaning does; else null."""
    return (
        F.when(candidate == "overloaded", "split").when(candidate == "misplaced", "move")
        .when(one_thing >= SCORE, F.when(difference == "value", "merge").when(difference == "meaning", "move"))
    )


def settle(proposed: Column, derived: Column, gap: Column, confidence: Column) -> Column:
    """Two estimators as peers: without a proposal drop; where the table has no opinion the quality of the proposal alone (its score counts as even); agreement acts, difference is reviewed."""
    return F.when(proposed.isNull(), "drop").when(derived.isNull(), quality(F.lit(0.5), gap, confidence)).when(proposed == derived, "act").otherwise("review")


def permitted(packages: Column) -> Column:
    """What may be done across packages: merging only within one."""
    return F.when(packages <= 1, "merge,move").otherwise("move")


def repeats(answers: DataFrame, key: str, probability: str) -> DataFrame:
    """(key, n, mean, agreement) of repeated yes/no answers; a yes is 0.5 or more."""
    yes = F.avg((F.col(probability) >= 0.5).cast("double"))
    return answers.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(probability), 6).alias("mean"), F.round(F.greatest(yes, 1 - yes), 6).alias("agreement"))


def calibration(answers: DataFrame, by: list[str], score: str, least: int = 5, fire: float = 0.5) -> DataFrame:
    """(by..., n, median, low, high, fired, verdict): skipped, noisy, weak or decisive, tested in that order."""
    got = answers.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(score, F.lit(0.5)).alias("median"), F.min(score).alias("low"), F.max(score).alias("high"), F.count(F.when(F.col(score) >= fire, 1)).alias("fired"))
    verdict = F.when(F.col("n") < least, "skipped").when(F.col("fired") / F.col("n") >= 0.6, "noisy").when((F.col("high") < 0.7) & (F.col("median") >= 0.25), "weak").otherwise("decisive")
    return got.select(*by, "n", F.round("median", 6).alias("median"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "fired", verdict.alias("verdict"))


def expand_repeats(questions: DataFrame, times: int = 3) -> DataFrame:
    """Each question as often as it is asked, with its turn from 0."""
    return questions.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
