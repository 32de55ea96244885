"""Spans and positions: containment, the nearest before, the deepest ancestor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import ancestors


def contained(sites: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Sites with each span of the same key that holds them (start inclusive, end exclusive)."""
    return sites.join(spans, on).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def innermost(sites: DataFrame, spans: DataFrame, on: list[str], site: str, at: str, start: str, end: str, span: str) -> DataFrame:
    """Each site with the shortest span that holds it."""
    held = contained(sites, spans, on, at, start, end)
    return held.groupBy(*on, site, at).agg(F.min_by(span, F.struct(F.col(end) - F.col(start), F.col(start), F.col(span))).alias(span))


def nearest_before(points: DataFrame, marks: DataFrame, on: list[str], point: str, at: str, mark: str, mark_at: str) -> DataFrame:
    """Each point with the last mark at or before it, null without one: an as-of join by one sort of both sides.

    Both sides go through one window, so no pairs are made however many marks a key has.
    """
    from pyspark.sql import Window

    both = points.select(*on, F.col(point).alias("_point"), F.col(at).alias("_at"), F.lit(None).cast(marks.schema[mark].dataType).alias("_mark"), F.lit(None).cast(marks.schema[mark_at].dataType).alias("_mark_at"), F.lit(1).alias("_side"))
    both = both.unionByName(marks.select(*on, F.lit(None).cast(points.schema[point].dataType).alias("_point"), F.col(mark_at).alias("_at"), F.col(mark).alias("_mark"), F.col(mark_at).alias("_mark_at"), F.lit(0).alias("_side")))
    window = Window.partitionBy(*on).orderBy("_at", "_side", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"_last": F.last("_mark", ignorenulls=True).over(window), "_last_at": F.last("_mark_at", ignorenulls=True).over(window)})
    return seen.where("_side = 1").select(*on, F.col("_point").alias(point), F.col("_at").alias(at), F.col("_last").alias(mark), F.col("_last_at").alias(mark_at))


def nearest_ancestor(paths: DataFrame, within: str, path: str, places: DataFrame, place: str) -> DataFrame:
    """Each path with the deepest directory of `places` above it, null without one."""
    above = paths.select(within, path, F.posexplode(ancestors(F.col(path))).alias("depth", place))
    found = above.join(places.select(within, place).distinct(), [within, place]).groupBy(within, path).agg(F.max_by(place, "depth").alias(place))
    return paths.select(within, path).join(found, [within, path], "left")
