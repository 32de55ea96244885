"""Modules, their roles and ranks, and dependencies that go from a lower to a higher one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_graph(edges: DataFrame, source: Column, target: Column, by: list[str]) -> DataFrame:
    """(by..., from_module, to_module, edges) of file edges projected to modules; edges within one module and without target are left out."""
    placed = edges.select(*by, source.alias("from_module"), target.alias("to_module"))
    return placed.where("from_module is not null and to_module is not null and from_module <> to_module").groupBy(*by, "from_module", "to_module").agg(F.count("*").alias("edges"))


def edge_roles(ranks: DataFrame, role: str, rank: str, by: list[str]) -> DataFrame:
    """(by..., role) of the highest rank: the outer edge of the architecture. Roles without a rank are no part of it."""
    top = ranks.groupBy(*by).agg(F.max(rank).alias("_top")) if by else ranks.agg(F.max(rank).alias("_top"))
    both = ranks.join(top, by) if by else ranks.crossJoin(F.broadcast(top))
    return both.where(F.col(rank) == F.col("_top")).select(*by, role).distinct()


def upward_roles(graph: DataFrame, roles: DataFrame, by: list[str]) -> DataFrame:
    """(by..., from_role, to_role, from_module, to_module) of module_graph's edges to a role of greater rank, one for each pair of roles: the smallest modules.

    roles is (by..., module, role, rank). Modules without a role or rank, modules of one role, and a module and one
    nested in it make no such edge.
    """
    known = roles.where("role is not null and rank is not null")
    left = known.select(*by, F.col("module").alias("from_module"), F.col("role").alias("from_role"), F.col("rank").alias("_from"))
    right = known.select(*by, F.col("module").alias("to_module"), F.col("role").alias("to_role"), F.col("rank").alias("_to"))
    met = graph.join(left, [*by, "from_module"]).join(right, [*by, "to_module"]).where("from_role <> to_role and _to > _from")
    nested = F.startswith("from_module", F.concat("to_module", F.lit("/"))) | F.startswith("to_module", F.concat("from_module", F.lit("/")))
    one = met.where(~nested).groupBy(*by, "from_role", "to_role").agg(F.min(F.struct("from_module", "to_module")).alias("m"))
    return one.select(*by, "from_role", "to_role", "m.from_module", "m.to_module")


def missing_and_orphans(profiles: DataFrame, promised: str, declared: str, prefix: str, hook: str = "^use[A-Z]", always: tuple[str, ...] = ("Provider",)) -> DataFrame:
    """profiles with `missing` (promised keys that no declared name answers) and `orphans` (declared names that no key promises).

    A name answers a key if it is the key, the key after the profile's prefix, or ends in the key. Keys in `always` and
    those that match `hook` are promised by convention and never missing.
    """
    def answers(name: Column, key: Column) -> Column:
        return (name == key) | (name == F.concat(F.col(prefix), key)) | F.endswith(name, key)

    lacking = F.filter(promised, lambda k: ~k.isin(*always) & ~k.rlike(hook) & ~F.exists(declared, lambda n: answers(n, k)))
    orphan = F.filter(declared, lambda n: ~F.exists(promised, lambda k: answers(n, k)))
    return profiles.withColumns({"missing": lacking, "orphans": orphan})
