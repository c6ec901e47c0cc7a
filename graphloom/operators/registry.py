"""Joins against registries of paths, names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import has_name, last_segment, parent_path


def latest_before(rows: DataFrame, registry: DataFrame, key: str, order: str, at: str, values: list[str], row_id: list[str]) -> DataFrame:
    """As-of join: each row gets the values that its key had last before the row's position.

    ``registry`` has key, order and values; rows without a match keep nulls.
    """
    reg = registry.select(F.col(key).alias("__k"), F.struct(F.col(order).alias("__o"), *values).alias("__v"))
    hit = rows.select(*row_id, key, at).join(reg, (F.col(key) == F.col("__k")) & (F.col("__v.__o") < F.col(at)))
    best = hit.groupBy(*row_id).agg(F.max("__v").alias("__v")).select(*row_id, *(F.col(f"__v.{v}").alias(v) for v in values))
    return rows.join(best, row_id, "left")


def longest_prefix(rows: DataFrame, registry: DataFrame, parts: str, row_id: list[str], at: str | None = None, order: str | None = None) -> DataFrame:
    """(row_id, path): the longest registered prefix of an array of path parts, as of ``at`` if given."""
    tried = rows.select(*row_id, *([at] if at else []), F.posexplode(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))).alias("__i", "__n"), F.col(parts)).where(F.size(parts) >= F.col("__n"))
    tried = tried.withColumn("__path", F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.col("__n")), "/")))
    on = F.col("__path") == F.col("path")
    if at:
        on = on & (F.col(order) < F.col(at))
    return tried.join(registry, on).groupBy(*row_id).agg(F.max_by("path", "__n").alias("path"))


def containment(paths: DataFrame) -> DataFrame:
    """(parent, child, property) for every registered path whose parent is registered: an equi-join, not a scan of all pairs."""
    child = paths.select(F.col("path").alias("child"), parent_path(F.col("path")).alias("__parent"))
    return child.join(paths.select(F.col("path").alias("parent")), F.col("__parent") == F.col("parent")).select("parent", "child", has_name(last_segment(F.col("child"))).alias("property"))


def unregistered(rows: DataFrame, registry: DataFrame, path: str = "path") -> DataFrame:
    return rows.join(registry.select(F.col("path").alias("__p")), F.col(path) == F.col("__p"), "left_anti")


def last_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row that comes last for each key (later definitions replace earlier ones)."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def disjoint_pairs(members: DataFrame, group: str | list[str], item: str) -> DataFrame:
    """Unordered pairs of distinct items of a group, smaller first. Pairs are the result, so rows are not reduced."""
    keys = [group] if isinstance(group, str) else group
    m = members.select(*keys, item).distinct()
    other = m.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(item).alias("b"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return m.join(other, cond & (F.col(item) < F.col("b"))).select(*keys, F.col(item).alias("a"), "b")


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, depth): every pair once, at its least depth.

    Semi-naive: each round joins the pairs found by the last one with the edges
    and keeps those that are new, so the rows are pairs and never paths, and
    circles end (their nodes are their own ancestors).
    """
    from ..plans.durable import cut

    e = cut(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").distinct())
    new = e.select(F.col("c").alias("node"), F.col("p").alias("ancestor"))
    done, depth = None, 1
    while True:
        level = cut(new.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return level if done is None else done
        done = level if done is None else done.unionByName(level)
        step = level.join(e, F.col("ancestor") == F.col("c")).select("node", F.col("p").alias("ancestor")).distinct()
        new = step.join(done.select(F.col("node").alias("n"), F.col("ancestor").alias("a")), (F.col("node") == F.col("n")) & (F.col("ancestor") == F.col("a")), "left_anti")
        depth += 1

