"""Document trees as adjacency lists: walks, ancestors, isolation, re-resolution."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut


def ancestors(nodes: DataFrame) -> DataFrame:
    """``(node_id, ancestor_id, distance)`` for ``(node_id, parent_id)``, one join per level.

    Rounds follow the tree's depth, not its size; each level is written to reliable storage, so none is run
    twice. A node that is its own ancestor is an error.
    """
    edges = cut(nodes.where("parent_id IS NOT NULL").select("node_id", "parent_id"))
    up = edges.select(F.col("node_id").alias("at"), F.col("parent_id").alias("next"))
    level = edges.select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    out = level
    for d in count(2):
        level = cut(level.join(up, F.col("ancestor_id") == F.col("at")).select(
            "node_id", F.col("next").alias("ancestor_id"), F.lit(d).alias("distance")))
        if level.isEmpty():
            return out
        loops = level.where("node_id = ancestor_id").select("node_id").take(1)
        if loops:
            raise ValueError(f"the tree has a cycle through {loops[0][0]}")
        out = out.unionByName(level)


def walk(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """Depth-first order key from sibling ordinals, root first; sorting by it is file order."""
    ordinal = nodes.select(F.col("node_id").alias("ancestor_id"), F.col("ordinal").alias("_o"))
    self_row = nodes.select("node_id", F.lit(0).alias("distance"), F.col("ordinal").alias("_o"))
    up = chain.join(ordinal, "ancestor_id").select("node_id", "distance", "_o")
    path = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("_o").alias("o"))))
    return self_row.unionByName(up).groupBy("node_id").agg(path.alias("_p")).select(
        "node_id", (F.size("_p") - 1).alias("depth"),
        F.expr("array_join(transform(_p, e -> lpad(CAST(e.o AS STRING), 10, '0')), '/') AS order_key"))


def isolate(nodes: DataFrame, chain: DataFrame, roots: DataFrame) -> DataFrame:
    """The chosen nodes, all they contain, and their own ancestors as childless stubs."""
    chosen = roots.select("node_id").distinct()
    below = chain.join(chosen.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id", "left_semi").select("node_id")
    above = chain.join(chosen, "node_id", "left_semi").select(F.col("ancestor_id").alias("node_id"))
    inside = chosen.unionByName(below).distinct().withColumn("role", F.lit("content"))
    stubs = above.distinct().join(inside, "node_id", "left_anti").withColumn("role", F.lit("stub"))
    return nodes.join(inside.unionByName(stubs), "node_id")


def resolve(elements: DataFrame, layers: DataFrame) -> DataFrame:
    """Match by uuid first, then by name; an unmatched element raises naming both when read."""
    by_uuid = layers.where("uuid <> ''").groupBy("shot", "uuid").agg(F.expr("min_by(node_id, ordinal) AS _u"))
    by_name = layers.groupBy("shot", "name").agg(F.expr("min_by(node_id, ordinal) AS _n"))
    j = elements.join(by_uuid, ["shot", "uuid"], "left").join(by_name, ["shot", "name"], "left")
    return j.select(elements.columns + [
        F.expr("coalesce(_u, _n, raise_error(concat('no layer with uuid ', coalesce(uuid, 'null'), ' or name ', name)))").alias("node_id"),
        F.expr("CASE WHEN _u IS NOT NULL THEN 'uuid' ELSE 'name' END").alias("matched_by")])
