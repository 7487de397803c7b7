"""The result graph between flows and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes(names: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """(id, name_en, name_ko, docs): names with their documents, nulls as empty text or 0."""
    rows = names.join(docs, key, "left")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.replace("tech_", ""))
    return rows.select(key, text("tech_name_en").alias("name_en"), text("tech_name_ko").alias("name_ko"), F.coalesce("docs", F.lit(0)).alias("docs"))


def edges_compat(docs: DataFrame) -> DataFrame:
    """Documents by (cluster id, component), all years pooled: the ids that the old graph compared with flows."""
    return docs.where("component_tech_id is not null").groupBy(F.col("orig_cluster_id").alias("from_element_id"), F.col("component_tech_id").alias("to_component_id")).agg(F.count("*").alias("weight"))


def edges_corrected(docs: DataFrame, panel: DataFrame) -> DataFrame:
    """Documents by (flow, component), through the flow of each document's (year, cluster)."""
    p = panel.select("year", F.col("cluster_id").alias("orig_cluster_id"), "flow_id")
    rows = docs.where("component_tech_id is not null").join(p, ["year", "orig_cluster_id"])
    return rows.groupBy(F.col("flow_id").alias("from_element_id"), F.col("component_tech_id").alias("to_component_id")).agg(F.count("*").alias("weight"))


def pruned_edges(edges: DataFrame, elements: DataFrame, components: DataFrame, min_weight: int = 1, per_element: int | None = 3, per_component: int | None = None) -> DataFrame:
    """Edges of enough weight, the heaviest of each element (then component), between nodes that exist.

    Edges to absent nodes take their place among the heaviest before they go.
    """
    out = edges.where(F.col("weight") >= min_weight)
    for n, one, other in ((per_element, "from_element_id", "to_component_id"), (per_component, "to_component_id", "from_element_id")):
        if n:
            w = Window.partitionBy(one).orderBy(F.desc("weight"), other)
            out = out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")
    out = out.join(elements.select(F.col("id").alias("from_element_id")), "from_element_id", "left_semi")
    out = out.join(components.select(F.col("id").alias("to_component_id")), "to_component_id", "left_semi")
    return out.select("from_element_id", "to_component_id", "weight").orderBy(F.desc("weight"), "from_element_id", "to_component_id")


def connected_nodes(own: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """Nodes at an edge's end, by documents descending."""
    return own.join(edges.select(F.col(end).alias("id")), "id", "left_semi").orderBy(F.desc("docs"), "id")
