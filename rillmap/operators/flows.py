"""Flows: chains of matched clusters through the years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmap.config import TERMS_PER_FLOW
from rillmap.operators.lineage import cut


def flow_panel(edges: DataFrame) -> DataFrame:
    """(flow_id, year, cluster_id, docs): each cluster in the flow of the least (year, cluster) source that reaches it.

    Every cluster has one edge onward at most and years only grow, so pointers can double: in round k a cluster hands
    its least source to the cluster 2^k steps on, for as many rounds as the logarithm of the years that the edges
    span. Tables have a row for each cluster. Sources are numbered in (year, cluster) order.
    """
    node = lambda y, c: F.struct(F.col(y).alias("year"), F.col(c).alias("cluster_id"))
    edges = cut(edges)
    first, last = edges.agg(F.min("year_from"), F.max("year_to")).first()
    steps = edges.select(node("year_from", "prev_id").alias("n"), node("year_to", "next_id").alias("to"), F.col("docs_from").alias("docs"))
    ends = edges.select(node("year_to", "next_id").alias("n"), F.lit(None).cast(steps.schema["to"].dataType).alias("to"), F.col("docs_to").alias("docs"))
    nodes = steps.union(ends).groupBy("n").agg(F.max("to").alias("to"), F.max("docs").alias("docs"))
    sources = steps.select("n").join(ends.select("n"), "n", "left_anti")
    numbered = sources.withColumn("flow_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("n")) - 1)
    nodes = cut(nodes.join(numbered, "n", "left").select("n", "docs", "flow_id", "to"))
    for _ in range(max(0, (last or 0) - (first or 0)).bit_length()):
        handed = nodes.where("to is not null").groupBy(F.col("to").alias("n")).agg(F.min("flow_id").alias("other"))
        far = nodes.select(F.col("n").alias("to"), F.col("to").alias("far"))
        moved = nodes.join(handed, "n", "left").join(far, "to", "left")
        nodes = cut(moved.select("n", "docs", F.least("flow_id", "other").alias("flow_id"), F.col("far").alias("to")))
    return nodes.select("flow_id", "n.year", "n.cluster_id", "docs")


def flow_panel_recursive(edges: DataFrame) -> DataFrame:
    """The same rows as flow_panel by a recursive query that follows every source year by year.

    It has a step for each year that edges span, and a row for each source and cluster that it reaches, so flows that
    merge are followed on side by side: fit for few flows, while flow_panel has a row for each cluster alone.
    """
    edges = cut(edges)
    first, last = edges.agg(F.min("year_from"), F.max("year_to")).first()
    walked = """
        WITH RECURSIVE sources AS (
          SELECT year_from AS year, prev_id AS cluster_id, row_number() OVER (ORDER BY year_from, prev_id) - 1 AS flow_id
          FROM (SELECT DISTINCT year_from, prev_id FROM {edges}) f ANTI JOIN {edges} e ON e.year_to = f.year_from AND e.next_id = f.prev_id),
        walk (year, cluster_id, flow_id) MAX RECURSION LEVEL {levels} AS (
          SELECT year, cluster_id, flow_id FROM sources
          UNION ALL
          SELECT e.year_to, e.next_id, w.flow_id FROM walk w JOIN {edges} e ON e.year_from = w.year AND e.prev_id = w.cluster_id),
        docs AS (
          SELECT year, cluster_id, max(docs) AS docs
          FROM (SELECT year_from AS year, prev_id AS cluster_id, docs_from AS docs FROM {edges} UNION ALL SELECT year_to, next_id, docs_to FROM {edges}) GROUP BY ALL)
        SELECT min(flow_id) AS flow_id, year, cluster_id, any_value(docs) AS docs FROM walk JOIN docs USING (year, cluster_id) GROUP BY year, cluster_id
    """
    spark, limit = edges.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, -1)  # rows are bounded by the sources and the years
    try:
        return cut(spark.sql(walked.replace("{levels}", str((last or 0) - (first or 0) + 2)), edges=edges).select(F.col("flow_id").cast("int").alias("flow_id"), "year", "cluster_id", "docs"))
    finally:
        spark.conf.set(limit, before)


def flow_docs(panel: DataFrame) -> DataFrame:
    return panel.groupBy("flow_id").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"))


def top_flows(panel: DataFrame, n: int) -> DataFrame:
    """The n flows with most documents, ties to the smaller id."""
    return flow_docs(panel).orderBy(F.desc("docs"), "flow_id").limit(n)


def flow_keywords(panel: DataFrame, terms: DataFrame, top: int = TERMS_PER_FLOW) -> DataFrame:
    """(flow_id, term, score, rank): summed scores of the flow's clusters' top terms."""
    rows = terms.join(panel.select("flow_id", "year", "cluster_id"), ["year", "cluster_id"])
    summed = rows.where("term <> ''").groupBy("flow_id", F.lower("term").alias("term")).agg(F.sum("tfidf").alias("score"))
    order = Window.partitionBy("flow_id").orderBy(F.desc(F.round("score", 9)), "term")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def cluster_titles(docs: DataFrame, title: str = "title", per_cluster: int = 2, total: int = 120) -> DataFrame:
    """(year, cluster_id, place, title): the first titles of each cluster in order, `total` in all."""
    w = Window.partitionBy("year", "cluster_id").orderBy("doc_id")
    rows = docs.select("year", "cluster_id", "doc_id", title).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_cluster)
    return rows.orderBy("year", "cluster_id", "place").limit(total).select("year", "cluster_id", "place", F.col(title).alias("title"))
