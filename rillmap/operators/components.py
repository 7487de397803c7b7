"""Component technologies: centroids of clusters, grouped over all years."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmap.functions.vectors import cosine, divided, dot, l2, norm, usable_vector
from rillmap.operators.clustering import group_vectors
from rillmap.operators.lineage import cut
from rillmap.operators.pca import principal, project


@dataclass(frozen=True)
class ComponentConfig:
    n_components: int = 100
    year_col: str = "year"
    embedding_col: str = "embedding"
    label_col: str = "cluster_id"
    seed: int = 42
    pca_dims: int = 64
    min_cluster_docs: int = 1


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """(keys, docs, out): element-wise mean of a group's vectors, aggregated partially.

    Null vectors, and those of another width than most of the table's (ties: the narrower), count for nothing; docs counts the others.
    """
    rows = df.where(F.col(vector).isNotNull()).withColumn("width", F.size(vector))
    rows = rows.groupBy(*keys, "width").agg(F.count("*").alias("docs"), Summarizer.mean(array_to_vector(F.col(vector))).alias("m"))
    sizes = rows.groupBy("width").agg(F.sum("docs").alias("n"))
    best = sizes.agg(F.max_by("width", F.struct("n", -F.col("width"))).alias("width"))  # one row
    return rows.join(best, "width").select(*keys, "docs", vector_to_array("m").alias(out))


def centroids(df: DataFrame, cfg: ComponentConfig = ComponentConfig()) -> DataFrame:
    """(year, cluster, docs, vector): the mean of each cluster's unit vectors, scaled by its length + 1e-12.

    Documents without a usable vector (null, empty, with a component that is null or not finite, text that is no
    vector), or with one of another width than most, count for nothing; nor does one without a cluster.
    """
    missing = [c for c in (cfg.year_col, cfg.embedding_col, cfg.label_col) if c not in df.columns]
    if missing:
        raise KeyError(f"columns missing: {missing}")
    unit = df.select(cfg.year_col, cfg.label_col, l2(usable_vector(df, cfg.embedding_col)).alias("u")).where(F.col(cfg.label_col).isNotNull())
    rows = mean_vector(unit, [cfg.year_col, cfg.label_col], "u", "m").where(F.col("docs") >= cfg.min_cluster_docs)
    return rows.select(cfg.year_col, cfg.label_col, "docs", divided(F.col("m"), norm(F.col("m")) + 1e-12).alias("vector"))


def reduce_dimensions(cents: DataFrame, cfg: ComponentConfig = ComponentConfig()) -> DataFrame:
    """Centred principal components of the centroids, scaled to length one; untouched for fewer than two."""
    cents = cut(cents)  # a row for each cluster
    found = principal(cents.select(F.lit(0).alias("g"), F.col("vector").alias("u")), cfg.pca_dims).get(0)
    if found is None or found.n <= 1 or found.basis.shape[1] < 2 or min(cfg.pca_dims, found.n - 1) < 2:
        return cents.withColumn("z", l2(F.col("vector")))
    return cut(project(cents, "vector", found, "p")).withColumn("z", l2(F.col("p"))).drop("p")


def group_components(df: DataFrame, cfg: ComponentConfig = ComponentConfig()) -> tuple[DataFrame, DataFrame]:
    """(documents with component_tech_id, centroids with component_tech_id), by k-means over reduced centroids.

    The same k-means as for years, over all centroids as one group: seeded over all of them, and no matter how they
    lie. Groups are numbered by size, then by their first year and cluster.
    """
    z = cut(reduce_dimensions(centroids(df, cfg), cfg))
    labels = group_vectors(z.select(F.struct(cfg.year_col, cfg.label_col).alias("id"), "z"), cfg.n_components, cfg.seed)
    meta = z.join(labels.select(F.col(f"id.{cfg.year_col}").alias(cfg.year_col), F.col(f"id.{cfg.label_col}").alias(cfg.label_col), F.col("cluster").alias("component_tech_id")), [cfg.year_col, cfg.label_col])
    meta = cut(meta)
    return map_documents(df, meta, cfg), meta


def map_documents(df: DataFrame, meta: DataFrame, cfg: ComponentConfig = ComponentConfig()) -> DataFrame:
    """Documents with their cluster's component; the label is renamed orig_cluster_id."""
    small = meta.select(F.col(cfg.year_col), F.col(cfg.label_col).alias("orig_cluster_id"), "component_tech_id")
    return df.withColumnRenamed(cfg.label_col, "orig_cluster_id").join(small, [cfg.year_col, "orig_cluster_id"], "left")


def component_stats(meta: DataFrame, cfg: ComponentConfig = ComponentConfig()) -> DataFrame:
    rows = meta.groupBy("component_tech_id").agg(F.countDistinct(cfg.year_col).alias("n_years"), F.countDistinct(cfg.label_col).alias("n_orig_clusters"), F.sum("docs").alias("docs"))
    return rows.orderBy(F.desc("docs"), "component_tech_id")


def component_density(meta: DataFrame, vector: str = "z", cfg: ComponentConfig = ComponentConfig()) -> DataFrame:
    """(component_tech_id, mean_intra_cosine): mean cosine over a component's centroid pairs, 1 for a single one.

    Over unit vectors the sum of all pairs' products is (|sum|^2 - sum of |v|^2) / 2, so no pair is formed.
    """
    unit = meta.select("component_tech_id", l2(F.col(vector)).alias("u"))
    mean = mean_vector(unit, ["component_tech_id"], "u", "m")
    own = unit.groupBy("component_tech_id").agg(F.sum(dot(F.col("u"), F.col("u"))).alias("own"))
    rows = mean.join(own, "component_tech_id").withColumn("all", dot(F.col("m"), F.col("m")) * F.col("docs") * F.col("docs"))
    pairs = F.col("docs") * (F.col("docs") - 1)
    return rows.select("component_tech_id", F.when(F.col("docs") < 2, F.lit(1.0)).otherwise((F.col("all") - F.col("own")) / pairs).alias("mean_intra_cosine"))


def representative_titles(docs: DataFrame, n: int = 3, keys: tuple[str, ...] = ("year", "cluster_id"), title: str = "title") -> DataFrame:
    """(keys, place, doc_id, title, similarity): the documents nearest to their cluster's mean vector.

    Documents without a usable vector, or with one of another width than most, are none of them.
    """
    rows = docs.select("doc_id", *keys, F.col(title).alias("title"), usable_vector(docs, "embedding").alias("v")).where("v is not null")
    rows = rows.join(mean_vector(rows, list(keys), "v", "m").drop("docs"), list(keys)).where(F.size("v") == F.size("m"))
    rows = rows.withColumn("similarity", dot(F.col("v"), F.col("m")) / (norm(F.col("v")) * (norm(F.col("m")) + 1e-9) + 1e-9))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("similarity", 9)), "doc_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(*keys, "place", "doc_id", "title", "similarity")


def nearest_centroid(docs: DataFrame, cents: DataFrame) -> DataFrame:
    """(doc_id, nearest_cluster, similarity): the assignment step within each year.

    A year's centroids are one array, so every document finds its own in its row.
    """
    c = cents.groupBy("year").agg(F.collect_list(F.struct(F.col("cluster_id").alias("id"), "vector")).alias("cents"))
    rows = docs.select("doc_id", "year", "embedding").join(c, "year")
    near = F.array_max(F.transform("cents", lambda x: F.struct(F.round(cosine(F.col("embedding"), x["vector"]), 9).alias("similarity"), (-x["id"]).alias("minus")))).alias("b")
    return rows.select("doc_id", near).select("doc_id", (-F.col("b.minus")).alias("nearest_cluster"), "b.similarity")
