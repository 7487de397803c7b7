"""Matching of clusters between successive years."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmap.config import MATCH_THRESHOLD
from rillmap.operators.lineage import cut
from rillmap.operators.lsa import best_matches, latent_centroids, latent_rows
from rillmap.operators.tfidf import Counted, counted, weights


def year_pairs(docs: DataFrame) -> DataFrame:
    """(year_from, year_to): each distinct year and the next one that is present."""
    years = docs.select("year").where("year is not null").distinct()
    return years.select(F.col("year").alias("year_from"), F.lead("year").over(Window.partitionBy(F.lit(1)).orderBy("year")).alias("year_to")).where("year_to is not null")


def _matched(sims: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """The best next cluster of every cluster, ties to the smaller id; unmatched ones keep a row with nulls."""
    best = Window.partitionBy("year_from", "year_to", "prev_id").orderBy(F.desc("similarity"), "next_id")
    top = sims.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
    rows = clusters.join(top, ["year_from", "year_to", "prev_id"], "left")
    ok = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    return rows.select("year_from", "year_to", "prev_id", F.when(ok, F.col("next_id")).alias("next_id"), F.when(ok, F.col("similarity")).alias("similarity"), ok.alias("matched"))


def _sided(years: list[int]) -> list[tuple[int, int, int, int]]:
    """(year, year_from, year_to, side): the one or two pairs of successive years that hold a year."""
    pairs = list(zip(years, years[1:], strict=False))
    return [(p[side], *p, side) for p in pairs for side in (0, 1)]


@dataclass
class PairWeights:
    """TF-IDF of the documents of all pairs of successive years, fitted on both years of a pair."""

    #: (year_from, year_to, key, side, cluster_id, term, w)
    w: DataFrame
    #: (year_from, year_to, prev_id): the clusters of each pair's first year.
    clusters: DataFrame
    #: Documents of each pair, by its first year.
    sizes: dict[int, int]


def pair_weights(docs: DataFrame, text: Column, key: str = "doc_id", known: Counted | None = None) -> PairWeights:
    """Texts are read and tokenised once, into a table of (document, term): a pair's document frequencies are the sums
    of its years', and documents meet their one or two pairs as counts."""
    spark, scope = docs.sparkSession, ["year_from", "year_to"]
    known = known or counted(docs.where("year is not null"), text, key)
    sizes, tf = (x.where("year is not null") for x in (known.sizes, known.tf))
    by_year = {r.year: r.docs for r in sizes.groupBy("year").agg(F.sum("docs").alias("docs")).collect()}
    years = sorted(by_year)
    kind = docs.schema["year"].dataType.simpleString()
    sided = spark.createDataFrame(_sided(years), f"year {kind}, year_from {kind}, year_to {kind}, side int")
    n = sizes.join(sided, "year").groupBy(*scope).agg(F.sum("docs").alias("n"))
    df = tf.groupBy("year", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf_sum"))
    df = df.join(sided, "year").groupBy(*scope, "term").agg(F.sum("df").alias("df"), F.sum("tf_sum").alias("tf_sum")).join(n, scope)
    # as in document_frequency without its standard pruning: a pair that would keep no term keeps all
    df = df.withColumn("fits", F.col("df") <= F.col("n") * 0.95)
    vocabulary = df.join(df.groupBy(*scope).agg(F.bool_or("fits").alias("any_fits")), scope).where("fits or not any_fits").select(*scope, "term", "df", "tf_sum", "n")
    w = weights(tf.join(sided, "year"), vocabulary, scope, key, carry=["side", "cluster_id"])
    clusters = sizes.join(sided, "year").where("side = 0").select(*scope, F.col("cluster_id").alias("prev_id"))
    return PairWeights(w, clusters, {a: by_year[a] + by_year[b] for a, b in zip(years, years[1:], strict=False)})


def transitions(docs: DataFrame, text: Column, threshold: float = MATCH_THRESHOLD, key: str = "doc_id", known: Counted | None = None) -> DataFrame:
    """(year_from, year_to, prev_id, next_id, similarity, matched) by the exact cosine of joint TF-IDF centroids.

    Terms are fitted on both years of a pair. Centroids meet on their terms, so only clusters that share one are
    compared; all year pairs run at once.
    """
    scope, pairs = ["year_from", "year_to"], pair_weights(docs, text, key, known)
    sums = pairs.w.groupBy(*scope, "side", "cluster_id", "term").agg(F.sum("w").alias("w"))
    unit = cut(sums.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*scope, "side", "cluster_id")))))
    prev = unit.where("side = 0").select(*scope, F.col("cluster_id").alias("prev_id"), "term", F.col("w").alias("a"))
    following = unit.where("side = 1").select(*scope, F.col("cluster_id").alias("next_id"), "term", F.col("w").alias("b"))
    sims = prev.join(following, [*scope, "term"]).groupBy(*scope, "prev_id", "next_id").agg(F.round(F.sum(F.col("a") * F.col("b")), 9).alias("similarity"))
    return _matched(sims, pairs.clusters, threshold)


def lsa_transitions(docs: DataFrame, text: Column, threshold: float = MATCH_THRESHOLD, most: int = 256, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """The same rows by cosine of cluster means in a truncated singular space of each pair of years, `most` wide at most.

    All pairs go through one randomised block decomposition (`lsa.latent_rows`); cluster means are compared in tiles.
    Documents without a term of the pair's vocabulary have no row there, which changes no direction of a mean.
    """
    scope, pairs = ["year_from", "year_to"], pair_weights(docs, text, key)
    w = cut(pairs.w.select(F.col("year_from").cast("int").alias("p"), F.struct("side", F.col(key).alias("id")).alias("doc"), "side", F.col("cluster_id").cast("int").alias("cluster"), "term", "w"))
    rows, blocks = latent_rows(w, pairs.sizes, most, seed)
    means = cut(latent_centroids(rows, blocks, w.select("p", "doc", "side", "cluster").distinct()))
    before, after = (means.where(F.col("side") == side).select("p", F.col("cluster").alias("id"), "vector") for side in (0, 1))
    sims = best_matches(before, after).join(pairs.clusters.select(*scope).distinct().withColumn("p", F.col("year_from").cast("int")), "p")
    return _matched(sims.select(*scope, "prev_id", "next_id", "similarity"), pairs.clusters, threshold)


def flow_edges(moves: DataFrame, counts: DataFrame) -> DataFrame:
    """Matched transitions with both clusters' documents and their relative change (null from none)."""
    a = counts.select(F.col("year").alias("year_from"), F.col("cluster_id").alias("prev_id"), F.col("count").alias("docs_from"))
    b = counts.select(F.col("year").alias("year_to"), F.col("cluster_id").alias("next_id"), F.col("count").alias("docs_to"))
    rows = moves.where("matched").join(a, ["year_from", "prev_id"]).join(b, ["year_to", "next_id"])
    return rows.select("year_from", "year_to", "prev_id", "next_id", "similarity", "docs_from", "docs_to", F.try_divide(F.col("docs_to") - F.col("docs_from"), F.col("docs_from")).alias("yoy_docs"))
