"""The whole run: from a file of papers to a graph of flows and components."""

from __future__ import annotations

import json
import traceback
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rillmap.config import EngineConfig
from rillmap.functions.text import joined_text, pick_text_columns
from rillmap.operators import clustering, components, embedding, flows, graph, naming, prep, tfidf, transitions
from rillmap.plans.progress import RunState
from rillmap.sources.loader import load_table
from rillmap.sources.payload import csv_file

#: Seconds between two looks at a running step.
POLL = 1.0


@dataclass
class ClusterResult:
    """What clustering finds, as lazy tables with a year column."""

    docs: DataFrame
    counts: DataFrame
    terms: DataFrame
    moves: DataFrame
    edges: DataFrame
    keywords: DataFrame
    titles: DataFrame
    #: (year, status, docs): clustered, left out for its vector, or a year's error.
    report: DataFrame


def run_clustering(docs: DataFrame, cfg: EngineConfig = EngineConfig(), text_cols: list[str] | None = None, labelled: bool = False) -> ClusterResult:
    """Clusters of each year, their terms, and how they pass into each other; `labelled` uses a given cluster_id.

    Rows that share a doc_id are documents each: terms are counted by row, not by id.
    """
    if labelled:
        report = docs.groupBy(F.col("year").cast("int").alias("year"), F.lit("clustered").alias("status")).agg(F.count("*").alias("docs"))
    else:
        found = clustering.fit_years(docs, cfg.n_clusters, cfg.seed)
        docs, report = found.docs, found.report
    docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
    rows = docs.withColumn("row_id", F.monotonically_increasing_id())  # it need hold within one table of terms alone
    own = pick_text_columns(docs, text_cols)
    text = joined_text(own)
    counts = tfidf.cluster_counts(docs)
    terms = tfidf.cluster_terms(rows, text, key="row_id").persist(StorageLevel.MEMORY_AND_DISK)
    moves = transitions.transitions(rows, text, cfg.match_threshold, key="row_id").persist(StorageLevel.MEMORY_AND_DISK)
    return ClusterResult(docs, counts, terms, moves, transitions.flow_edges(moves, counts), tfidf.global_keywords(terms), flows.cluster_titles(docs, own[0]), report)


def materialised(df: DataFrame, **counts: Column) -> dict:
    """Fills the cache of a persisted `df` in one job, and what was observed on the way: rows, and `counts`."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items()))
    observed.write.format("noop").mode("overwrite").save()
    return seen.get


# The files that callers of the old engine look for.
FLOW_NAMES, COMPONENT_NAMES = "names_generated_flowagg.csv", "component_tech_names.csv"


def largest(nodes: DataFrame, n: int = 10) -> list[dict]:
    return [r.asDict() for r in nodes.orderBy(F.desc("docs"), "id").limit(n).collect()]


class Pipeline:
    """Progress events as dictionaries, one for each step; the last good one carries the graph. Results stay on `self`."""

    def __init__(self, spark: SparkSession, cfg: EngineConfig = EngineConfig(), encoder=None, provider=None, checkpoint: str | None = None):
        self.spark, self.cfg, self.encoder, self.provider, self.checkpoint = spark, cfg, encoder, provider, checkpoint
        self.state = RunState()

    def lines(self, path: str) -> Iterator[str]:
        """The events as newline-delimited JSON."""
        for event in self.run(path):
            yield json.dumps(event, ensure_ascii=False) + "\n"

    def run(self, path: str) -> Iterator[dict]:
        try:
            yield from self._steps(path)
        except Exception:
            yield {"type": "error", "step_progress": -1, "error": traceback.format_exc()[-1000:]}
        finally:
            yield {"type": "stream-close", "step_progress": -2}

    def _done(self, phase: str, step: str, **meta) -> dict:
        self.state.begin(phase, step)
        return self.state.heartbeat(1.0, 0, meta)

    def _watched(self, phase: str, step: str, action):
        """Runs the action's Spark jobs in a thread; every POLL seconds an event with the share of their tasks done.

        Tasks become known stage by stage, so the share of the known ones can fall; what is told never does.
        """
        self.state.begin(phase, step)
        context, group = self.spark.sparkContext, f"{step}-{uuid.uuid4().hex}"

        def run():
            context.setJobGroup(group, step)
            return action()

        share = self.state.progress.done.get(step, 0.0)  # a step may be watched in parts
        with ThreadPoolExecutor(1) as pool:
            work = pool.submit(run)
            while not wait([work], timeout=POLL).done:
                done, total = self._tasks(group)
                if total:
                    share = max(share, min(0.99, done / total))
                    yield self.state.heartbeat(share, self.state.timer.eta_seconds(done, total))
        return work.result()

    def _tasks(self, group: str) -> tuple[int, int]:
        """(finished, known) tasks of a job group."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def _steps(self, path: str) -> Iterator[dict]:
        cfg = self.cfg
        yield self._done("element", "upload")
        df, facts = yield from self._watched("element", "load", lambda: load_table(self.spark, path))
        malformed = facts.pop("malformed", None)
        yield self._done("element", "load", **facts)
        df = prep.before_year(df, cfg.cutoff_year, cfg.drop_unknown_year)
        yield self._done("element", "year_filter")
        if "doc_id" not in df.columns:
            df = df.withColumn("doc_id", F.monotonically_increasing_id())
        df = df.transform(prep.clean_nonempty).transform(prep.keyword_filter, cfg.keywords).persist(StorageLevel.MEMORY_AND_DISK)
        seen = yield from self._watched("element", "preprocess", lambda: materialised(df))
        yield self._done("element", "preprocess", rows_after_filter=seen["rows"], **(malformed.get if malformed else {}))
        self.embedded = embedding.embed(df, self.encoder, self.checkpoint, batch_size=cfg.batch_size).persist(StorageLevel.MEMORY_AND_DISK)
        seen = yield from self._watched("element", "embedding", lambda: materialised(self.embedded, without_vector=F.count_if(F.col("embedding").isNull())))
        yield self._done("element", "embedding", **seen)
        self.clusters = yield from self._watched("element", "clustering", lambda: run_clustering(self.embedded, cfg))
        keywords, titles, report = yield from self._watched("element", "clustering", lambda: [x.collect() for x in (self.clusters.keywords, self.clusters.titles, self.clusters.report)])
        left = [r.asDict() for r in report if r.status != "clustered"]
        yield self._done("element", "clustering", keywords=[r.term for r in keywords], titles=[r.title for r in titles], left_out=left)
        elements, file, first = yield from self._watched("element", "tech_naming", self._name_flows)
        yield {**self._done("element", "tech_naming", elements=first), "files": [file]}
        docs, self.meta = yield from self._watched("component", "component_grouping", self._group)
        self.documents = docs.persist(StorageLevel.MEMORY_AND_DISK)
        yield self._done("component", "component_grouping")
        parts, file, first = yield from self._watched("component", "component_naming", self._name_components)
        yield self._done("component", "component_naming", components=first)
        yield {**self._done("component", "component_result"), "files": [file]}
        payload = yield from self._watched("component", "visualize", lambda: self._graph(elements, parts))
        yield {**self._done("component", "visualize"), **payload}

    def _name_flows(self) -> tuple[DataFrame, dict, list[dict]]:
        """(element nodes, the names as a file, the ten largest)."""
        self.panel = flows.flow_panel(self.clusters.edges).persist(StorageLevel.MEMORY_AND_DISK)
        top = flows.top_flows(self.panel, self.cfg.top_flows).withColumnRenamed("flow_id", "id")
        words = flows.flow_keywords(self.panel, self.clusters.terms).withColumnRenamed("flow_id", "id")
        self.names = naming.name_groups(top, words, self.provider).persist(StorageLevel.MEMORY_AND_DISK)
        nodes = graph.nodes(self.names, top)
        return nodes, csv_file(self.names.withColumnRenamed("id", "flow_id"), FLOW_NAMES, F.col("flow_id")), largest(nodes)

    def _group(self) -> tuple[DataFrame, DataFrame]:
        return components.group_components(self.clusters.docs, components.ComponentConfig(n_components=self.cfg.n_components, seed=self.cfg.seed))

    def _name_components(self) -> tuple[DataFrame, dict, list[dict]]:
        """(component nodes, the names as a file, the ten largest)."""
        rows = self.documents.withColumn("row_id", F.monotonically_increasing_id())
        terms = tfidf.cluster_terms(rows, joined_text(pick_text_columns(self.documents)), (), "component_tech_id", key="row_id").withColumnRenamed("component_tech_id", "id")
        sizes = self.documents.groupBy(F.col("component_tech_id").alias("id")).agg(F.count("*").alias("docs"))
        self.component_names = naming.name_groups(sizes, terms, self.provider).persist(StorageLevel.MEMORY_AND_DISK)
        nodes = graph.nodes(self.component_names, sizes)
        file = csv_file(self.component_names.join(sizes, "id").withColumnRenamed("id", "component_tech_id").select("component_tech_id", *self.component_names.columns[1:], "docs"), COMPONENT_NAMES, -F.col("docs"), F.col("component_tech_id"))
        return nodes, file, largest(nodes)

    def _graph(self, elements: DataFrame, parts: DataFrame) -> dict[str, list[dict]]:
        cfg = self.cfg
        edges = graph.edges_corrected(self.documents, self.panel)
        self.edges = graph.pruned_edges(edges, elements, parts, cfg.min_edge_weight, cfg.edges_per_element, cfg.edges_per_component).persist(StorageLevel.MEMORY_AND_DISK)
        self.elements = graph.connected_nodes(elements, self.edges, "from_element_id")
        self.components = graph.connected_nodes(parts, self.edges, "to_component_id")
        return {k: [r.asDict() for r in v.collect()] for k, v in (("elements", self.elements), ("components", self.components), ("edges", self.edges))}
