"""All queries of the engine, by name, and their SQL oracles in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmap.config import COMPONENT_STEPS, ELEMENT_STEPS, STOP_WORDS
from rillmap.functions import text as tx
from rillmap.functions import vectors as vec
from rillmap.operators import clustering, components, flows, graph, naming, pca, prep, tfidf, transitions
from rillmap.plans import progress
from rillmap.plans.papers import dated, papers, table
from rillmap.sources.payload import csv_text

STRICT = 0.35


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with a component fixed by rule, cluster_id modulo 4, so that SQL can follow."""
    return papers(spark, sf).withColumn("component_tech_id", F.expr("cluster_id % 4"))


def year_slice(spark, sf):
    return dated(spark, sf).select("doc_id", tx.year_slice(F.col("update_date")).alias("year"), tx.year_slice(F.col("title")).alias("title_year"))


def year_from_date(spark, sf):
    return prep.derive_year(dated(spark, sf)).select("doc_id", "year")


def year_filter_keep_unknown(spark, sf):
    rows = dated(spark, sf).withColumn("update_date", F.expr("case when doc_id % 7 = 0 then 'soon' else update_date end"))
    return prep.before_year(rows, 1999).select("doc_id", "year")


def year_filter_strict(spark, sf):
    rows = dated(spark, sf).withColumn("update_date", F.expr("case when doc_id % 7 = 0 then 'soon' else update_date end"))
    return prep.before_year(rows, 1999, drop_unknown=True).select("doc_id", "year")


def clean_nonempty(spark, sf):
    rows = dated(spark, sf).withColumns({"title": F.expr("case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then '' else title end"), "abstract": F.expr("case when doc_id % 5 in (0, 1, 2) then '' else abstract end")})
    return prep.clean_nonempty(rows).select("doc_id", "title", F.length("abstract").cast("long").alias("n"))


def keyword_any_substring(spark, sf):
    return prep.keyword_filter(dated(spark, sf)).select("doc_id", "title")


def keyword_regex(spark, sf):
    return prep.keyword_filter(dated(spark, sf), ("token *=", "PASSWORD"), regex=True).select("doc_id", "title")


def preprocess(spark, sf):
    return prep.preprocess(dated(spark, sf)).select("doc_id", "year")


def concat_text(spark, sf):
    return dated(spark, sf).select("doc_id", F.md5(tx.trimmed_text(["title", "abstract"])).alias("trimmed"), F.md5(tx.joined_text(["title", "abstract"])).alias("joined"))


def clean_text(spark, sf):
    return dated(spark, sf).select("doc_id", tx.clean_words(F.col("title"), ("the", "and")).alias("words"))


def embed_text_choice(spark, sf):
    rows = dated(spark, sf)
    return rows.select("doc_id", tx.pick_embed_text(rows).alias("text"), tx.base64_text(tx.pick_embed_text(rows)).alias("payload"))


def tokenize(spark, sf):
    return dated(spark, sf).select("doc_id", F.array_join(tx.tokens(F.col("title")), " ").alias("tokens"), F.size(tx.tokens(F.col("title"))).cast("long").alias("n"))


def ngrams(spark, sf):
    return tfidf.term_counts(dated(spark, sf), F.col("title"))


def prompt(spark, sf):
    rows = dated(spark, sf)
    return rows.select("doc_id", tx.shortened(F.col("title"), 20).alias("short"), tx.naming_prompt(tx.tokens(F.col("title")), F.array(F.col("title"))).alias("prompt"))


def json_props_scan(spark, sf):
    rows = table(spark, sf, "events").withColumn("p", F.expr("try_parse_json(props)"))
    return rows.select("event_id", F.expr("p is not null").alias("is_json"), F.expr("schema_of_variant(p) like 'OBJECT%'").alias("is_object"))


def json_lines_before(spark, sf):
    from rillmap.sources.jsonl import lines_before

    rows = dated(spark, sf).select(F.to_json(F.struct("doc_id", "update_date")).alias("value")).union(spark.createDataFrame([("",), ("{broken",), ("[1]",), ('{"update_date": "abcd"}',)], "value string"))
    return lines_before(rows, 1998).select(F.expr("variant_get(parsed, '$.doc_id', 'long')").alias("doc_id"), "year")


def cluster_counts(spark, sf):
    return _round(tfidf.cluster_counts(papers(spark, sf)), "ratio")


def doc_frequency_pruned(spark, sf):
    rows = papers(spark, sf)
    return tfidf.document_frequency(tfidf.term_counts(rows, F.col("title"), ["year"]), rows, ["year"])


def tfidf_doc_weights(spark, sf):
    rows = papers(spark, sf)
    tf = tfidf.term_counts(rows, F.col("title"), ["year"])
    return _round(tfidf.weights(tf, tfidf.document_frequency(tf, rows, ["year"]), ["year"]), "w")


def cluster_top_terms(spark, sf):
    return _round(tfidf.cluster_terms(papers(spark, sf), F.col("title")), "tfidf")


def global_keywords(spark, sf):
    return _round(tfidf.global_keywords(tfidf.cluster_terms(papers(spark, sf), F.col("title"))), "score")


def component_top_terms(spark, sf):
    return _round(tfidf.cluster_terms(_labelled(spark, sf), F.col("title"), (), "component_tech_id"), "tfidf")


def tfidf_diagnostics(spark, sf):
    rows = papers(spark, sf).withColumn("title", F.expr("case when year = 1997 then 'a of the' else title end"))
    return tfidf.diagnostics(rows, F.col("title"))


def _counted(spark, sf):
    return tfidf.counted(papers(spark, sf), F.col("title"))


def _moves(spark, sf, threshold=0.08, known=None):
    return transitions.transitions(papers(spark, sf), F.col("title"), threshold, known=known)


def transitions_default(spark, sf):
    return _round(_moves(spark, sf), "similarity")


def transitions_strict(spark, sf):
    return _round(_moves(spark, sf, STRICT), "similarity")


def _edges(spark, sf, threshold=STRICT, known=None):
    known = known or _counted(spark, sf)
    return transitions.flow_edges(_moves(spark, sf, threshold, known), known.sizes.withColumnRenamed("docs", "count"))


def flow_edges(spark, sf):
    return _round(_edges(spark, sf), "similarity", "yoy_docs")


def _panel(spark, sf, known=None):
    return flows.flow_panel(_edges(spark, sf, known=known))


def _flow_words(spark, sf):
    """The panel and its flows' keywords, from texts read once."""
    known = _counted(spark, sf)
    panel = _panel(spark, sf, known)
    return panel, flows.flow_keywords(panel, tfidf.cluster_terms(papers(spark, sf), F.col("title"), known=known))


def flow_panel(spark, sf):
    return _panel(spark, sf)


def flow_panel_recursive(spark, sf):
    return flows.flow_panel_recursive(_edges(spark, sf))


def flow_docs(spark, sf):
    return flows.flow_docs(_panel(spark, sf))


def top_flows(spark, sf):
    return flows.top_flows(_panel(spark, sf), 10)


def flow_keywords(spark, sf):
    return _round(_flow_words(spark, sf)[1], "score")


def cluster_titles(spark, sf):
    return flows.cluster_titles(papers(spark, sf))


def centroid_norms(spark, sf):
    rows = components.centroids(papers(spark, sf))
    return rows.select("year", "cluster_id", "docs", F.round(F.element_at("vector", 1), 6).alias("x1"), F.round(F.element_at("vector", 64), 6).alias("x64"))


def rep_titles_by_rank(spark, sf):
    return _round(components.representative_titles(papers(spark, sf)), "similarity")


def nearest_centroid(spark, sf):
    rows = papers(spark, sf)
    return _round(components.nearest_centroid(rows, components.centroids(rows)), "similarity")


def centroid_similarity(spark, sf):
    rows = components.centroids(papers(spark, sf)).select("year", "cluster_id", "vector")
    other = rows.select("year", F.col("cluster_id").alias("other_id"), F.col("vector").alias("w"))
    return rows.join(other, "year").where("cluster_id < other_id").select("year", "cluster_id", "other_id", F.round(vec.cosine(F.col("vector"), F.col("w")), 6).alias("similarity"))


def _meta(spark, sf):
    return components.centroids(papers(spark, sf)).withColumn("component_tech_id", F.expr("cluster_id % 4"))


def component_stats(spark, sf):
    return components.component_stats(_meta(spark, sf))


def component_density(spark, sf):
    return _round(components.component_density(_meta(spark, sf), "vector"), "mean_intra_cosine")


def doc_component_map(spark, sf):
    return components.map_documents(papers(spark, sf), _meta(spark, sf)).select("doc_id", "year", "orig_cluster_id", "component_tech_id")


def _documents(spark, sf):
    return doc_component_map(spark, sf)


def graph_edges_compat(spark, sf):
    return graph.edges_compat(_documents(spark, sf))


def graph_edges_corrected(spark, sf):
    return graph.edges_corrected(_documents(spark, sf), _panel(spark, sf))


def _names(spark, rows):
    return rows.select(F.col("id"), F.concat(F.lit("T"), "id").alias("tech_name_en"), F.expr("case when id % 2 = 0 then concat('K', id) end").alias("tech_name_ko"))


def _elements(spark, sf, panel):
    top = flows.top_flows(panel, 10).withColumnRenamed("flow_id", "id")
    return graph.nodes(_names(spark, top), top)


def _components(spark, sf):
    sizes = _documents(spark, sf).groupBy(F.col("component_tech_id").alias("id")).agg(F.count("*").alias("docs"))
    return graph.nodes(_names(spark, sizes.where("id < 3")), sizes)


def graph_pruned_edges(spark, sf):
    panel = _panel(spark, sf)
    return graph.pruned_edges(graph.edges_corrected(_documents(spark, sf), panel), _elements(spark, sf, panel), _components(spark, sf), 2, 3, 8)


def graph_nodes(spark, sf):
    panel = _panel(spark, sf)
    elements = _elements(spark, sf, panel)
    edges = graph.pruned_edges(graph.edges_corrected(_documents(spark, sf), panel), elements, _components(spark, sf), 2, 3, 8)
    return graph.connected_nodes(elements, edges, "from_element_id")


def names_offline(spark, sf):
    panel, words = _flow_words(spark, sf)
    top = flows.top_flows(panel, 10).withColumnRenamed("flow_id", "id")
    return naming.name_groups(top, words.withColumnRenamed("flow_id", "id"))


def name_alias_fields(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.create_map(F.lit("en_name"), F.col("n_name"), F.lit("why"), F.lit("x")).alias("m"))
    return rows.select("n_nationkey", *tx.normalized_names(F.col("m")))


def kmeans_labels(spark, sf):
    return clustering.cluster_years(papers(spark, sf), 10)


def pca_projection(spark, sf):
    return pca.pca_projection(papers(spark, sf))


def lsa_transitions(spark, sf):
    return transitions.lsa_transitions(papers(spark, sf), F.col("title"))


def component_grouping(spark, sf):
    docs, _ = components.group_components(papers(spark, sf), components.ComponentConfig(n_components=8))
    return docs.select("doc_id", "year", "orig_cluster_id", "component_tech_id")


def embedding_offline(spark, sf):
    from rillmap.operators.embedding import embed

    return embed(dated(spark, sf).select("doc_id", "title")).select("doc_id", "embedding")


def vector_parse(spark, sf):
    rows = papers(spark, sf).select("doc_id", vec.parse_vector(F.to_json("embedding")).alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("width"), F.round(vec.norm(F.col("v")), 4).alias("length"), F.round(vec.norm(vec.l2(F.col("v"))), 6).alias("unit_length"))


def _told(spark, sf):
    """Shares that runs (a document's source) have told of their steps, by a rule that SQL can follow."""
    names = F.array(*[F.lit(n) for n, _ in ELEMENT_STEPS + COMPONENT_STEPS], F.lit("no such step"))
    return table(spark, sf, "documents").select(F.col("source").alias("run"), F.get(names, F.expr("cast(doc_id % 12 as int)")).alias("step"), F.expr("(n_chars % 131) / 100.0D").alias("share"))


def progress_weights(spark, sf):
    return _round(progress.progress_of(_told(spark, sf)), "element", "component", "overall")


def eta_buckets(spark, sf):
    seconds = F.expr("case when doc_id % 9 = 0 then null else n_chars / 16.0D end")
    return table(spark, sf, "documents").select("doc_id", progress.eta_text(seconds).alias("said"))


def csv_payload(spark, sf):
    heads = papers(spark, sf).withColumn("head", F.substring("abstract", 1, 60))
    rows = flows.cluster_titles(heads, "head")
    return csv_text(rows.select("year", "cluster_id", "place", F.col("title").alias('title, "cut"')), F.col("year"), F.col("cluster_id"), F.col("place"))


# --- oracles -------------------------------------------------------------------------------------------------------

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower({{0}}), '[가-힣A-Za-z0-9]+'), lambda x: length(x) >= 2 and x not in ({_STOP}))"
_DATED = "dated AS (SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title, d.text AS abstract, strftime(o.o_orderdate, '%Y-%m-%d') AS update_date FROM documents d LEFT JOIN orders o ON d.doc_id = o.o_orderkey)"
_PAPERS = f"{_DATED}, papers AS (SELECT d.*, CAST(substr(update_date, 1, 4) AS INT) AS year, e.embedding, e.label AS cluster_id, e.label % 4 AS component_tech_id FROM dated d JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.update_date IS NOT NULL)"
_SLICE = "CASE WHEN regexp_full_match(substr({0}, 1, 4), '[0-9]{{1,4}}') THEN CAST(substr({0}, 1, 4) AS INT) ELSE -1 END"
_STEPS = ", ".join([f"('{n}', {w}::DOUBLE, 0.0::DOUBLE)" for n, w in ELEMENT_STEPS] + [f"('{n}', 0.0::DOUBLE, {w}::DOUBLE)" for n, w in COMPONENT_STEPS])
_STEP_NAMES = ", ".join(f"'{n}'" for n, _ in ELEMENT_STEPS + COMPONENT_STEPS)
_SOON = "CASE WHEN doc_id % 7 = 0 THEN 'soon' ELSE update_date END"


def _grams(source: str, scope: str, text: str = "title", name: str = "tf") -> str:
    s = f"{scope}, " if scope else ""
    return (
        f"{name}_tok AS (SELECT {s}doc_id, {_TOKENS.format(text)} AS t FROM {source}), "
        f"{name} AS (SELECT {s}doc_id, term, count(*) AS tf FROM (SELECT {s}doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {name}_tok) GROUP BY ALL)"
    )


def _vocabulary(source: str, scope: str, standard: bool = True) -> str:
    s = f"{scope}, " if scope else ""
    using = f"JOIN n USING ({scope})" if scope else "CROSS JOIN n"
    using2 = f"JOIN fits USING ({scope})" if scope else "CROSS JOIN fits"
    ok = "df >= CASE WHEN n < 20 THEN 1 ELSE 3 END AND df <= CASE WHEN n <= 20 THEN n ELSE 0.95 * n END" if standard else "df <= 0.95 * n"
    group = f"GROUP BY {scope}" if scope else ""
    return (
        f"n AS (SELECT {s}count(*) AS n FROM {source} {group}), terms AS (SELECT {s}term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf_sum FROM tf GROUP BY {s}term), "
        f"judged AS (SELECT terms.*, n, {ok} AS ok FROM terms {using}), fits AS (SELECT {s}bool_or(ok) AS any_ok FROM judged {group}), "
        f"vocabulary AS (SELECT {s}term, df, tf_sum, n FROM judged {using2} WHERE ok OR NOT any_ok)"
    )


def _weights(scope: str) -> str:
    s = f"{scope}, " if scope else ""
    return (
        f"raw AS (SELECT {s}doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS r FROM tf JOIN vocabulary USING ({s}term)), "
        f"weights AS (SELECT {s}doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY {s}doc_id)) AS w FROM raw)"
    )


def _profile(scope: str, cluster: str) -> str:
    s = f"{scope}, " if scope else ""
    return (
        f"size AS (SELECT {s}{cluster}, count(*) AS docs FROM papers GROUP BY ALL), "
        f"scored AS (SELECT {s}{cluster}, term, sum(w) / docs AS tfidf, docs FROM weights JOIN (SELECT {s}doc_id, {cluster} FROM papers) USING ({s}doc_id) JOIN size USING ({s}{cluster}) GROUP BY {s}{cluster}, term, docs), "
        f"profile AS (SELECT *, row_number() OVER (PARTITION BY {s}{cluster} ORDER BY round(tfidf, 9) DESC, term) AS rank FROM scored QUALIFY rank <= 30)"
    )


_TERMS = ", ".join([_PAPERS, _grams("papers", "year"), _vocabulary("papers", "year"), _weights("year")])
_PROFILE = f"{_TERMS}, {_profile('year', 'cluster_id')}"


def _moves_sql(threshold: float) -> str:
    return ", ".join([
        _PAPERS,
        "pairs AS (SELECT year AS year_from, lead(year) OVER (ORDER BY year) AS year_to FROM (SELECT DISTINCT year FROM papers) QUALIFY year_to IS NOT NULL)",
        "paired AS (SELECT year_from, year_to, 0 AS side, doc_id, cluster_id, title FROM papers JOIN pairs ON year = year_from UNION ALL SELECT year_from, year_to, 1, doc_id, cluster_id, title FROM papers JOIN pairs ON year = year_to)",
        _grams("paired", "year_from, year_to"), _vocabulary("paired", "year_from, year_to", standard=False), _weights("year_from, year_to"),
        "sums AS (SELECT year_from, year_to, side, cluster_id, term, sum(w) AS w FROM weights JOIN (SELECT year_from, year_to, doc_id, side, cluster_id FROM paired) USING (year_from, year_to, doc_id) GROUP BY ALL)",
        "norms AS (SELECT year_from, year_to, side, cluster_id, sqrt(sum(w * w)) AS norm FROM sums GROUP BY ALL)",
        "sims AS (SELECT a.year_from, a.year_to, a.cluster_id AS prev_id, b.cluster_id AS next_id, sum(a.w * b.w) AS dot FROM sums a JOIN sums b ON a.year_from = b.year_from AND a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY ALL)",
        "best AS (SELECT s.year_from, s.year_to, prev_id, next_id, round(dot / (p.norm * q.norm), 9) AS similarity FROM sims s JOIN norms p ON p.year_from = s.year_from AND p.side = 0 AND p.cluster_id = prev_id JOIN norms q ON q.year_from = s.year_from AND q.side = 1 AND q.cluster_id = next_id QUALIFY row_number() OVER (PARTITION BY s.year_from, prev_id ORDER BY similarity DESC, next_id) = 1)",
        f"moves AS (SELECT c.year_from, c.year_to, c.prev_id, CASE WHEN similarity >= {threshold} THEN next_id END AS next_id, CASE WHEN similarity >= {threshold} THEN similarity END AS similarity, coalesce(similarity >= {threshold}, false) AS matched FROM (SELECT DISTINCT year_from, year_to, cluster_id AS prev_id FROM paired WHERE side = 0) c LEFT JOIN best USING (year_from, year_to, prev_id))",
        "counts AS (SELECT year, cluster_id, count(*) AS count FROM papers GROUP BY ALL)",
        "edges AS (SELECT m.year_from, m.year_to, m.prev_id, m.next_id, similarity, a.count AS docs_from, b.count AS docs_to, (b.count - a.count) / a.count::DOUBLE AS yoy_docs FROM moves m JOIN counts a ON a.year = year_from AND a.cluster_id = prev_id JOIN counts b ON b.year = year_to AND b.cluster_id = next_id WHERE matched)",
    ])


_EDGES = _moves_sql(STRICT)
_PANEL = _EDGES + (
    ", numbered AS (SELECT year, cluster_id, CAST(row_number() OVER (ORDER BY year, cluster_id) - 1 AS INT) AS flow_id FROM (SELECT DISTINCT year_from AS year, prev_id AS cluster_id FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges t WHERE t.year_to = e.year_from AND t.next_id = e.prev_id)))"
    ", reach AS (SELECT flow_id, year, cluster_id FROM numbered UNION ALL SELECT r.flow_id, e.year_to, e.next_id FROM reach r JOIN edges e ON e.year_from = r.year AND e.prev_id = r.cluster_id)"
    ", panel AS (SELECT min(flow_id) AS flow_id, year, cluster_id, any_value(count) AS docs FROM reach JOIN counts USING (year, cluster_id) GROUP BY year, cluster_id)"
)
_FLOW_DOCS = _PANEL + ", flow_docs AS (SELECT flow_id, CAST(sum(docs) AS BIGINT) AS docs FROM panel GROUP BY 1), tops AS (SELECT * FROM flow_docs ORDER BY docs DESC, flow_id LIMIT 10)"
_UNIT = "units AS (SELECT doc_id, year, cluster_id, component_tech_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM papers)"
_CENTROIDS = f"{_PAPERS}, {_UNIT}, " + (
    "parts AS (SELECT year, cluster_id, pos, avg(x) AS x FROM (SELECT year, cluster_id, unnest(u) AS x, unnest(range(1, 65)) AS pos FROM units) GROUP BY ALL), "
    "means AS (SELECT year, cluster_id, list(x ORDER BY pos) AS m FROM parts GROUP BY ALL), "
    "centroids AS (SELECT year, cluster_id, cluster_id % 4 AS component_tech_id, docs, list_transform(m, lambda x: x / (sqrt(list_sum(list_transform(m, lambda y: y * y))) + 1e-12)) AS vector FROM means JOIN (SELECT year, cluster_id, count(*) AS docs FROM papers GROUP BY ALL) USING (year, cluster_id))"
)
_DOC_COMPONENTS = "SELECT doc_id, year, cluster_id AS orig_cluster_id, component_tech_id FROM papers"
_GRAPH = _FLOW_DOCS + (
    ", elements AS (SELECT flow_id AS id, 'T' || flow_id AS name_en, CASE WHEN flow_id % 2 = 0 THEN 'K' || flow_id ELSE '' END AS name_ko, docs FROM tops)"
    ", weighed AS (SELECT flow_id AS from_element_id, component_tech_id AS to_component_id, count(*) AS weight FROM papers JOIN (SELECT flow_id, year, cluster_id FROM panel) USING (year, cluster_id) GROUP BY ALL)"
    ", e1 AS (SELECT * FROM weighed WHERE weight >= 2 QUALIFY row_number() OVER (PARTITION BY from_element_id ORDER BY weight DESC, to_component_id) <= 3)"
    ", e2 AS (SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY to_component_id ORDER BY weight DESC, from_element_id) <= 8)"
    ", pruned AS (SELECT from_element_id, to_component_id, weight FROM e2 WHERE from_element_id IN (SELECT id FROM elements) AND to_component_id IN (SELECT component_tech_id FROM papers WHERE component_tech_id < 3))"
)


def oracle_sql() -> dict[str, str]:
    year = _SLICE.format("update_date")
    return {
        "year_slice": f"WITH {_DATED} SELECT doc_id, {year} AS year, {_SLICE.format('title')} AS title_year FROM dated",
        "year_from_date": f"WITH {_DATED} SELECT doc_id, CAST(substr(update_date, 1, 4) AS INT) AS year FROM dated",
        "year_filter_keep_unknown": f"WITH {_DATED}, x AS (SELECT doc_id, {_SOON} AS update_date FROM dated), y AS (SELECT doc_id, {year} AS year FROM x) SELECT * FROM y WHERE year < 1999",
        "year_filter_strict": f"WITH {_DATED}, x AS (SELECT doc_id, {_SOON} AS update_date FROM dated), y AS (SELECT doc_id, {year} AS year FROM x) SELECT * FROM y WHERE year < 1999 AND year >= 0",
        "clean_nonempty": f"WITH {_DATED}, x AS (SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN '' ELSE title END AS title, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN '' ELSE abstract END AS abstract FROM dated) SELECT doc_id, title, length(abstract) AS n FROM x WHERE length(title) > 0 OR length(abstract) > 0",
        "keyword_any_substring": f"WITH {_DATED} SELECT doc_id, title FROM dated WHERE " + " OR ".join(f"contains(lower(title || ' ' || abstract), '{k}')" for k in ("data", "algorithm", "software", "reality", "virtual", "augmented")),
        "keyword_regex": f"WITH {_DATED} SELECT doc_id, title FROM dated WHERE regexp_matches(title || ' ' || abstract, '(?i)token *=') OR regexp_matches(title || ' ' || abstract, '(?i)PASSWORD')",
        "preprocess": f"WITH {_DATED} SELECT doc_id, CAST(substr(update_date, 1, 4) AS INT) AS year FROM dated WHERE regexp_matches(lower(title || ' ' || abstract), 'data|algorithm|software|reality|virtual|augmented')",
        "concat_text": f"WITH {_DATED} SELECT doc_id, md5(trim(title || ' ' || abstract, ' ')) AS trimmed, md5(title || ' ' || abstract) AS joined FROM dated",
        "clean_text": f"WITH {_DATED} SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN ('the', 'and')), ' ') AS words FROM dated",
        "embed_text_choice": f"WITH {_DATED} SELECT doc_id, title AS text, base64(encode(title)) AS payload FROM dated",
        "tokenize": f"WITH {_DATED}, x AS (SELECT doc_id, {_TOKENS.format('title')} AS t FROM dated) SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n FROM x",
        "ngrams": f"WITH {_DATED}, {_grams('dated', '')} SELECT doc_id, term, tf FROM tf",
        "prompt": f"WITH {_DATED}, x AS (SELECT doc_id, title, {_TOKENS.format('title')} AS t FROM dated) SELECT doc_id, CASE WHEN length(title) > 20 THEN substr(title, 1, 20) || '…' ELSE title END AS short, 'Keywords: ' || array_to_string(t[1:40], ', ') || chr(10) || 'Titles: ' || CASE WHEN length(title) > 90 THEN substr(title, 1, 90) || '…' ELSE title END AS prompt FROM x",
        "json_props_scan": "SELECT event_id, json_valid(props) AS is_json, json_type(props) = 'OBJECT' AS is_object FROM events",
        "json_lines_before": f"WITH {_DATED} SELECT doc_id, {year} AS year FROM dated WHERE {year} >= 0 AND {year} < 1998",
        "cluster_counts": f"WITH {_PAPERS} SELECT year, cluster_id, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS ratio FROM papers GROUP BY year, cluster_id",
        "doc_frequency_pruned": f"WITH {_TERMS} SELECT year, term, df, tf_sum, n FROM vocabulary",
        "tfidf_doc_weights": f"WITH {_TERMS} SELECT year, doc_id, term, round(w, 6) AS w FROM weights",
        "cluster_top_terms": f"WITH {_PROFILE} SELECT year, cluster_id, term, round(tfidf, 6) AS tfidf, docs, CAST(rank AS INT) AS rank FROM profile",
        "global_keywords": f"WITH {_PROFILE}, x AS (SELECT term, sum(tfidf) AS score FROM profile GROUP BY 1 ORDER BY round(sum(tfidf), 9) DESC, term LIMIT 100) SELECT term, round(score, 6) AS score FROM x",
        "component_top_terms": "WITH " + ", ".join([_PAPERS, _grams("papers", ""), _vocabulary("papers", ""), _weights(""), _profile("", "component_tech_id")]) + " SELECT component_tech_id, term, round(tfidf, 6) AS tfidf, docs, CAST(rank AS INT) AS rank FROM profile",
        "tfidf_diagnostics": f"WITH {_PAPERS}, x AS (SELECT year, {_TOKENS.format('CASE WHEN year = 1997 THEN $$a of the$$ ELSE title END')} AS t FROM papers) SELECT year, CAST(NULL AS INT) AS cluster_id, '' AS term, 0.0::DOUBLE AS tfidf, 0::BIGINT AS docs, 'empty_vocabulary' AS reason, count(*) AS n FROM x GROUP BY year HAVING sum(len(t)) = 0",
        "transitions": f"WITH {_moves_sql(0.08)} SELECT year_from, year_to, prev_id, next_id, round(similarity, 6) AS similarity, matched FROM moves",
        "transitions_strict": f"WITH {_EDGES} SELECT year_from, year_to, prev_id, next_id, round(similarity, 6) AS similarity, matched FROM moves",
        "flow_edges": f"WITH {_EDGES} SELECT year_from, year_to, prev_id, next_id, round(similarity, 6) AS similarity, docs_from, docs_to, round(yoy_docs, 6) AS yoy_docs FROM edges",
        "flow_panel": f"WITH RECURSIVE {_PANEL} SELECT flow_id, year, cluster_id, docs FROM panel",
        "flow_panel_recursive": f"WITH RECURSIVE {_PANEL} SELECT flow_id, year, cluster_id, docs FROM panel",
        "flow_docs": f"WITH RECURSIVE {_FLOW_DOCS} SELECT * FROM flow_docs",
        "top_flows": f"WITH RECURSIVE {_FLOW_DOCS} SELECT * FROM tops",
        "flow_keywords": f"WITH RECURSIVE {_PANEL}, prof AS (WITH {_PROFILE} SELECT * FROM profile), x AS (SELECT flow_id, lower(term) AS term, sum(tfidf) AS score FROM prof JOIN (SELECT flow_id, year, cluster_id FROM panel) USING (year, cluster_id) GROUP BY ALL) SELECT flow_id, term, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY flow_id ORDER BY round(score, 9) DESC, term) AS INT) AS rank FROM x QUALIFY rank <= 60",
        "cluster_titles": f"WITH {_PAPERS}, x AS (SELECT year, cluster_id, CAST(row_number() OVER (PARTITION BY year, cluster_id ORDER BY doc_id) AS INT) AS place, title FROM papers) SELECT * FROM x WHERE place <= 2 ORDER BY year, cluster_id, place LIMIT 120",
        "centroid_norms": f"WITH {_CENTROIDS} SELECT year, cluster_id, docs, round(vector[1], 6) AS x1, round(vector[64], 6) AS x64 FROM centroids",
        "rep_titles_by_rank": f"WITH {_PAPERS}, p AS (SELECT year, cluster_id, pos, avg(x) AS x FROM (SELECT year, cluster_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS pos FROM papers) GROUP BY ALL), m AS (SELECT year, cluster_id, list(x ORDER BY pos) AS m FROM p GROUP BY ALL), s AS (SELECT year, cluster_id, doc_id, title, list_dot_product(embedding::DOUBLE[], m) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * (sqrt(list_dot_product(m, m)) + 1e-9) + 1e-9) AS similarity FROM papers JOIN m USING (year, cluster_id)) SELECT year, cluster_id, CAST(row_number() OVER (PARTITION BY year, cluster_id ORDER BY round(similarity, 9) DESC, doc_id) AS INT) AS place, doc_id, title, round(similarity, 6) AS similarity FROM s QUALIFY place <= 3",
        "nearest_centroid": f"WITH {_CENTROIDS}, s AS (SELECT p.doc_id, c.cluster_id AS nearest_cluster, round(list_cosine_similarity(p.embedding::DOUBLE[], c.vector), 9) AS similarity FROM papers p JOIN centroids c USING (year)) SELECT doc_id, nearest_cluster, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, nearest_cluster) = 1",
        "centroid_similarity": f"WITH {_CENTROIDS} SELECT a.year, a.cluster_id, b.cluster_id AS other_id, round(list_cosine_similarity(a.vector, b.vector), 6) AS similarity FROM centroids a JOIN centroids b ON a.year = b.year AND a.cluster_id < b.cluster_id",
        "component_stats": f"WITH {_PAPERS}, c AS (SELECT year, cluster_id, component_tech_id, count(*) AS docs FROM papers GROUP BY ALL) SELECT component_tech_id, count(DISTINCT year) AS n_years, count(DISTINCT cluster_id) AS n_orig_clusters, CAST(sum(docs) AS BIGINT) AS docs FROM c GROUP BY 1",
        "component_density": f"WITH {_CENTROIDS}, k AS (SELECT *, row_number() OVER (ORDER BY year, cluster_id) AS k FROM centroids), s AS (SELECT a.component_tech_id, avg(list_cosine_similarity(a.vector, b.vector)) AS s FROM k a JOIN k b ON a.component_tech_id = b.component_tech_id AND a.k < b.k GROUP BY 1) SELECT c.component_tech_id, round(coalesce(s, 1.0), 6) AS mean_intra_cosine FROM (SELECT DISTINCT component_tech_id FROM k) c LEFT JOIN s USING (component_tech_id)",
        "doc_component_map": f"WITH {_PAPERS} {_DOC_COMPONENTS}",
        "graph_edges_compat": f"WITH {_PAPERS} SELECT cluster_id AS from_element_id, component_tech_id AS to_component_id, count(*) AS weight FROM papers GROUP BY ALL",
        "graph_edges_corrected": f"WITH RECURSIVE {_GRAPH} SELECT * FROM weighed",
        "graph_pruned_edges": f"WITH RECURSIVE {_GRAPH} SELECT * FROM pruned",
        "graph_nodes": f"WITH RECURSIVE {_GRAPH} SELECT id, name_en, name_ko, docs FROM elements WHERE id IN (SELECT from_element_id FROM pruned)",
        "name_alias_fields": "SELECT n_nationkey, '' AS tech_name_ko, n_name AS tech_name_en, '' AS purpose, '' AS method, '' AS novelty, 'x' AS rationale FROM nation",
        "vector_parse": f"WITH {_PAPERS} SELECT doc_id, len(embedding) AS width, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 4) AS length, 1.0 AS unit_length FROM papers",
        "progress_weights": f"WITH w AS (SELECT * FROM (VALUES {_STEPS}) v(step, element, component)), t AS (SELECT source AS run, ([{_STEP_NAMES}, 'no such step'])[doc_id % 12 + 1] AS step, (n_chars % 131) / 100.0::DOUBLE AS share FROM documents), s AS (SELECT run, step, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(max(share), 0.0::DOUBLE))) AS share FROM t GROUP BY ALL), p AS (SELECT run, coalesce(sum(share * element), 0.0) AS element, coalesce(sum(share * component), 0.0) AS component FROM s LEFT JOIN w USING (step) GROUP BY run) SELECT run, round(element, 6) AS element, round(component, 6) AS component, round(0.85 * element + 0.15 * component, 6) AS overall FROM p",
        "eta_buckets": "SELECT doc_id, CASE WHEN s IS NULL THEN '예상 소요 시간: 계산 중' WHEN s < 1 THEN '예상 소요 시간: 거의 완료' WHEN s < 60 THEN '예상 소요 시간: ' || CAST(floor(s) AS BIGINT) || '초' ELSE '예상 소요 시간: ' || printf('%.1f', s / 60) || '분' END AS said FROM (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN n_chars / 16.0::DOUBLE END AS s FROM documents)",
        "csv_payload": f"WITH {_PAPERS}, x AS (SELECT year, cluster_id, row_number() OVER (PARTITION BY year, cluster_id ORDER BY doc_id) AS place, substr(abstract, 1, 60) AS title FROM papers), y AS (SELECT * FROM x WHERE place <= 2 ORDER BY year, cluster_id, place LIMIT 120), z AS (SELECT 'year,cluster_id,place,' || $$\"title, \"\"cut\"\"\"$$ || chr(10) || string_agg(year || ',' || cluster_id || ',' || place || ',' || CASE WHEN regexp_matches(title, '[,\"\r\n]') THEN '\"' || replace(title, '\"', '\"\"') || '\"' ELSE title END || chr(10), '' ORDER BY year, cluster_id, place) AS csv_text FROM y) SELECT csv_text, base64(encode(csv_text)) AS content FROM z",
    }


_OWN = (
    year_slice, year_from_date, year_filter_keep_unknown, year_filter_strict, clean_nonempty, keyword_any_substring, keyword_regex, preprocess, concat_text, clean_text, embed_text_choice,
    tokenize, ngrams, prompt, json_props_scan, json_lines_before, cluster_counts, doc_frequency_pruned, tfidf_doc_weights, cluster_top_terms, global_keywords, component_top_terms,
    tfidf_diagnostics, transitions_strict, flow_edges, flow_panel, flow_panel_recursive, flow_docs, top_flows, flow_keywords, cluster_titles, centroid_norms, rep_titles_by_rank, nearest_centroid,
    centroid_similarity, component_stats, component_density, doc_component_map, graph_edges_compat, graph_edges_corrected, graph_pruned_edges, graph_nodes, names_offline,
    name_alias_fields, kmeans_labels, pca_projection, lsa_transitions, component_grouping, embedding_offline, vector_parse, progress_weights, eta_buckets, csv_payload,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OWN} | {"transitions": transitions_default}
