"""Settings and fixed values of the technology-flow engine."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal those of the engine whose results are matched.
KEYWORDS = ("data", "algorithm", "software", "reality", "virtual", "augmented")
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "have", "has", "had", "but", "not", "you",
    "your", "our", "their", "its", "it's", "they", "them", "his", "her", "she", "him", "who", "what", "when", "where", "how",
    "why", "can", "could", "would", "should", "a", "an", "of", "to", "in", "on", "at", "by", "as", "is", "be", "or", "if", "we",
    "et", "al", "via", "using", "use", "based", "into", "over", "under", "per", "also", "may", "might", "than", "then", "out",
    "up", "down", "new", "more", "most", "less", "least", "such", "these", "those", "each", "other",
)
TOKEN_PATTERN = "[가-힣A-Za-z0-9]+"
YEAR_COLUMNS = ("update_date", "published", "fetch_month")
EMBED_TEXT_COLUMNS = ("title", "abstract", "summary", "text", "description")
TITLE_COLUMNS = ("title", "paper_title", "doc_title", "name", "subject", "headline")
JSON_ROOTS = ("data", "items", "records", "rows", "result")
NAME_KEYS = ("tech_name_ko", "tech_name_en", "purpose", "method", "novelty", "rationale")
NAME_ALIASES = {
    "tech_name_ko": ("ko_name", "kr_name", "name_ko"), "tech_name_en": ("en_name", "name_en"), "purpose": ("summary",),
    "method": ("approach",), "novelty": ("innovation",), "rationale": ("justification", "why"),
}
ELEMENT_STEPS = (("upload", 0.05), ("load", 0.05), ("year_filter", 0.10), ("preprocess", 0.20), ("embedding", 0.35), ("clustering", 0.15), ("tech_naming", 0.10))
COMPONENT_STEPS = (("component_grouping", 0.30), ("component_naming", 0.30), ("component_result", 0.10), ("visualize", 0.30))
ELEMENT_SHARE, COMPONENT_SHARE = 0.85, 0.15
TERMS_PER_CLUSTER, TERMS_PER_FLOW, KEYWORDS_OVERALL, TITLES_OVERALL = 30, 60, 100, 120
MATCH_THRESHOLD = 0.08


@dataclass(frozen=True)
class EngineConfig:
    """What a run may change."""

    cutoff_year: int = 2026
    n_clusters: int = 100
    n_components: int = 100
    top_flows: int = 100
    keywords: tuple[str, ...] = KEYWORDS
    match_threshold: float = MATCH_THRESHOLD
    seed: int = 42
    min_edge_weight: int = 1
    edges_per_element: int | None = 3
    edges_per_component: int | None = None
    drop_unknown_year: bool = False
    batch_size: int = 512
