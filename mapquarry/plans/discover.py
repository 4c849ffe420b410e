"""One discovery request as a plan: hard filters, weighted contributions, union filter, ranking."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import Box
from ..functions.similarity import contains_score
from ..operators import retrieve as R
from ..operators.tables import materialise
from .catalog import Catalog

# Default weights of the dimensions.
WEIGHTS = {"Topic": 0.3, "Format": 0.1, "License": 0.1, "Organization": 0.1, "Space": 0.2, "Time": 0.2}
TOP = 20


@dataclass
class Parameters:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    similarity: float = 0.5
    confidence: float = 0.5
    portals: dict[str, bool] | None = None
    portal_ids: dict[str, str] = field(default_factory=lambda: dict(R.PORTALS))
    keyword_search: bool = True
    vector_top: int = 50

    def normalised(self) -> dict[str, float]:
        total = sum(self.weights.values())
        return {k: v / total for k, v in self.weights.items()} if math.isfinite(total) and total > 0 else dict(WEIGHTS)

    def check(self) -> None:
        if any(not math.isfinite(w) or w <= 0 for w in self.weights.values()):
            raise ValueError("weights must be positive and finite")
        if not 0.4 <= self.similarity <= 1 or not 0.3 <= self.confidence <= 0.9:
            raise ValueError("similarity must be in [0.4, 1] and confidence in [0.3, 0.9]")


@dataclass
class Intent:
    """Text by dimension, a box, a closed span, sources, vectors of the texts; what isn't set doesn't constrain."""

    text: dict[str, str] = field(default_factory=dict)
    box: Box | None = None
    span: tuple[str, str] | None = None
    sources: list[str] = field(default_factory=list)
    vectors: dict[str, list[float]] = field(default_factory=dict)


FLAGSHIP = Intent({"Topic": "widget"}, (-80.0, 20.0, 40.0, 60.0), ("19970101 00:00:00", "19981231 23:59:59"))


def candidates(nodes: DataFrame, q: str, threshold: float, label: str = "Topic", vector: list[float] | None = None, k: int = 50) -> DataFrame:
    """Entities whose searched property holds the text with a score over the threshold: (id, score).

    With a vector and embedded nodes, the nearest ones join them; the greater score of an entity counts.
    """
    by_name = nodes.select("id", F.round(contains_score(R.searched(nodes, label), q), 6).alias("score")).where(F.col("score") > threshold)
    if vector is None or "embedding" not in nodes.columns:
        return by_name
    both = by_name.unionByName(R.vector_candidates(nodes, vector, k, threshold))
    return both.groupBy("id").agg(F.max("score").alias("score"))


def text_contributions(catalog: Catalog, intent: Intent, p: Parameters, hard: DataFrame | None) -> tuple[DataFrame | None, list[DataFrame]]:
    """(dataset_id, dim, contribution) of datasets linked to any candidate, null where only unscored entities link it; and the candidates."""
    w = p.normalised()
    nodes = {
        "Topic": (catalog.topic, catalog.has_topic), "Keyword": (catalog.keyword, catalog.has_keyword), "License": (catalog.license, catalog.has_license),
        "Organization": (catalog.organization, catalog.published_by), "Format": (catalog.format, None),
    }
    out, every = None, []
    for dim, q in intent.text.items():
        links = None
        for kind in ("Topic", "Keyword") if dim == "Topic" and p.keyword_search else (dim,):
            table, edges = nodes[kind]
            found = candidates(table, q, p.similarity, kind, intent.vectors.get(dim), p.vector_top)
            every.append(found)
            best = R.selection(found, R.SCORED[kind]).select("id", F.lit(True).alias("used"))
            chosen = found.join(best, "id", "left")
            got = R.expand_formats(catalog.has_resource, catalog.has_format, chosen, hard) if kind == "Format" else R.expand(edges, chosen, hard)
            got = got.select("dataset_id", F.when(F.col("used"), F.col("score")).alias("score"))
            links = got if links is None else links.unionByName(got)
        part = links.groupBy("dataset_id").agg((F.max("score") * w[dim]).alias("contribution")).select("dataset_id", F.lit(dim).alias("dim"), "contribution")
        out = part if out is None else out.unionByName(part)
    return out, every


#: What a dataset whose text holds the topic counts where no entity scores one.
RESCUE = 0.1


@dataclass
class Scored:
    """Weighted contributions of all dimensions, the datasets that selected entities link (None: none were asked for), the hard set."""

    rows: DataFrame | None
    linked: DataFrame | None
    hard: DataFrame | None


def contributions(catalog: Catalog, intent: Intent, p: Parameters) -> Scored:
    """Text first; where no entity scores a dataset, those whose text holds the topic; then space and time of these and the hard set.

    Text contributions are written, so that each expansion runs once. ``linked`` is None where no entity was
    selected, and has no rows where none of the selected has a dataset.
    """
    if unknown := set(intent.text) - set(WEIGHTS) | set(intent.text) & {"Space", "Time"}:
        raise ValueError(f"no text search in {', '.join(sorted(unknown))}: keywords go with Topic, sources are ids in sources")
    w = p.normalised()
    hard = R.hard_filter(catalog.space, catalog.time, intent.box, intent.span)
    sources = sorted({*intent.sources, *(R.portal_sources(p.portals, p.portal_ids) or [])})
    if sources:
        chosen = R.source_filter(catalog.provides, sources)
        hard = chosen if hard is None else hard.join(chosen, "dataset_id", "left_semi")
    text, selected = text_contributions(catalog, intent, p, hard)
    linked = None
    if text is not None:
        text = materialise(text)
        if not text.isEmpty() or any(not found.isEmpty() for found in selected):
            linked = text.select("dataset_id").distinct()
        text = text.where("contribution is not null")
    if (text is None or text.isEmpty()) and intent.text.get("Topic"):
        hits = R.text_hits(catalog.dataset, intent.text["Topic"], 150, catalog.has_keyword if p.keyword_search else None)
        hits = hits.join(hard, "dataset_id", "left_semi") if hard is not None else hits
        text = materialise(hits.select("dataset_id", F.lit("Topic").alias("dim"), F.lit(RESCUE).alias("contribution")))
    ids = text.select("dataset_id").distinct() if text is not None else None
    if hard is not None:
        ids = hard if ids is None else ids.unionByName(hard).distinct()
    parts = [] if text is None else [text]
    if intent.box and ids is not None:
        parts.append(R.space_contribution(catalog.space, ids, intent.box, w["Space"]))
    if intent.span and ids is not None:
        parts.append(R.time_contribution(catalog.time, ids, intent.span, w["Time"]))
    return Scored(reduce(DataFrame.unionByName, parts) if parts else None, linked, hard)


def discover(catalog: Catalog, intent: Intent, parameters: Parameters | None = None, top: int = TOP) -> DataFrame:
    """Ranked datasets (dataset_id, score, rank), ties at the last rank kept.

    Scores are shares of the best sum over all scored datasets, taken before datasets without a
    selected entity are dropped; scoring uses the first entities of a dimension, the drop all, and where no
    entity was selected nothing is dropped. Where no entity scores, datasets whose text holds the topic count 0.1 each
    beside their space and time; where nothing scores at all, the hard set counts 1.0 each.
    """
    p = parameters or Parameters()
    p.check()
    found = contributions(catalog, intent, p)
    ranked = R.total([found.rows]) if found.rows is not None else None
    if (ranked is None or ranked.isEmpty()) and found.hard is not None:
        ranked = found.hard.select("dataset_id", F.lit(1.0).alias("score"))
    if ranked is None:
        return catalog.dataset.select(F.col("id").alias("dataset_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    if found.linked is not None:
        ranked = ranked.join(found.linked, "dataset_id", "left_semi")
    key = F.round("score", 6)
    best = R.top_with_ties(ranked, top, key)
    # at most ``top`` rows and the ties of the last one meet in this window
    return best.select("dataset_id", key.alias("score"), F.rank().over(Window.orderBy(F.desc(key))).alias("rank"))
