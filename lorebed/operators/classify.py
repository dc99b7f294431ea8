"""Document types, priorities, tiers and states, as ordered rules over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_contains, count_contained

#: Substrings by type and place (fixed values).
ACADEMIC = {
    "content": [
        "abstract", "methodology", "literature review", "hypothesis", "peer-reviewed", "journal", "et al", "findings suggest",
        "statistical analysis", "p-value", "confidence interval", "research shows", "study found", "data collected",
        "participants", "experiment", "control group", "bibliography", "references", "doi:", "issn", "volume", "issue", "pp.",
        "cited",
    ],
    "title": [
        "study of", "analysis of", "research on", "investigation of", "evaluation of", "assessment of", "review of", "survey of",
        "comparison of", "effects of", "impact of", "role of", "towards", "a novel", "an empirical", "experimental",
    ],
    "categories": ["research", "academic", "papers", "studies", "science", "journal", "publications", "peer-reviewed"],
}
PRODUCT = {
    "content": [
        "manufacturer", "vendor", "company", "buy", "purchase", "price", "commercial", "product", "brand", "store", "shop", "order",
        "supplier", "distributor", "retailer", "for sale", "available from",
    ],
    "title": ["inc.", "llc", "ltd", "corp", "company", "industries"],
    "categories": ["manufacturers", "vendors", "products", "commercial"],
}
GUIDE = {
    "content": [
        "how to", "step by step", "instructions", "build", "construct", "make your own", "diy", "plans", "tutorial", "guide",
        "assembly", "materials needed", "tools needed", "step 1", "step 2", "first,", "then,", "next,", "finally,", "procedure",
        "method", "construction",
    ],
    "title": [
        "how to", "build", "make", "construct", "diy", "plans", "design", "tutorial", "project", "homemade", "simple", "easy",
        "cooker", "oven", "heater", "collector", "dryer", "still", "reflector", "parabolic", "panel", "trough", "box cooker",
        "solar cooker", "solar oven", "solar heater", "solar collector", "hexayurt", "shelter", "filter", "biogas", "digester",
    ],
    "categories": ["plans", "construction", "diy", "how-to", "projects"],
}
#: Least content words by type, in order of precedence (fixed values).
RULES = (("academic", ACADEMIC, 3), ("product", PRODUCT, 3), ("guide", GUIDE, 2))
DOC_TYPES = ("guide", "article", "product", "academic")
PRIORITY = {"guide": "GUIDE", "article": "ARTICLE", "product": "PRODUCT", "academic": "RESEARCH"}
GOVERNMENT = ("fema", "epa", "calfire", "usda", "gov")


def doc_type(title: Column, content: Column, categories: Column | None = None) -> Column:
    """academic, product or guide by category, title, or enough words in the first 500 characters; else article."""
    title, head = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.left(F.coalesce(content, F.lit("")), F.lit(500)))
    found = None
    for name, words, least in RULES:
        hit = any_contains(title, words["title"]) | (count_contained(head, words["content"]) >= least)
        if categories is not None:
            filed = F.exists(categories, lambda c, w=words: any_contains(F.lower(c), w["categories"]))
            hit = hit | F.coalesce(filed, F.lit(False))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise("article")


def priority(doc_type: Column, source: Column) -> Column:
    found = F.when(any_contains(F.lower(source), list(GOVERNMENT)), "GOVERNMENT")
    for kind, name in PRIORITY.items():
        found = found.when(doc_type == kind, name)
    return found.otherwise("ARTICLE")


def tier(licence: Column, verified: Column) -> Column:
    known = F.coalesce(licence, F.lit("Unknown")) != "Unknown"
    return F.when(F.coalesce(verified, F.lit(False)), "official").when(known, "community").otherwise("personal")


def archive_type(html: Column, video: Column, pdf: Column) -> Column:
    """What an archive holds, by the ratios of its entries."""
    return F.when(video > 0.5 * html, "video").when(pdf > 0.3 * html, "pdf").otherwise("html")


def archive_advice(skip_rate: Column, n_html: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(n_html == 0, F.lit("no indexable pages")),
            F.when(skip_rate > 0.7, F.lit("most pages are too short: lower the minimum length")),
        )
    )


def caption_error(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(F.contains(low, F.lit("disabled")), "disabled")
        .when(any_contains(low, ["private", "unavailable"]), "unavailable")
        .when(any_contains(low, ["empty transcript", "no transcript"]), "no_transcript")
        .when(any_contains(low, ["timed out", "timeout"]), "timeout")
        .otherwise("fetch_failed")
    )


def connection_state(
    mode: Column, checking: Column, unavailable: Column, online: Column, failures: Column, recovering: Column, stale: Column
) -> Column:
    return (
        F.when(mode == "offline_only", "offline")
        .when(checking, "checking")
        .when(unavailable, "unavailable")
        .when(~online & (mode == "online_only"), "disconnected")
        .when(~online, "unstable")
        .when((mode == "hybrid") & (failures >= 2), "unstable")
        .when(recovering, "recovering")
        .when(stale & (mode == "hybrid"), "unstable")
        .otherwise("online")
    )
