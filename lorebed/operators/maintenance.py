"""Keeping a collection in order: backup checks, file names, link tests, archives by name, installs, translation caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import online_url

#: The first bytes of an archive and of a PDF (fixed values).
MAGIC = {"zim": "ZIM", "pdf": "%PDF"}
#: Home pages of known archive projects are a parameter; others are guessed.
CACHE = ["language", "kind", "item_id"]


def backup_issues(files: DataFrame) -> DataFrame:
    """source_id, passed and issues of backups; ``files``: source_id, backup_type, path (below the source), head (the first bytes).

    Pages need an HTML file, an archive the first bytes of one, a collection of PDFs those of one in the PDF that is first by path.
    """
    low, kind = F.lower("path"), F.col("backup_type")
    head = F.coalesce(F.col("head"), F.lit(b""))
    starts = {k: F.startswith(head, F.lit(v.encode())) for k, v in MAGIC.items()}
    ends = {k: F.endswith(low, F.lit(f".{k}")) for k in MAGIC}
    first = {k: F.min(F.when(ends[k], F.struct("path", (~starts[k]).alias("bad")))) for k in MAGIC}
    found = files.groupBy("source_id", "backup_type").agg(
        F.bool_or(low.rlike(r"^pages/.*\.html?$")).alias("has_html"), first["zim"].alias("zim"), first["pdf"].alias("pdf")
    )
    issue = F.when((kind == "html") & ~F.col("has_html"), "No HTML files")
    for k in MAGIC:
        issue = issue.when((kind == k) & F.col(k).isNull(), f"No {k.upper()} file").when((kind == k) & F.col(f"{k}.bad"), f"Not a {k.upper()} file")
    return found.select("source_id", issue.isNull().alias("passed"), F.array_compact(F.array(issue)).alias("issues"))


def rename_plan(files: DataFrame, ending: str = ".zim") -> DataFrame:
    """Archives (source_id, filename) to be called after their source: old, new; where a source has several, none and a note."""
    own = files.filter(F.endswith(F.lower("filename"), F.lit(ending)))
    standard = F.concat("source_id", F.lit(ending))
    found = own.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("filename").alias("old"), F.bool_or(F.col("filename") == standard).alias("done")
    )
    left = found.filter(~F.col("done"))
    one = F.col("n") == 1
    return left.select("source_id", F.when(one, F.col("old")).alias("old"), F.when(one, standard).alias("new"), F.when(~one, "several archives").alias("note"))


def link_test(docs: DataFrame, base_url: Column, n: int = 20) -> DataFrame:
    """The first ``n`` documents (doc_id, url, local_url) with the URL that each has online and where its link leads."""
    link = F.coalesce("local_url", "url", F.lit(""))
    path = F.regexp_replace(link, r"^/(zim|backup)/[^/]*/", "")
    kind = F.when(link.rlike(r"^/(zim|backup)/"), "local").when(link.rlike("^https?://"), "online").otherwise("unknown")
    shown = docs.orderBy("doc_id").limit(n)
    return shown.select("doc_id", F.when(path != "", online_url(path, base_url)).alias("online"), kind.alias("kind"))


def archive_names(archives: DataFrame, homes: dict[str, str]) -> DataFrame:
    """What file names tell of archives (filename: project_language_selection_date.zim): project, language, date, base_url, title."""
    stem = F.regexp_replace("filename", r"\.zim$", "")
    parts = F.split(stem, "_")
    project = F.lower(parts[0])
    known = F.create_map(*[F.lit(x) for pair in homes.items() for x in pair]) if homes else F.create_map().cast("map<string,string>")
    return archives.select(
        "filename",
        project.alias("project"),
        F.get(parts, F.lit(1)).alias("language"),
        F.regexp_extract(stem, r"_(\d{4}-\d{2})$", 1).alias("date"),
        F.coalesce(known[project], F.concat(F.lit("https://"), project, F.lit(".org/"))).alias("base_url"),
        F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"),
    )


def live(published: DataFrame, cached: DataFrame) -> DataFrame:
    """The published catalog, or where it has no row the cached one; ``via`` says which."""
    some = F.broadcast(published.agg((F.count(F.lit(1)) > 0).alias("_some")))  # one row
    kept = cached.join(some, F.lit(True)).filter(~F.col("_some")).drop("_some")
    return published.withColumn("via", F.lit("published")).unionByName(kept.withColumn("via", F.lit("cached")))


def install_into(store: DataFrame, pack: DataFrame, mode: str = "update", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The store after a pack of some sources: ``update`` keeps what the pack lacks, ``replace`` drops all else of its sources."""
    if mode not in ("update", "replace"):
        raise ValueError(f"no such install: {mode}")
    on = key if mode == "update" else source
    return store.join(pack.select(on).distinct(), on, "left_anti").select(*pack.columns).unionByName(pack)


def cache_put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """A translation cache (language, kind, item_id, text, saved_at) with ``rows`` put in: of each item the latest stays."""
    latest = F.max_by(F.struct("text", "saved_at"), F.struct("saved_at", "text")).alias("last")
    return cache.unionByName(rows).groupBy(*CACHE).agg(latest).select(*CACHE, "last.*")


def cache_get(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (language, kind, item_id) with the cached text, null where there is none."""
    return wanted.join(cache.select(*CACHE, "text"), CACHE, "left")


def cache_clear(cache: DataFrame, language: str | None = None) -> DataFrame:
    """The cache without one language, or empty."""
    return cache.filter(F.col("language") != language) if language else cache.limit(0)


def cache_stats(cache: DataFrame) -> DataFrame:
    """One row: articles, bytes of all kinds, languages."""
    return cache.agg(
        F.count_if(F.col("kind") == "article").alias("articles"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set("language")).alias("languages"),
    )


def decided(submissions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Submissions (submission_id, ...) with status and reason by their latest decision (submission_id, verdict, reason, decided_at)."""
    last = decisions.groupBy("submission_id").agg(F.max_by(F.struct("verdict", "reason"), F.struct("decided_at", "verdict")).alias("last"))
    status = F.when(F.col("last.verdict") == "approve", "approved").when(F.col("last.verdict") == "reject", "rejected").otherwise("pending")
    joined = submissions.join(last, "submission_id", "left")
    return joined.select(*submissions.columns, status.alias("status"), F.col("last.reason").alias("reason"))


def localisations(sources: DataFrame, parent: str | None = None) -> DataFrame:
    """Localised sources (parent_source isn't null) by parent: how many, and their languages."""
    own = sources.filter(F.col("parent_source").isNotNull() if parent is None else F.col("parent_source") == parent)
    return own.groupBy("parent_source").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("language")).alias("languages"))


def backup_status(pages: DataFrame, least: int = 100) -> DataFrame:
    """One row: pages (content, error) that are sound, failed, and too short to be whole."""
    size = F.length(F.coalesce("content", F.lit("")))
    failed = F.col("error").isNotNull()
    return pages.agg(
        F.count_if(~failed & (size >= least)).alias("sound"), F.count_if(failed).alias("failed"), F.count_if(~failed & (size < least)).alias("short")
    )
