"""Gates that a source passes before it is submitted or published, and what it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.licence import allowed

LEAST_BACKUP_MB = 0.1
SUBMIT = (
    "has_manifest", "has_metadata", "has_backup", "license_in_allowlist", "license_verified", "links_verified_offline",
    "links_verified_online", "language_is_english",
)
PUBLISH = ("has_vectors_768", "has_vectors_1536", "deep_validated", "integrity_passed", "language_verified")
#: What is said of a failed check, and the job that mends it (fixed values).
CHECKS = {
    "has_manifest": "Missing manifest file",
    "has_metadata": "Missing metadata file",
    "has_backup": "Missing backup content",
    "has_vectors_1536": "Missing 1536-dim vectors (online index)",
    "has_vectors_768": "Missing 768-dim vectors (offline index)",
    "license_in_allowlist": "License not in allowlist",
    "license_verified": "License not verified by human",
    "links_verified_offline": "Offline links not verified",
    "links_verified_online": "Online links not verified",
    "language_is_english": "Language must be English",
    "language_verified": "Language not verified by human",
}


def _all(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & F.coalesce(F.col(name), F.lit(False))
    return out


def light(sources: DataFrame) -> DataFrame:
    """Add the derived flags: license_in_allowlist and language_is_english."""
    return sources.withColumns(
        {
            "license_in_allowlist": allowed(F.col("license"), F.col("license_notes")),
            "language_is_english": F.lower(F.coalesce("language", F.lit(""))).isin("en", "english"),
        }
    )


def gates(sources: DataFrame) -> DataFrame:
    """Add can_submit and can_publish."""
    indexed = F.coalesce("has_vectors_768", F.lit(False)) | F.coalesce("has_vectors_1536", F.lit(False))
    submit = _all(SUBMIT) & (F.col("backup_size_mb") >= LEAST_BACKUP_MB) & indexed
    return sources.withColumn("can_submit", submit).withColumn("can_publish", F.col("can_submit") & _all(PUBLISH))


def missing(sources: DataFrame) -> DataFrame:
    """One row for each failed check: source_id, check, message."""
    failed = [F.when(~F.coalesce(F.col(c), F.lit(False)), F.struct(F.lit(c).alias("check"), F.lit(m).alias("message"))) for c, m in CHECKS.items()]
    small = F.coalesce("has_backup", F.lit(False)) & (F.col("backup_size_mb") < LEAST_BACKUP_MB)
    failed.append(F.when(small, F.struct(F.lit("backup_size").alias("check"), F.lit("Backup too small").alias("message"))))
    return sources.select("source_id", F.explode(F.array_compact(F.array(*failed))).alias("m")).select("source_id", "m.*")


def summary(sources: DataFrame) -> DataFrame:
    """source_id, gates and the number of failed checks."""
    counted = missing(sources).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_missing"))
    own = gates(sources).select("source_id", "can_submit", "can_publish")
    return own.join(counted, "source_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))


def chain_problems(steps: DataFrame, order: dict[str, list[str]]) -> DataFrame:
    """Pairs of steps (chain_id, pos, job) in the wrong order: ``order`` names the jobs that must come before a job."""
    pairs = [(job, before) for job, needed in order.items() for before in needed]
    rules = F.broadcast(steps.sparkSession.createDataFrame(pairs, "job string, before string"))  # a fixed table
    first = steps.join(rules, "job")
    other = steps.select("chain_id", F.col("job").alias("before"), F.col("pos").alias("other"))
    return first.join(other, ["chain_id", "before"]).filter(F.col("other") > F.col("pos")).select("chain_id", "job", "before")


def valid_source_id(source_id: Column) -> Column:
    return F.coalesce(source_id.rlike(r"^[a-z0-9][a-z0-9_-]*$"), F.lit(False))


#: Files that a complete pack has (fixed values).
PACK_FILES = ("_manifest.json", "_metadata.json", "_index.json")


def completeness(files: DataFrame) -> DataFrame:
    """Which files each source (source_id, filename) has, its vector dimensions, and whether it is complete."""
    name = F.col("filename")
    dimension = F.regexp_extract(name, r"^_vectors_?(\d*)\.json$", 1)
    flags = [F.bool_or(name == f).alias("has" + f.split(".")[0]) for f in PACK_FILES]
    vectors = F.sort_array(F.collect_set(F.when(F.startswith(name, F.lit("_vectors")), F.when(dimension == "", 1536).otherwise(dimension.try_cast("int")))))
    pages = F.bool_or(name.rlike(r"(?i)\.(html?|pdf|zim)$"))
    found = files.groupBy("source_id").agg(*flags, vectors.alias("dimensions"), pages.alias("has_content"))
    whole = F.col("has_manifest") & F.col("has_metadata") & F.col("has_content") & (F.size("dimensions") > 0)
    return found.withColumn("is_complete", whole)


def localisable(sources: DataFrame, language: str) -> DataFrame:
    """source_id and whether a source can be localised: indexed, no localisation itself, another language, none there yet."""
    done = sources.filter(F.col("parent_source").isNotNull() & (F.col("language") == language)).select(F.col("parent_source").alias("source_id"), F.lit(True).alias("done"))
    own = sources.join(done.distinct(), "source_id", "left")
    may = F.coalesce("has_metadata", F.lit(False)) & F.coalesce("has_backup", F.lit(False)) & F.col("parent_source").isNull() & (F.col("language") != language) & F.col("done").isNull()
    return own.select("source_id", may.alias("can_localise"))
