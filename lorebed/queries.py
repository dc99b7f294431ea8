"""Queries by name over the provided tables, each next to the SQL whose rows it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, language, licence, tags, times, vectors, web
from .functions import text as tx
from .operators import catalog, chunks, classify, document_types, extract, graph, ingest, models, papers, search, sessions, stats, sync, validate
from .plans.answer import answer
from .sources import archives
from .sources.tables import corpus, spread, table, vector_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUESTION = "that with this from"
SOURCES = ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"]
DOCS = "docs AS (SELECT doc_id, source, lang, split_part(text, chr(10), 1) AS title, text AS content FROM documents)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _terms(question: str) -> str:
    one = "CASE WHEN contains(lower(title), '{t}') THEN 5 ELSE 0 END + (length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {n}"
    return " + ".join(one.format(t=t, n=len(t)) for t in question.split())


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _count(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words) + ")"


def _doc_type(title: str, content: str) -> str:
    rules = "".join(
        f" WHEN {_has(f'lower({title})', w['title'])} OR {_count(f'lower({content}[:500])', w['content'])} >= {n} THEN '{name}'" for name, w, n in classify.RULES
    )
    return f"CASE{rules} ELSE 'article' END"


#: Hits of the question in SQL: doc_id, source, title, content, score, pos.
HITS = f"""{DOCS}, raw AS (SELECT *, {_terms(QUESTION)} AS raw FROM docs WHERE source IN ({", ".join(f"'{s}'" for s in SOURCES)})),
top AS (SELECT * FROM raw WHERE raw > 0 ORDER BY raw DESC, doc_id LIMIT 15),
hits AS (SELECT doc_id, source, lang, title, content, least(raw / max(raw) OVER (), 1.0) AS score,
                CAST(row_number() OVER (ORDER BY raw DESC, doc_id) AS INT) AS pos FROM top)"""
RERANKED = f"""{HITS}, t AS (SELECT *, {_doc_type("title", "content")} AS doc_type FROM hits),
ranked AS (SELECT doc_id, source, title, content, doc_type, score AS original_score,
                  score + CASE WHEN doc_type = 'guide' THEN 0.15::DOUBLE ELSE -0.05::DOUBLE END AS score, pos AS old FROM t),
reranked AS (SELECT * EXCLUDE (old), CAST(row_number() OVER (ORDER BY score DESC, old) AS INT) AS pos FROM ranked)"""
CUT = f"""{RERANKED}, good AS (
  SELECT * FROM (SELECT *, max(original_score >= 0.18) OVER () AS any_good, first(original_score) OVER (ORDER BY pos) AS top1 FROM reranked)
  WHERE CASE WHEN any_good THEN original_score >= 0.18 ELSE top1 >= 0.12 END),
turns AS (SELECT *, count(*) OVER () AS n, least(row_number() OVER (PARTITION BY source ORDER BY score DESC, pos), 3) AS turn,
                 min(pos) OVER (PARTITION BY source) AS seen FROM good),
placed AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n <= 5 THEN pos END, CASE WHEN n <= 5 THEN 0 ELSE turn END, score DESC, seen, pos) AS place FROM turns),
cut AS (SELECT doc_id, source, title, content, doc_type, score, original_score, CAST(place AS INT) AS pos FROM placed WHERE n <= 5 OR place <= 5)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_top(corpus(spark, sf_dir), QUESTION, search.CANDIDATES, SOURCES)


# --- retrieval ---------------------------------------------------------------------------------------------------


@query(f"WITH {HITS} SELECT doc_id, source, round(score, 6) AS score, pos FROM hits")
def keyword_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", "source", F.round("score", 6).alias("score"), "pos")


@query(f"WITH {RERANKED} SELECT doc_id, doc_type, round(score, 6) AS score, round(original_score, 6) AS original_score, pos FROM reranked")
def doc_type_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    typed = hits.select("doc_id", classify.doc_type(F.col("title"), F.col("content")).alias("doc_type"))
    found = search.rerank(hits, typed)
    return found.select("doc_id", "doc_type", F.round("score", 6).alias("score"), F.round("original_score", 6).alias("original_score"), "pos")


@query(f"WITH {CUT} SELECT doc_id, source, doc_type, round(score, 6) AS score, pos FROM cut")
def answer_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(corpus(spark, sf_dir), QUESTION, SOURCES).select("doc_id", "source", "doc_type", F.round("score", 6).alias("score"), "pos")


@query(f"""WITH {CUT} SELECT pos, doc_id, title, source, round(score, 3) AS score,
           CASE WHEN length(content) > 300 THEN content[:300] || '...' ELSE content END AS snippet FROM cut""")
def api_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.api_articles(answer(corpus(spark, sf_dir), QUESTION, SOURCES))


@query(f"""WITH {CUT} SELECT string_agg('Article #' || pos || ': ' || title || chr(10) || 'Type: ' || upper(doc_type[:1]) || doc_type[2:] || chr(10) ||
           'Source: ' || source || chr(10) || 'Relevance: ' || printf('%.2f', score) || chr(10) || content[:500] || '...', chr(10) || chr(10) ORDER BY pos) AS context FROM cut""")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.context_block(answer(corpus(spark, sf_dir), QUESTION, SOURCES))


@query(f"WITH {CUT} SELECT string_agg('- ' || title, chr(10) ORDER BY pos) AS answer FROM cut WHERE pos <= 5")
def simple_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.simple_response(answer(corpus(spark, sf_dir), QUESTION, SOURCES))


@query(f"""WITH {HITS}, h AS (SELECT *, CAST(1 AS DOUBLE) - (pos - 1) * 0.07::DOUBLE AS s FROM hits),
turns AS (SELECT *, count(*) OVER () AS n, least(row_number() OVER (PARTITION BY source ORDER BY s DESC, pos), 3) AS turn, min(pos) OVER (PARTITION BY source) AS seen FROM h),
placed AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n <= 5 THEN pos END, CASE WHEN n <= 5 THEN 0 ELSE turn END, s DESC, seen, pos) AS place FROM turns)
SELECT doc_id, source, CAST(place AS INT) AS pos FROM placed WHERE n <= 5 OR place <= 5""")
def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumn("score", F.lit(1.0) - (F.col("pos") - 1) * F.lit(0.07))
    return search.diversity_cut(hits).select("doc_id", "source", "pos")


@query(f"""WITH {HITS}, j AS (SELECT *, score * 0.3::DOUBLE AS original_score FROM hits), q AS (
  SELECT *, max(original_score >= 0.18) OVER () AS any_good, first(original_score) OVER (ORDER BY pos) AS top1 FROM j)
SELECT doc_id, round(original_score, 6) AS original_score FROM q WHERE CASE WHEN any_good THEN original_score >= 0.18 ELSE top1 >= 0.12 END""")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumns({"original_score": F.col("score") * F.lit(0.3), "url": F.lit(None).cast("string")})
    return search.quality_cut(hits, QUESTION).select("doc_id", F.round("original_score", 6).alias("original_score"))


def _asked(spark: SparkSession, sf_dir: str) -> list[float]:
    return search.vector_of(vector_store(spark, sf_dir), 0)


_STORE = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, 'src' || label AS source FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = 0)"
_SQUARED = "list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_COSINE = "list_cosine_similarity(e, qe)"


@query(f"WITH {_STORE} SELECT id, source, round(1 / (1 + {_SQUARED}), 6) AS score FROM v, q WHERE source IN ('src1', 'src2', 'src3') ORDER BY 1 / (1 + {_SQUARED}) DESC, id LIMIT 15")
def semantic_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    found = search.vector_top(vector_store(spark, sf_dir), asked, 15, "l2", F.col("source").isin("src1", "src2", "src3"))
    return found.select("id", "source", F.round("score", 6).alias("score"))


@query(f"WITH {_STORE} SELECT id, source, round({_COSINE}, 6) AS score FROM v, q ORDER BY {_COSINE} DESC, id LIMIT 15")
def semantic_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_top(vector_store(spark, sf_dir), _asked(spark, sf_dir), 15, "cosine").select("id", "source", F.round("score", 6).alias("score"))


@query(f"WITH {_STORE} SELECT id, round(1 / (1 + {_SQUARED}), 6) AS score FROM v, q WHERE id <> 0 ORDER BY 1 / (1 + {_SQUARED}) DESC, id LIMIT 5")
def similar_to_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similar_to(vector_store(spark, sf_dir), 0, 5).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_STORE}, t AS (SELECT id, source FROM v, q WHERE id <> 0 ORDER BY 1 / (1 + {_SQUARED}) DESC, id LIMIT 20) SELECT id, source FROM t WHERE source IN ('src1', 'src2')")
def similar_then_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similar_to(vector_store(spark, sf_dir), 0, 20).filter(F.col("source").isin("src1", "src2")).select("id", "source")


def _intent_sql(column: str) -> str:
    return "CASE" + "".join(f" WHEN {_has(f'lower({column})', words)} THEN '{kind}'" for kind, words in search.INTENTS.items()) + " END"


@query(f"SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations WHERE role = 'user'")
def doc_type_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return asked.select("conv_id", "turn", search.intent(F.col("text")).alias("intent"))


_FLAT = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"""SELECT conv_id, turn, {_FLAT} IN ({", ".join(f"'{p}'" for p in search.GENERIC_PHRASES)}) OR (len(regexp_extract_all({_FLAT}, '[a-z0-9'']+')) <= 3
           AND len(list_intersect(regexp_extract_all({_FLAT}, '[a-z0-9'']+'), ['help', 'emergency', 'assistance'])) > 0) AS generic FROM conversations""")
def generic_help(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search.is_generic(F.col("text")).alias("generic"))


@query(r"""SELECT page_id, regexp_matches(lower(url), '\.(avi|mp4|mov|wmv|webm|mp3|ppt|pptx|xls|xlsx|zip|exe)$')
           OR len(regexp_extract_all(html[:400], '�')) >= 3 OR len(regexp_extract_all(html[:400], '[\x00-\x08\x0B\x0C\x0E-\x1F]')) >= 8 AS binaryish FROM pages""")
def binaryish_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.is_binaryish(F.lit(""), F.col("url"), F.col("html")).alias("binaryish"))


# --- statistics --------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS count, CAST(sum(length(text)) AS BIGINT) AS chars, max(doc_id) AS last_doc FROM documents GROUP BY source")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.source_stats(corpus(spark, sf_dir))


@query("SELECT source, count(*) AS count, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source)")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.source_totals(corpus(spark, sf_dir))


@query(f"""WITH {DOCS}, t AS (SELECT {_doc_type("title", "content")} AS doc_type FROM docs)
SELECT d.doc_type, count(t.doc_type) AS count FROM (VALUES ('guide'), ('article'), ('product'), ('academic')) d(doc_type) LEFT JOIN t ON t.doc_type = d.doc_type GROUP BY 1""")
def doc_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = corpus(spark, sf_dir).select(classify.doc_type(F.col("title"), F.col("content")).alias("doc_type"))
    return stats.counts_over(typed, "doc_type", classify.DOC_TYPES)


_GOV = _has("lower(source)", list(classify.GOVERNMENT))


@query(f"""WITH {DOCS}, t AS (SELECT source, {_doc_type("title", "content")} AS d FROM docs)
SELECT CASE WHEN {_GOV} THEN 'GOVERNMENT' WHEN d = 'guide' THEN 'GUIDE' WHEN d = 'product' THEN 'PRODUCT' WHEN d = 'academic' THEN 'RESEARCH' ELSE 'ARTICLE' END AS priority,
       count(*) AS n FROM t GROUP BY 1""")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = corpus(spark, sf_dir).withColumn("d", classify.doc_type(F.col("title"), F.col("content")))
    return typed.groupBy(classify.priority(F.col("d"), F.col("source")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


_WORDS = ("the", "and", "der", "que", "est", "of", "les")


@query(f"""WITH {DOCS}, s AS (SELECT source, {", ".join(f"bool_or(contains(lower(title), '{w}')) AS {w}_" for w in _WORDS)} FROM docs GROUP BY source)
SELECT source, array_to_string(list_filter([{", ".join(f"CASE WHEN {w}_ THEN '{w}' END" for w in sorted(_WORDS))}], lambda x: x IS NOT NULL)[1:5], ',') AS topics FROM s""")
def topics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.topics_by_source(corpus(spark, sf_dir), _WORDS).select("source", F.array_join("topics", ",").alias("topics"))


@query("SELECT category, count(*) AS count, CAST(sum(n) AS BIGINT) AS total_chars FROM (SELECT unnest([lang, source]) AS category, length(text) AS n FROM documents) GROUP BY 1")
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.category_stats(corpus(spark, sf_dir).withColumn("categories", F.array("lang", "source")))


STOP = ["the", "and", "that", "of", "with", "for", "from", "this", "was", "are", "der", "die", "und", "que", "les", "des", "los", "las"]


def _normalised(tag: str) -> str:
    mapped = "".join(f" WHEN {tag} = '{a}' THEN '{b}'" for a, b in tags.PREFERRED.items())
    return f"""CASE{mapped} WHEN length({tag}) > 3 AND {tag} LIKE '%ies' AND {tag} NOT IN ('series', 'species') THEN {tag}[:-4] || 'y'
        WHEN length({tag}) > 4 AND regexp_matches({tag}, '(s|x|z|ch|sh)es$') AND {tag} NOT LIKE '%tes' THEN {tag}[:-3]
        WHEN length({tag}) > 3 AND {tag} LIKE '%s' AND NOT regexp_matches({tag}, '(ss|us|is)$') THEN {tag}[:-2] ELSE {tag} END"""


_TERMS = f"""{DOCS}, w AS (SELECT unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM docs),
terms AS (SELECT {_normalised("word")} AS term, count(*) AS n FROM w WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN ({", ".join(f"'{s}'" for s in STOP)}) GROUP BY 1 HAVING count(*) >= 2)"""


@query(f"WITH {_TERMS} SELECT * FROM terms")
def term_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.title_terms(corpus(spark, sf_dir), STOP)


VOCABULARY = {"articles": ["the ", "der ", "les "], "links": ["and", "und", "et"], "notes": ["note", "issue"], "never": ["zzzz"]}


def _topic_sums() -> str:
    one = "(length(t) - length(replace(t, '{w}', ''))) // {n}"
    return ", ".join(f"('{topic}', (SELECT sum({' + '.join(one.format(w=w, n=len(w)) for w in words)}) FROM x))" for topic, words in VOCABULARY.items())


_TOPICS = f"x AS (SELECT lower(title || ' ' || content[:300]) AS t FROM docs), topics AS (SELECT topic, score FROM (VALUES {_topic_sums()}) v(topic, score) WHERE score > 0)"


@query(f"WITH {DOCS}, {_TOPICS} SELECT topic, CAST(score AS BIGINT) AS score FROM topics")
def topic_tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.topic_scores(corpus(spark, sf_dir), VOCABULARY)


@query(f"""WITH {_TERMS}, {_TOPICS},
lift AS (SELECT coalesce(max(n) + 1, 10000) AS l FROM terms),
u AS (SELECT topic AS tag, CAST(score + l AS BIGINT) AS score, 'topic' AS kind FROM topics, lift UNION ALL SELECT term, n, 'term' FROM terms)
SELECT tag, max(score) AS score, max(kind) AS kind FROM u GROUP BY tag ORDER BY 2 DESC, 1 LIMIT 200""")
def combined_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.combined_tags(stats.topic_scores(corpus(spark, sf_dir), VOCABULARY), stats.title_terms(corpus(spark, sf_dir), STOP))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{4,})"), F.lit(1))))
    return corpus(spark, sf_dir).select("source", words.alias("tag"))


_TAGS = f"{DOCS}, tags AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(title), '([a-z]{{4,}})', 1))) AS tag FROM docs)"


@query(f"WITH {_TAGS} SELECT tag, count(DISTINCT source) AS sources FROM tags GROUP BY tag ORDER BY 2 DESC, 1 LIMIT 6")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tag_histogram(_tags(spark, sf_dir))


@query(f"""WITH {_TAGS} SELECT tag, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n FROM tags
           WHERE tag NOT IN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z]{{4,}})', 1)) FROM benchmark) GROUP BY tag""")
def novel_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("tag"))
    return stats.tags_against(_tags(spark, sf_dir), known, novel=True).select("tag", F.array_join("sources", ",").alias("sources"), "n")


@query("""SELECT source, count(*) AS count, array_to_string(list_sort(list(doc_id))[1:3], ',') AS samples FROM documents GROUP BY source""")
def source_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.sample_ids(table(spark, sf_dir, "documents"), "source", "doc_id")
    return found.select("source", "count", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query("""WITH e AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'image/png' ELSE 'text/html' END AS mime, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS n FROM pages)
SELECT count(*) AS entries, count(*) FILTER (mime = 'text/html') AS html, count(*) FILTER (mime = 'text/html' AND n >= 1000) AS indexable,
       count(*) FILTER (mime = 'text/html' AND n < 1000) AS skipped, round(avg(n) FILTER (mime = 'text/html' AND n >= 1000), 2) AS mean_length,
       round(count(*) FILTER (mime = 'text/html' AND n < 1000) / count(*) FILTER (mime = 'text/html'), 4) AS skip_rate FROM e""")
def archive_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("text/html")
    entries = table(spark, sf_dir, "pages").select(mime.alias("mime"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return stats.archive_profile(entries, 1000)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 15")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(15)


@query("""WITH s AS (SELECT split_part(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/', 2) AS segment FROM pages), c AS (SELECT segment, count(*) / sum(count(*)) OVER () AS share FROM s GROUP BY 1)
SELECT segment, round(share, 4) AS share FROM c WHERE share >= 0.3""")
def majority_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.split_part(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), F.lit("/"), F.lit(2))
    return stats.majority_prefix(table(spark, sf_dir, "pages").select(segment.alias("segment")), 0.3)


# --- keys and duplicates -----------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(source || ':' || doc_id) AS html_id, md5(text) AS hash, md5(text)[:12] AS short, source || '_' || md5(text)[:12] AS pdf_id FROM documents""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        keys.html_doc_id(F.col("source"), F.col("doc_id").cast("string")).alias("html_id"),
        keys.content_hash(F.col("text")).alias("hash"),
        keys.short_hash(F.col("text")).alias("short"),
        keys.pdf_doc_id(F.col("source"), F.col("text")).alias("pdf_id"),
    )


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", keys.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


# --- sync and merge ----------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "n_chars")
    stamp = lambda k: F.format_string("2024-01-%02dT00:00:00", (F.col("doc_id") % k + 1).cast("int"))
    local = docs.filter("doc_id % 7 <> 0").select("doc_id", F.col("h").alias("content_hash"), stamp(9).alias("scraped_at"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("h"), F.lit("x"))).otherwise(F.col("h"))
    remote = docs.filter("doc_id % 11 <> 0").select("doc_id", changed.alias("content_hash"), stamp(13).alias("scraped_at"))
    return local, remote


_DIFF = """l AS (SELECT doc_id, md5(text) AS h, printf('2024-01-%02dT00:00:00', doc_id % 9 + 1) AS t FROM documents WHERE doc_id % 7 <> 0),
r AS (SELECT doc_id, md5(text) || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END AS h, printf('2024-01-%02dT00:00:00', doc_id % 13 + 1) AS t FROM documents WHERE doc_id % 11 <> 0),
d AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'push' WHEN l.doc_id IS NULL THEN 'pull' WHEN l.h = r.h THEN 'in_sync'
             WHEN l.t >= r.t THEN 'update' ELSE 'conflict' END AS action FROM l FULL JOIN r ON l.doc_id = r.doc_id)"""


@query(f"WITH {_DIFF} SELECT * FROM d")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff(*_snapshots(spark, sf_dir))


@query(f"WITH {_DIFF} SELECT action, count(*) AS n FROM d GROUP BY action")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff_counts(sync.diff(*_snapshots(spark, sf_dir)))


@query(f"WITH {_DIFF} SELECT * FROM d WHERE action IN ('push', 'update', 'conflict')")
def sync_forced_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.push_plan(sync.diff(*_snapshots(spark, sf_dir)), force=True)


@query(f"WITH {_DIFF} SELECT * FROM d WHERE action IN ('push', 'update') AND (SELECT count(*) FROM d WHERE action = 'conflict') = 0")
def sync_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.push_plan(sync.diff(*_snapshots(spark, sf_dir)))


@query("""SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'left' WHEN a.source IS NULL THEN 'right' ELSE 'both' END AS side
FROM (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND doc_id % 3 = 0) a FULL JOIN (SELECT DISTINCT source FROM documents WHERE lang = 'de') b ON a.source = b.source""")
def source_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sync.set_difference(docs.filter("lang = 'en' and doc_id % 3 = 0"), docs.filter("lang = 'de'"), "source")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that lacks some ids and has zero or null vectors at others."""
    v = vector_store(spark, sf_dir).filter("id % 4 <> 0")
    zero = F.transform("embedding", lambda x: (x * 0).cast("float"))
    return v.withColumn("embedding", F.when(F.col("id") % 10 == 1, zero).when(F.col("id") % 10 == 3, F.lit(None)).otherwise(F.col("embedding")))


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'insert' WHEN vec_id % 10 IN (1, 3) THEN 'replace' ELSE 'skip' END AS action FROM embeddings""")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.incremental_plan(vector_store(spark, sf_dir), _stored(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS origin FROM documents""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("version"), F.lit("old").alias("origin"))
    new = old.filter("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("version"), F.lit("new").alias("origin"))
    return sync.upsert(old, new, "doc_id", "version")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src3' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "documents").filter(F.col("source") != "src3").select("doc_id", "source")
    return sync.without(kept, table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT CASE WHEN source = 'src1' THEN 'renamed' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1")
def rename_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = sync.rename(table(spark, sf_dir, "documents"), "source", "src1", "renamed")
    return renamed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (m IS NOT NULL) AS metadata, count(*) FILTER (v IS NOT NULL) AS vectors, count(*) FILTER (v IS NULL) AS without_vector,
       count(*) FILTER (m IS NULL) AS without_metadata FROM (SELECT d.doc_id AS m, e.vec_id AS v FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id)""")
def id_crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return sync.crossref(table(spark, sf_dir, "documents"), vectors_)


@query("""WITH c AS (SELECT count(*) FILTER (m IS NOT NULL) AS metadata, count(*) FILTER (v IS NOT NULL) AS vectors, count(*) FILTER (v IS NULL) AS without_vector,
       count(*) FILTER (m IS NULL) AS without_metadata FROM (SELECT d.doc_id AS m, e.vec_id AS v FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id)),
r AS (SELECT *, round((metadata - without_vector) / metadata, 4) AS coverage, round(without_metadata / vectors, 4) AS orphaned FROM c)
SELECT *, CASE WHEN coverage < 0.5 THEN 'invalid' WHEN coverage < 0.9 OR orphaned > 0.05 THEN 'warning' ELSE 'ok' END AS state FROM r""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.coverage(id_crossref(spark, sf_dir))


# --- vectors -----------------------------------------------------------------------------------------------------

_VECTORS = """v AS (SELECT 'src' || label AS source, embedding AS e, e IS NULL OR len(e) = 0 OR len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 AS corrupt,
  len(e) = 64 AS sized, len(list_filter(e, lambda x: x <> 0)) = 0 AS zero FROM embeddings)"""


@query(f"""WITH {_VECTORS} SELECT count(*) AS total, count(*) FILTER (corrupt) AS corrupt, count(*) FILTER (NOT corrupt AND NOT sized) AS wrong_dim,
           count(*) FILTER (NOT corrupt AND sized AND zero) AS zero, count(*) FILTER (NOT corrupt AND sized AND NOT zero) AS sound FROM v""")
def vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return stats.vector_quality(vector_store(spark, sf_dir), 64, vectors.is_corrupt(v), vectors.is_null_or_zero(v))


@query(f"WITH {_VECTORS} SELECT source, count(*) FILTER (e IS NULL) AS total_null, count(*) FILTER (zero) AS total_zero FROM v GROUP BY source")
def zero_vector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bad_vectors(vector_store(spark, sf_dir))


@query("""WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2)
SELECT label, round(sum(m * m), 6) AS square FROM m GROUP BY label""")
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = stats.mean_vector(table(spark, sf_dir, "embeddings"), "label")
    return means.select("label", F.round(vectors.dot(F.col("mean"), F.col("mean")), 6).alias("square"))


# --- sources, packs, validation ----------------------------------------------------------------------------------


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest a source, its fields derived from the source's documents."""
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("k"))
    names = F.element_at(F.array(*map(F.lit, ["CC BY-SA 4.0", "MIT", "Unknown", "Proprietary", "Custom", "cc-by-nc"])), (F.col("k") % 6 + 1).cast("int"))
    return docs.select(
        F.col("source").alias("source_id"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("Source "), F.col("source"))).alias("name"),
        names.alias("license"),
        F.when(F.col("k") % 4 == 0, "written permission by the owner").otherwise("short").alias("license_notes"),
        (F.col("k") % 2 == 0).alias("license_verified"),
        F.when(F.col("k") % 5 == 0, "de").otherwise("en").alias("language"),
        *[(F.col("k") % m != 0).alias(c) for c, m in _FLAGS.items()],
        (F.col("n") / 100).alias("backup_size_mb"),
    )


_FLAGS = {
    "has_manifest": 17, "has_metadata": 13, "has_backup": 11, "has_vectors_768": 3, "has_vectors_1536": 4, "links_verified_offline": 7,
    "links_verified_online": 8, "deep_validated": 9, "integrity_passed": 10, "language_verified": 6,
}
_MANIFESTS = f"""s AS (SELECT source, count(*) AS n, min(doc_id) AS k FROM documents GROUP BY source),
m AS (SELECT source AS source_id, CASE WHEN k % 3 = 0 THEN 'Source ' || source END AS name, ['CC BY-SA 4.0', 'MIT', 'Unknown', 'Proprietary', 'Custom', 'cc-by-nc'][k % 6 + 1] AS license,
      k % 6 IN (0, 1, 5) OR (k % 6 = 4 AND k % 4 = 0) AS license_in_allowlist, k % 2 = 0 AS license_verified, k % 5 <> 0 AS language_is_english,
      {", ".join(f"k % {mod} <> 0 AS {c}" for c, mod in _FLAGS.items())}, n / 100 AS backup_size_mb, n FROM s),
g AS (SELECT *, has_manifest AND has_metadata AND has_backup AND license_in_allowlist AND license_verified AND links_verified_offline AND links_verified_online
      AND language_is_english AND backup_size_mb >= 0.1 AND (has_vectors_768 OR has_vectors_1536) AS can_submit FROM m)"""


@query(f"""WITH {_MANIFESTS} SELECT source_id, license_in_allowlist, language_is_english, can_submit, can_submit AND has_vectors_768 AND has_vectors_1536 AND deep_validated
           AND integrity_passed AND language_verified AS can_publish FROM g""")
def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = validate.gates(validate.light(_manifests(spark, sf_dir)))
    return judged.select("source_id", "license_in_allowlist", "language_is_english", "can_submit", "can_publish")


_MISSING = f"""{_MANIFESTS}, f AS (SELECT source_id, unnest([{", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in validate.CHECKS)},
  CASE WHEN has_backup AND backup_size_mb < 0.1 THEN 'backup_size' END]) AS c FROM g), miss AS (SELECT source_id, c FROM f WHERE c IS NOT NULL)"""


@query(f'WITH {_MISSING} SELECT source_id, c AS "check" FROM miss')
def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.missing(validate.light(_manifests(spark, sf_dir))).select("source_id", "check")


@query(f"""WITH {_MISSING} SELECT g.source_id, any_value(can_submit) AS can_submit, count(c) AS n_missing FROM g LEFT JOIN miss USING (source_id) GROUP BY 1""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(validate.light(_manifests(spark, sf_dir))).select("source_id", "can_submit", "n_missing")


_TIER = "CASE WHEN license_verified THEN 'official' WHEN license <> 'Unknown' THEN 'community' ELSE 'personal' END"


@query(f"WITH {_MANIFESTS}, t AS (SELECT source_id, {_TIER} AS tier, n AS doc_count FROM m) SELECT source_id, tier, doc_count, tier <> 'personal' AS downloadable FROM t")
def pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.packs(_manifests(spark, sf_dir), stats.source_stats(corpus(spark, sf_dir))).select("source_id", "tier", "doc_count", "downloadable")


@query("""WITH c AS (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0), i AS (SELECT DISTINCT source FROM documents WHERE lang = 'fr')
SELECT CASE WHEN i.source IS NULL THEN 'unindexed' WHEN c.source IS NULL THEN 'unconfigured' ELSE 'ok' END AS state, count(*) AS n FROM c FULL JOIN i ON c.source = i.source GROUP BY 1""")
def pack_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    configured = docs.filter("doc_id % 3 = 0").select(F.col("source").alias("source_id")).distinct()
    return catalog.health(configured, docs.filter("lang = 'fr'").select("source").distinct())


@query(f"""WITH {_MANIFESTS}, a AS (SELECT DISTINCT source AS source_id FROM documents), p AS (SELECT source_id FROM m WHERE license_verified),
man AS (SELECT * FROM m WHERE has_metadata)
SELECT a.source_id, coalesce(man.name, upper(a.source_id[:1]) || a.source_id[2:]) AS name, coalesce(man.license, 'Unknown') AS license, coalesce(s.n, 0) AS doc_count,
       CASE WHEN p.source_id IS NULL THEN 'not published' WHEN man.source_id IS NULL THEN 'no manifest' ELSE 'included' END AS status
FROM a LEFT JOIN p USING (source_id) LEFT JOIN man USING (source_id) LEFT JOIN s ON s.source = a.source_id""")
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _manifests(spark, sf_dir)
    active = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    published = made.filter("license_verified").select("source_id")
    return catalog.entries(active, published, made.filter("has_metadata").select("source_id", "name", "license"), stats.source_stats(corpus(spark, sf_dir)))


@query("SELECT DISTINCT source AS source_id FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es')")
def active_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), "lang")
    return catalog.active_packs(docs.select("source_id").distinct(), docs.filter("lang = 'es'"))


@query("SELECT vec_id AS doc_id, label, CAST(length(text) AS INT) AS n FROM embeddings JOIN documents ON doc_id = vec_id")
def pack_install(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return catalog.install(v, table(spark, sf_dir, "documents")).select("doc_id", "label", F.length("text").alias("n"))


@query("SELECT vec_id AS doc_id, CAST(coalesce(length(text), 0) AS INT) AS n FROM embeddings LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) ON doc_id = vec_id")
def pack_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.col("text").alias("content"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return catalog.reindex(v, docs).select("doc_id", F.length("content").alias("n"))


# --- pages -------------------------------------------------------------------------------------------------------

_TITLE = r"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), '<[^>]*>', '', 'g')), '')"


@query(f"SELECT page_id, coalesce({_TITLE.format(t='title')}, {_TITLE.format(t='h1')}, nullif(regexp_extract(url, '([^/]*)$', 1), ''), 'Untitled') AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.html_title(F.col("html"), F.col("url")).alias("title"))


_LINKS = r"""list_filter(list_transform(list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1), lambda h: h <> '' AND NOT regexp_matches(h, '^(#|https?://|javascript:|mailto:|tel:)')
  AND NOT regexp_matches(h, '/(Special|File|Category|Template|Help|Talk|User|Wikipedia|Portal):')), lambda h: regexp_extract(h, '^([^#?]*)', 1)), lambda p: p <> '')"""


@query(f"""WITH l AS (SELECT page_id, unnest(list_transform({_LINKS}, lambda p: CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END)) AS link FROM pages) SELECT DISTINCT page_id, link FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(web.internal_links(F.col("html"))).alias("link"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, CASE WHEN len(string_split(host, '.')) >= 2 THEN string_split(host, '.')[-2] ELSE host END AS domain, CAST(len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS INT) AS depth FROM h""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", web.host(url).alias("host"), web.second_level_domain(url).alias("domain"), F.size(web.path_segments(url)).alias("depth"))


@query("SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def host_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(web.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def _detect_sql() -> str:
    quote = lambda p: p.replace("'", "''")
    texts = {"url": "lower(url)", "title": "''"}
    return "CASE" + "".join(f" WHEN regexp_matches({texts[w]}, '{quote(p)}') THEN '{c}'" for c, w, p in language.patterns()) + " END"


@query(f"SELECT page_id, {_detect_sql()} AS language FROM pages")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", language.detect(F.col("url"), F.lit("")).alias("language"))


@query(f"WITH d AS (SELECT page_id, {_detect_sql()} AS language FROM pages) SELECT page_id FROM d WHERE language IS NULL OR language = 'fr'")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(language.keep(F.col("url"), F.lit(""), "fr")).select("page_id")


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to others by number, with and without a leading slash."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("h").alias("host"))
    to = [F.concat(F.lit("/p/"), ((F.col("id") * 7 + k) % 60).cast("string")) for k in range(3)] + [F.concat(F.lit("p/"), (F.col("id") + 1).cast("string")), F.lit("x/0")]
    return pages.withColumns({"url": F.concat(F.lit("https://h/p/"), F.col("id").cast("string")), "local_url": F.concat(F.lit("/x/"), F.col("id").cast("string")), "links": F.array(*to)})


@query("""WITH p AS (SELECT page_id AS id FROM pages), l AS (SELECT id, unnest([(id * 7) % 60, (id * 7 + 1) % 60, (id * 7 + 2) % 60, id + 1, 0]) AS "to" FROM p),
e AS (SELECT l.id AS src, l."to" AS dst FROM l JOIN p ON p.id = l."to" WHERE l.id <> l."to")
SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e""")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.link_edges(_linked_pages(spark, sf_dir))
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


@query(r"""SELECT doc_id, CASE WHEN contains(name, '_') AND contains(split_part(name, '_', 1), '.') AND NOT starts_with(name, '.') THEN 'https://' || split_part(name, '_', 1) || '/' || replace(name[length(split_part(name, '_', 1)) + 2:], '_', '/') ELSE '/' || name END AS url,
 replace(name, '_', ' ') AS title FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'www.' || source || '.org_' || lang || '_' || doc_id ELSE source || '_page_' || doc_id END AS name FROM documents)""")
def filename_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("www."), "source", F.lit(".org_"), "lang", F.lit("_"), number)).otherwise(F.concat("source", F.lit("_page_"), number))
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat(name, F.lit(".html")).alias("f"))
    return named.select("doc_id", web.filename_to_url(F.col("f")).alias("url"), web.filename_to_title(F.col("f")).alias("title"))


# --- sessions, transcripts, jobs ---------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_messages(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn").cast("double") * 25
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.concat(F.lit("seg_"), F.col("turn").cast("string")).alias("segment_id"), start.alias("start_sec"), (start + 20).alias("end_sec"), "text"
    )


@query("""SELECT a.conv_id AS video_id, 'c' || a.turn AS chunk_id, 'seg_' || b.turn AS segment_id FROM conversations a JOIN conversations b USING (conv_id)
WHERE a.turn % 2 = 0 AND b.turn * 25 + 20 >= a.turn * 25 AND b.turn * 25 <= a.turn * 25 + 50""")
def transcript_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    start = F.col("turn").cast("double") * 25
    parts = table(spark, sf_dir, "conversations").filter("turn % 2 = 0")
    parts = parts.select(F.col("conv_id").alias("video_id"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("chunk_id"), start.alias("start_sec"), (start + 50).alias("end_sec"))
    return sessions.overlaps(parts, segments)


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent(table(spark, sf_dir, "events")).select("event_id", "recent")


_JOBS = "jobs AS (SELECT event_id AS id, event_type AS job_type, CASE WHEN value > 50 THEN 'passed' ELSE 'failed' END AS status, ts AS completed_at, CAST(event_id % 4 * 384 AS INT) AS dimension FROM events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") > 50, "passed").otherwise("failed")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("job_type"), status.alias("status"), F.col("ts").alias("completed_at"), (F.col("event_id") % 4 * 384).cast("int").alias("dimension"))


@query(f"WITH {_JOBS} SELECT id, job_type, status FROM jobs WHERE completed_at >= TIMESTAMP '2024-01-03' ORDER BY completed_at DESC, id LIMIT 100")
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.history(_jobs(spark, sf_dir), "2024-01-03").select("id", "job_type", "status")


@query(f"WITH {_JOBS} SELECT count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM jobs")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.status_summary(_jobs(spark, sf_dir))


@query(f"""WITH {_JOBS} SELECT d.dimension, coalesce(arg_max(status, id), 'idle') AS status FROM (VALUES (384), (768), (1024), (1536)) d(dimension) LEFT JOIN jobs ON jobs.dimension = d.dimension GROUP BY 1""")
def dimension_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest_by_domain(_jobs(spark, sf_dir), "dimension", (384, 768, 1024, 1536), "id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- scalars -----------------------------------------------------------------------------------------------------

_LINES = "lines AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)


@query(f"""WITH {_LINES}, c AS (SELECT CASE WHEN lower(line) = '' THEN 'unknown'{"".join(f" WHEN {_has('lower(line)', words)} THEN '{name}'" for name, words in licence.CATEGORIES.items())} ELSE 'unknown' END AS category FROM lines)
SELECT category, category IN ('public_domain', 'open_access') AS hostable, count(*) AS n FROM c GROUP BY ALL""")
def licence_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _lines(spark, sf_dir).select(licence.category(F.col("line")).alias("category"))
    return named.groupBy("category", licence.hostable(F.col("category")).alias("hostable")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {_LINES}, l AS (SELECT lower(line) AS t FROM lines), f AS (SELECT CASE
 WHEN regexp_matches(t, 'creative\s*commons.*share\s*alike|cc[- ]by[- ]sa|attribution.*sharealike') THEN 'CC-BY-SA'
 WHEN regexp_matches(t, 'cc[- ]by') AND NOT regexp_matches(t, 'cc[- ]by[- ](sa|nc)') THEN 'CC-BY'
 WHEN regexp_matches(t, 'creative\s*commons.*non\s*commercial') OR (regexp_matches(t, 'cc[- ]by[- ]nc') AND NOT regexp_matches(t, 'cc[- ]by[- ]nc[- ]sa')) THEN 'CC-BY-NC'
 WHEN regexp_matches(t, 'cc[- ]by[- ]nc[- ]sa|attribution.*noncommercial.*sharealike') THEN 'CC-BY-NC-SA'
 WHEN regexp_matches(t, 'cc0|public\s*domain\s*dedication|creative\s*commons\s*zero') THEN 'CC0'
 WHEN regexp_matches(t, 'public\s*domain|no\s*copyright|free\s*of\s*known\s*copyright') THEN 'Public Domain'
 WHEN regexp_matches(t, 'mit\s*license|permission\s*is\s*hereby\s*granted.*mit') THEN 'MIT'
 WHEN regexp_matches(t, 'gnu\s*general\s*public\s*license|gpl[- ]?\d') THEN 'GPL'
 WHEN regexp_matches(t, 'open\s*access|freely\s*available') THEN 'Open Access' END AS family FROM l)
SELECT family, count(*) AS n FROM f GROUP BY family""")
def licence_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy(licence.family(F.col("line")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TAGS}, u AS (SELECT DISTINCT tag FROM tags) SELECT tag, {_normalised('tag')} AS normal FROM u")
def tag_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("tag").distinct().select("tag", tags.normalise(F.col("tag")).alias("normal"))


@query("SELECT doc_id, doc_id % 100 * 3600 + doc_id % 60 * 60 + doc_id % 59 AS seconds, CAST(doc_id % 60 * 60 + doc_id % 59 + 0.5 AS DOUBLE) AS code FROM documents")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    made = table(spark, sf_dir, "documents").select("doc_id", F.format_string("PT%dH%dM%dS", n % 100, n % 60, n % 59).alias("d"), F.format_string("%02d:%02d,500", n % 60, n % 59).alias("c"))
    return made.select("doc_id", times.duration_seconds(F.col("d")).cast("long").alias("seconds"), times.code_seconds(F.col("c")).alias("code"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN printf('20%02d-%02d-%02dT10:20:30', doc_id % 90 + 10, doc_id % 12 + 1, doc_id % 28 + 1) WHEN 1 THEN printf('20%02d-%02d-%02d', doc_id % 90 + 10, doc_id % 12 + 1, doc_id % 28 + 1)
 ELSE printf('20%02d', doc_id % 90 + 10) END AS iso FROM documents""")
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    day = F.format_string("20%02d%02d%02d", n % 90 + 10, n % 12 + 1, n % 28 + 1)
    text = F.when(n % 3 == 0, F.concat(F.lit("D:"), day, F.lit("102030Z"))).when(n % 3 == 1, day).otherwise(F.left(day, F.lit(4)))
    return table(spark, sf_dir, "documents").select("doc_id", times.pdf_date(text).alias("iso"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE printf('abcdefg%04d', doc_id % 10000) END AS video FROM documents")
def youtube_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 4
    key = F.format_string("abcdefg%04d", F.col("doc_id") % 10000)
    url = (
        F.when(n == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), key, F.lit("&t=3")))
        .when(n == 1, F.concat(F.lit("https://youtu.be/"), key))
        .when(n == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), key))
        .otherwise(F.concat(F.lit("https://example.org/watch?v="), key))
    )
    return table(spark, sf_dir, "documents").select("doc_id", web.youtube_id(url).alias("video"))


@query("SELECT doc_id, '10.1234/ab.' || doc_id AS doi FROM documents")
def dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" doi:10.1234/ab."), F.col("doc_id").cast("string"), F.lit("., and more"))
    return table(spark, sf_dir, "documents").select("doc_id", web.doi(text).alias("doi"))


@query("""SELECT doc_id, CASE WHEN length(split_part(text, chr(10), 1)) > 80 THEN split_part(text, chr(10), 1)[:77] || '...' ELSE split_part(text, chr(10), 1) END AS title,
 CASE WHEN length(text) > 200 THEN text[:200] || '...' ELSE text END AS snippet FROM documents""")
def short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", tx.short_title(F.col("title")).alias("title"), tx.snippet(F.col("content"), 200).alias("snippet"))


@query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://h/x/' || page_id WHEN 1 THEN 'https://www.a.gov/p/' || page_id WHEN 2 THEN 'https://b.org/p/' || page_id
 WHEN 3 THEN 'https://base/wiki/p/' || page_id ELSE 'https://base/wiki/c.d/' || page_id END AS online FROM pages""")
def online_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    path = F.when(k == 0, "https://h/x/").when(k == 1, "/www.a.gov/p/").when(k == 2, "b.org/p/").when(k == 3, "/p/").otherwise("c.d/")
    return table(spark, sf_dir, "pages").select("page_id", web.online_url(F.concat(path, n), F.lit("https://base/wiki/")).alias("online"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/zim/s/A/' || page_id WHEN 1 THEN 'https://h/' || page_id END AS url FROM pages")
def browsable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    url = F.when(k == 0, F.concat(F.lit("zim://s/A/"), n)).when(k == 1, F.concat(F.lit("https://h/"), n)).otherwise("zim://s")
    return table(spark, sf_dir, "pages").select("page_id", web.browsable_url(url).alias("url"))


@query("""SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'a.org/css/' || page_id ELSE NULL END AS entry FROM pages WHERE page_id % 2 = 0""")
def asset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("n", F.col("page_id").cast("string"))
    asked = pages.select(F.col("page_id").alias("id"), web.web_asset_candidates(F.concat(F.lit("/css/"), "n"), F.array(F.lit("www.b.org"), F.lit("www.a.org"))).alias("candidates"))
    index = pages.filter("page_id % 2 = 0").select(F.concat(F.lit("a.org/css/"), "n").alias("url"), F.concat(F.lit("a.org/css/"), "n").alias("entry"))
    return catalog.first_match(asked, index).select(F.col("id").alias("page_id"), "entry")


@query(f"""WITH c AS (SELECT page_id, unnest(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '' AND NOT regexp_matches(p, '\\.html?$'))) AS raw FROM pages),
t AS (SELECT page_id, lower(trim(raw)) AS tag FROM c) SELECT DISTINCT page_id, {_normalised("tag")} AS category FROM t""")
def url_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(web.url_categories(F.col("url"), F.col("html"))).alias("category"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:10], lambda x: trim(x)) AS ls FROM documents)
SELECT doc_id, coalesce(list_filter(ls, lambda x: length(x) > 10 AND length(x) < 200 AND NOT regexp_matches(x, '(?i)page|vol\\.|volume|journal|copyright|doi:'))[1], '') AS title FROM l""")
def paper_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.parts(table(spark, sf_dir, "documents")).select("doc_id", "title")


@query(r"""SELECT doc_id, length(trim(l)) > 3 AND len(regexp_extract_all(trim(l), '\p{L}')) * 2 >= length(trim(l)) AND regexp_matches(trim(l), '\S\s+\S') AND NOT regexp_matches(trim(l), '^v?\d+([./-]\d+)+$') AS worth
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS l FROM documents)""")
def translatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", models.should_translate(F.col("title")).alias("worth"))


@query(f"""WITH {_MANIFESTS}, f AS (SELECT source_id FROM m WHERE has_manifest), x AS (SELECT source AS source_id, n AS count FROM s WHERE k % 5 <> 1)
SELECT coalesce(f.source_id, x.source_id) AS source_id, coalesce(x.count, 0) AS doc_count, f.source_id IS NULL AS is_orphaned, x.source_id IS NULL AS needs_validation
FROM f FULL JOIN x ON f.source_id = x.source_id""")
def local_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = _manifests(spark, sf_dir).filter("has_manifest").select("source_id")
    master = stats.source_stats(corpus(spark, sf_dir)).join(table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("k")), "source")
    return catalog.local_sources(folders, master.filter("k % 5 <> 1"))


@query(f"""WITH {_MANIFESTS} SELECT source_id, (has_backup AND has_metadata AND has_manifest) AS is_complete FROM m WHERE has_manifest ORDER BY 2 DESC, 1 LIMIT 10""")
def uploadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.uploadable(_manifests(spark, sf_dir).filter("has_manifest")).limit(10)


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://wiki/' || page_id ELSE 'https://h/' || page_id END AS url, CASE WHEN page_id % 2 = 0 THEN 'zim://w/' || page_id END AS local_url FROM pages""")
def repaired_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("zim://w/"), n)).otherwise(F.concat(F.lit("https://h/"), n))
    docs = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.lit(None).cast("string").alias("local_url"))
    return catalog.repair_urls(docs, "zim://w/", "https://wiki/")


@query("""WITH a AS (SELECT source, count(*) AS count, sum(length(text)) AS chars FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), b AS (SELECT source, count(*) AS count, sum(length(text)) AS chars FROM documents WHERE source <> 'src5' GROUP BY 1)
SELECT count(*) FILTER (a.source IS NULL) AS added, count(*) FILTER (b.source IS NULL) AS removed, count(*) FILTER (a.source IS NOT NULL AND b.source IS NOT NULL AND (a.count <> b.count OR a.chars <> b.chars)) AS updated,
 count(*) FILTER (a.count = b.count AND a.chars = b.chars) AS unchanged FROM a FULL JOIN b ON a.source = b.source""")
def master_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return stats.stats_changes(stats.source_stats(docs.filter("doc_id % 3 <> 0")), stats.source_stats(docs.filter("source <> 'src5'")))


@query("""SELECT event_id, CASE WHEN value < 10 THEN 'offline' WHEN value < 20 THEN 'disconnected' WHEN value < 40 THEN 'unstable' ELSE 'online' END AS state FROM events""")
def connection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, no = F.col("value"), F.lit(False)
    mode = F.when(v < 10, "offline_only").when(v < 20, "online_only").otherwise("hybrid")
    failures = F.when(v < 40, 2).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", classify.connection_state(mode, no, no, v >= 20, failures, no, no).alias("state"))


@query("""SELECT source AS pdf, CAST(sum(length(trim(text))) AS BIGINT) AS total_chars, count(*) FILTER (length(trim(text)) > 0) AS text_pages, count(*) AS pages, sum(length(trim(text))) >= 500 AS usable FROM documents GROUP BY 1""")
def pdf_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.pdf_text_stats(table(spark, sf_dir, "documents").select(F.col("source").alias("pdf"), "text"))


@query("""SELECT conv_id AS video_id, 'dir/' || conv_id || CASE WHEN conv_id % 4 = 0 THEN '.json' WHEN conv_id % 4 = 1 THEN '.srt' ELSE '.txt' END AS path FROM conversations GROUP BY conv_id""")
def best_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    k = F.col("conv_id") % 4
    ends = F.when(k == 0, F.array(F.lit(".vtt"), F.lit(".json"))).when(k == 1, F.array(F.lit(".txt"), F.lit(".srt"), F.lit(".vtt"))).otherwise(F.array(F.lit(".txt"), F.lit(".pdf")))
    return archives.best_captions(videos.select(F.col("conv_id").alias("video_id"), "conv_id", F.explode(ends).alias("e")).select("video_id", F.concat(F.lit("dir/"), F.col("conv_id").cast("string"), "e").alias("path")))


@query("""SELECT conv_id AS video_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, turn * 2.5 AS start_sec, turn * 2.5 + 2 AS end_sec, trim(text) AS text FROM conversations WHERE trim(text) <> ''""")
def json_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct((F.col("turn") * 2.5).cast("double").alias("start"), F.lit(2.0).alias("duration"), "text")
    lists = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.sort_array(F.collect_list(turn)).alias("segments"))
    return archives.json_captions(lists.select("video_id", F.to_json(F.struct("segments")).alias("text")))


@query("SELECT DISTINCT source AS source_id FROM documents WHERE source IS NOT NULL")
def published_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    listing = docs.select(F.concat("source", F.lit("/pages/"), F.col("doc_id").cast("string")).alias("key"))
    return archives.published(docs.select(F.col("source").alias("source_id")).filter("source_id is not null").distinct(), listing)


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS total FROM documents)
SELECT doc_id FROM n WHERE i >= total // 10 AND (i - total // 10) % (total // 20) = 0 AND (i - total // 10) // (total // 20) < 10""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.systematic(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10)


@query("""WITH c AS (SELECT count(*) AS sitemaps, CAST(sum(CASE WHEN page_id < 5 THEN page_id % 7 + 1 END) AS BIGINT) AS counted FROM pages)
SELECT sitemaps, counted, CAST(CASE WHEN sitemaps > 5 THEN round(counted / least(sitemaps, 5) * sitemaps) ELSE counted END AS BIGINT) AS estimated FROM c""")
def sitemap_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.repeat(F.lit("<url><loc> https://h/x </loc></url>"), (F.col("page_id") % 7 + 1).cast("int"))
    return archives.sitemap_profile(table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), text.alias("text")))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.keep_first(table(spark, sf_dir, "documents").select("text", "doc_id"), ["text"], "doc_id")


@query("""SELECT source AS source_id, true AS has_manifest, bool_or(doc_id % 20 = 1) AS has_metadata, false AS has_index, array_to_string(list_sort(list_distinct(list(CASE WHEN doc_id % 20 = 2 THEN 1536 WHEN doc_id % 20 = 3 THEN 768 END))), ',') AS dimensions,
 bool_or(doc_id % 20 >= 4) AS has_content, bool_or(doc_id % 20 = 1) AND bool_or(doc_id % 20 >= 4) AND bool_or(doc_id % 20 IN (2, 3)) AS is_complete FROM documents GROUP BY 1""")
def pack_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 20
    name = F.when(k == 0, "_manifest.json").when(k == 1, "_metadata.json").when(k == 2, "_vectors.json").when(k == 3, "_vectors_768.json").otherwise("p.html")
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.explode(F.array(name, F.lit("_manifest.json"))).alias("filename"))
    found = validate.completeness(files)
    return found.withColumn("dimensions", F.array_join(F.transform("dimensions", lambda d: d.cast("string")), ","))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 10")
def recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy(F.desc("doc_id")).limit(10)


@query("SELECT doc_id, length(text) AS n FROM documents ORDER BY length(text) DESC, doc_id LIMIT 10")
def longest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")).orderBy(F.desc("n"), "doc_id").limit(10)


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE contains(lower(title), 'the')")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter(F.contains(F.lower("title"), F.lit("the"))).select("doc_id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_store(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id")


# --- what SQL can't express --------------------------------------------------------------------------------------


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(table(spark, sf_dir, "pages")).filter("char_count >= 50")


@query()
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_pages(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("pages")))


@query()
def smart_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_text(table(spark, sf_dir, "documents"))


@query("""WITH RECURSIVE s AS (SELECT conv_id AS v, CAST(turn * 25 AS DOUBLE) AS st, 'seg_' || turn AS id, CAST(turn * 25 + 20 AS DOUBLE) AS e, text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn * 25, 'seg_' || turn) AS rn FROM conversations),
g AS (SELECT v, rn, st AS anchor, 1 AS chunk FROM s WHERE rn = 1 UNION ALL
  SELECT s.v, s.rn, CASE WHEN s.st - g.anchor > 60 THEN s.st ELSE g.anchor END, g.chunk + CASE WHEN s.st - g.anchor > 60 THEN 1 ELSE 0 END FROM g JOIN s ON s.v = g.v AND s.rn = g.rn + 1)
SELECT s.v AS video_id, CAST(g.chunk AS INT) AS chunk, min(st) AS start_sec, max(e) AS end_sec, coalesce(string_agg(text, ' ' ORDER BY st, id), '') AS text, count(*) AS n_segments
FROM s JOIN g ON g.v = s.v AND g.rn = s.rn GROUP BY 1, 2""")
def segment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.group_segments(_segments(spark, sf_dir))


@query()
def pca_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.points(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query()
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(corpus(spark, sf_dir).withColumn("url", F.lit("")))
    return document_types.classify(docs).select("doc_id", F.explode("types").alias("t")).select("doc_id", "t.type", "t.confidence")


@query()
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_types.report(document_types.classify(spread(corpus(spark, sf_dir).withColumn("url", F.lit("")))))


@query()
def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two numbered headers put before their text."""
    page = F.concat(F.lit("1\nFirst heading here\n"), "text", F.lit("\n1.1 Second heading here\n"), "text")
    return papers.split_sections(table(spark, sf_dir, "documents").select("doc_id", F.array(page).alias("pages")))


@query()
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.embed(table(spark, sf_dir, "documents"), models.Hashing)
