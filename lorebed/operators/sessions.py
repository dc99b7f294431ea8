"""Conversations, transcripts and job logs: windows over ordered rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_messages(turns: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` messages of each session (conv_id, turn)."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def overlaps(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of the same video that touch a chunk's time, ends included. The video is an equi-key, so this is no cross product."""
    c, s = chunks.alias("c"), segments.alias("s")
    touch = (F.col("s.end_sec") >= F.col("c.start_sec")) & (F.col("s.start_sec") <= F.col("c.end_sec"))
    return c.join(s, (F.col("c.video_id") == F.col("s.video_id")) & touch).select("c.video_id", "c.chunk_id", "s.segment_id")


def number_segments(videos: DataFrame, prefix: str = "seg") -> DataFrame:
    """Explode arrays of segments (video_id, segments); blank ones are dropped after numbering, so numbers have gaps."""
    rows = videos.select("video_id", F.posexplode("segments").alias("i", "s"))
    start = F.round(F.coalesce("s.start_sec", F.lit(0.0)), 3)
    end = F.round(F.greatest(F.coalesce("s.end_sec", F.lit(0.0)), start), 3)
    named = rows.select("video_id", F.concat(F.lit(prefix + "_"), F.col("i") + 1).alias("segment_id"), start.alias("start_sec"), end.alias("end_sec"), F.trim("s.text").alias("text"))
    return named.filter(F.length("text") > 0)


def group_segments(segments: DataFrame, longest: float = 60.0) -> DataFrame:
    """Chunks of consecutive segments: a new one starts where a segment begins more than ``longest`` seconds after the chunk.

    Each start depends on the chunk before, so a video's segments pass in order through one function a task, which keeps
    the chunk's start alone: no video is gathered.
    """
    kinds = dict(segments.dtypes)
    names = ["video_id", "start_sec", "segment_id", "end_sec", "text"]

    def run(batches):
        video, anchor, chunk = None, None, 0
        for batch in batches:
            numbers = []
            for own, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk == 0 or own != video:
                    video, anchor, chunk = own, start, 1
                elif start is not None and (anchor is None or start - anchor > longest):
                    anchor, chunk = start, chunk + 1
                numbers.append(chunk)
            yield pa.record_batch([*batch.columns, pa.array(numbers, type=pa.int32())], names=[*names, "chunk"])

    ordered = segments.select(names).repartition("video_id").sortWithinPartitions(*names)
    flat = ordered.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", chunk int")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_sec", "segment_id", "text"))), lambda r: r["text"]), " ")
    return flat.groupBy("video_id", "chunk").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), texts.alias("text"), F.count(F.lit(1)).alias("n_segments")
    )


def topic_of(answer: Column) -> Column:
    """(topic, keywords) in a language model's lines "Topic: ..." and "Keywords: a, b"; of several the last, without list marks."""
    plain = F.replace(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?m)^[ \t*-]+", ""), F.lit("**"), F.lit(""))

    def last(name: str) -> Column:
        found = F.regexp_extract_all(plain, F.lit(rf"(?im)^\s*{name}\s*:[ \t]*(\S.*?)\s*$"), F.lit(1))
        return F.try_element_at(found, F.lit(-1))

    words = F.filter(F.transform(F.split(F.coalesce(last("keywords?"), F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")
    return F.struct(last("topic").alias("topic"), words.alias("keywords"))


def topics(chunks: DataFrame) -> DataFrame:
    """Chunks (video_id, chunk, answer) with topic and keywords; one without a topic is called by its number."""
    told = topic_of(F.col("answer"))
    return chunks.select("video_id", "chunk", F.coalesce(told["topic"], F.concat(F.lit("Segment "), F.col("chunk"))).alias("topic"), told["keywords"].alias("keywords"))


def in_english(segments: DataFrame, translate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Segments (video_id, segment_id, start_sec, end_sec, text, language) in English: those of other languages through ``translate``.

    ``translate`` adds ``translated`` to rows with ``text``. Ids are carried as they are, also as original_segment_id.
    """
    is_english = F.coalesce("language", F.lit("en")) == "en"
    own = segments.filter(is_english).withColumn("translated", F.col("text"))
    other = segments.filter(~is_english)
    both = own.unionByName(translate(other).select(*segments.columns, "translated")) if translate else own
    return both.select(
        "video_id", "segment_id", F.col("segment_id").alias("original_segment_id"), "start_sec", "end_sec", F.col("translated").alias("text"),
        F.lit("en").alias("language"), F.coalesce("language", F.lit("en")).alias("original_language"),
    )


def transcripts(segments: DataFrame) -> DataFrame:
    """One row a video: the texts that aren't blank, in order, a blank line between them."""
    told = segments.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    parts = F.sort_array(F.collect_list(F.struct("start_sec", "segment_id", "text")))
    return told.groupBy("video_id").agg(F.array_join(F.transform(parts, lambda r: r["text"]), "\n\n").alias("full_text"), F.count(F.lit(1)).alias("n_segments"))


def recent(events: DataFrame, seconds: int = 300) -> DataFrame:
    """How many events of the same user fall into the ``seconds`` up to each; events: user_id, ts."""
    at = F.unix_timestamp("ts")
    window = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(window))


def allowed(requests: DataFrame, a_minute: dict[str, int], otherwise: int = 30) -> DataFrame:
    """Requests (client, kind, ts) with ``ok``: whether the client had fewer of the kind than allowed in the minute before."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    before = Window.partitionBy("client", "kind").orderBy(at).rangeBetween(-60_000, -1)
    limits = F.create_map(*[F.lit(x) for pair in a_minute.items() for x in pair]) if a_minute else F.create_map().cast("map<string,int>")
    return requests.withColumn("ok", F.count(F.lit(1)).over(before) < F.coalesce(limits[F.col("kind")], F.lit(otherwise)))


def history(jobs: DataFrame, cutoff: str, limit: int = 100) -> DataFrame:
    """Jobs completed since ``cutoff``, newest first."""
    return jobs.filter(F.col("completed_at") >= F.lit(cutoff).cast("timestamp")).orderBy(F.desc("completed_at"), "id").limit(limit)


def latest_by_domain(jobs: DataFrame, key: str, domain: tuple[int, ...], order: str) -> DataFrame:
    """For each value of a fixed domain, the status of the latest job; idle if there is none."""
    values = jobs.sparkSession.createDataFrame([(x,) for x in domain], f"{key} int")
    last = jobs.groupBy(key).agg(F.max_by("status", order).alias("status"))
    return values.join(last, key, "left").select(key, F.coalesce("status", F.lit("idle")).alias("status"))
