"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. A document's size is its number of words. Sources in code point order (null last) weigh
``weights`` in turn and share all words; no source's target passes ``epochs`` times its size: what a clamped source can't
take goes to the others by weight, until none is above. The level at which that ends is found at once: sources are put in
the order in which they clamp, and running sums tell from where on nobody does.

A source repeats each document floor(target / size) times, and some once more: documents stand in a seeded order (the MD5 of
seed, id and text; rows that agree in these stand by their place in the stored table), and those go in whose words, added up,
end at or before the words that are missing; then one more goes in, of those left the one whose size is nearest to what
is still missing, if that comes nearer. The order is never made in one task: sums by source and the order's first digits
tell where it is cut, sums by stored file where equal rows are, and a row's own place then tells whether it goes in.

Nulls and other cases: a null or wordless text has size 0 and is taken 0 words; a null source is a source, the last; null
doc_ids, repeated doc_ids and repeated rows are mixed like others, each row for itself (of rows that agree in id and text as many
go in as fit); an empty table gives no rows; further columns are ignored by ``mix`` and kept by ``repeat_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WORD = r"[^\x20\x09-\x0D]+"
PARTS = 3  # hex digits that part the seeded order: 4,096 parts of each source


def targets(sources: DataFrame, weights: tuple[float, ...], epochs: float) -> DataFrame:
    """Add rank, weight, total and target to one row a source (source, source_size)."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    # Sources clamp in the order of cap / weight. What is left of the total and of the weights, as each comes up:
    up_to = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    staged = weighed.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)),
            "rest_weight": F.sum("weight").over(onward),
        }
    )
    level = F.col("rest") / F.col("rest_weight")
    # The first source that doesn't clamp sets the level for itself and all after it.
    staged = staged.withColumn("free", F.col("weight") * level <= F.col("cap"))
    staged = staged.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", level.alias("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return staged.withColumn("target", target).select("source", "source_size", "rank", "weight", "total", "target")


def _order(seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _placed(stored: DataFrame, *columns) -> DataFrame:
    """``columns`` of a stored table, and where each row is stored: file and line."""
    at = stored.metadataColumn("_metadata")
    return stored.select(*columns, at["file_path"].alias("file"), at["row_index"].alias("line"))


def _edges(sums: DataFrame, *order: str) -> DataFrame:
    """The row of each source's ``sums`` (s, *order, words, missing) in which its missing words end; ``missing`` is then what is missing there."""
    running = Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    last = sums.filter("before <= missing and missing < before + words")
    return last.select("s", *order, (F.col("missing") - F.col("before")).alias("missing"))


def goals(rows: DataFrame, weights: tuple[float, ...], epochs: float) -> DataFrame:
    """One row a source: s, source_size, target, whole repeats, and which rows (source, order, file, line) go in once more.

    Those are the rows before cut_order, those at it that are stored before (cut_file, cut_line), and the one at (pick_file, pick_line).
    """
    own = rows.select(F.col("source").alias("s"), "size", "order", "file", "line", F.substring("order", 1, PARTS).alias("part"))
    sums = durable(own.groupBy("s", "part").agg(F.sum("size").alias("words")), "words")
    goal = targets(sums.groupBy(F.col("s").alias("source")).agg(F.sum("words").alias("source_size")), weights, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(rate).cast("long"))
    goal = goal.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = durable(goal.withColumnRenamed("source", "s").select("s", "source_size", "target", "whole", "missing"), "goals")
    # One row a source, so small unless sources are many; Spark then joins by shuffle and splits hot ones.
    few = (lambda df: F.broadcast(df)) if goal.count() <= 100_000 else (lambda df: df)
    # The part where the missing words end, in it the order and (of rows equal in order) the file, and in that the line.
    need = few(goal.select(F.col("s").alias("n"), "missing"))
    parts = few(_edges(sums.join(need, F.col("s").eqNullSafe(F.col("n"))), "part").toDF("n", "p", "missing"))
    inside = own.join(parts, F.col("s").eqNullSafe(F.col("n")) & (F.col("part") == F.col("p")))
    inside = inside.groupBy("s", "order", "file").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    edges = _edges(inside, "order", "file").toDF("e", "cut_order", "cut_file", "missing")
    edges = durable(edges, "edges")
    stored = own.join(few(edges), F.col("s").eqNullSafe(F.col("e")) & (F.col("order") == F.col("cut_order")) & (F.col("file") == F.col("cut_file")))
    # Rows equal in order are equal in size.
    line = F.row_number().over(Window.partitionBy("s").orderBy("line"))
    lines = stored.withColumn("k", line).filter(F.col("k") == F.floor(F.col("missing") / F.col("size")) + 1)
    cuts = lines.select(F.col("s").alias("os"), "cut_order", "cut_file", "line", (F.col("missing") % F.col("size")).alias("rest"))
    goal = goal.join(cuts, F.col("s").eqNullSafe(F.col("os")), "left")
    # A source without an edge misses nothing, or as much as it has (then all its rows fit).
    goal = goal.select(
        "s", "source_size", "target", "whole",
        F.coalesce("cut_order", F.when(F.col("missing") > 0, F.lit("g")).otherwise(F.lit(""))).alias("cut_order"),
        F.coalesce("cut_file", F.lit("")).alias("cut_file"), F.coalesce(F.col("line"), F.lit(0)).alias("cut_line"),
        F.coalesce("rest", F.lit(0.0)).alias("rest"),
    )
    goal = durable(goal, "cuts")
    # Of the rows left, the one nearest in size to the rest.
    named = goal.withColumnRenamed("s", "g")
    left = own.join(few(named.filter("rest > 0")), F.col("s").eqNullSafe(F.col("g"))).filter(~_before_cut() & (F.col("size") > 0))
    gap = F.abs(F.col("rest") - F.col("size"))
    nearest = left.groupBy("s").agg(F.min(F.struct(gap.alias("gap"), "order", "file", "line")).alias("n"), F.first("rest").alias("rest"))
    nearest = nearest.filter("n.gap < rest").select(F.col("s").alias("ns"), F.col("n.file").alias("pick_file"), F.col("n.line").alias("pick_line"))
    return durable(goal.join(nearest, F.col("s").eqNullSafe(F.col("ns")), "left").drop("ns", "rest"), "mix")


def _before_cut():
    same = F.col("order") == F.col("cut_order")
    earlier = (F.col("file") < F.col("cut_file")) | ((F.col("file") == F.col("cut_file")) & (F.col("line") < F.col("cut_line")))
    return (F.col("order") < F.col("cut_order")) | (same & earlier)


def assign(rows: DataFrame, goal: DataFrame, worded) -> DataFrame:
    """Add source_size, target and repeats to rows of (source, order, file, line, ...); only ``worded`` ones repeat."""
    goal = F.broadcast(goal) if goal.count() <= 100_000 else goal
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
    picked = (F.col("file") == F.col("pick_file")) & (F.col("line") == F.col("pick_line"))
    more = _before_cut() | F.coalesce(picked, F.lit(False))
    repeats = F.when(worded, F.col("whole") + more.cast("long")).otherwise(0)
    return placed.withColumn("repeats", repeats.cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source).

    Returns per row: doc_id, size, source, source_size, target (its source's), repeats, taken.
    """
    stored = durable(docs.select("doc_id", "source", _size().alias("size"), _order(seed).alias("order")), "sizes")
    rows = _placed(stored, "doc_id", "source", "size", "order")
    taken = assign(rows, goals(rows, weights, epochs), F.col("size") > 0)
    taken = taken.withColumn("taken", F.col("size") * F.col("repeats"))
    return taken.select("doc_id", "size", "source", "source_size", "target", "repeats", "taken")


def _stored(docs: DataFrame) -> DataFrame:
    """``docs`` if it reads files and nothing else, so that each row has a lasting place; else a stored copy."""
    scan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return docs if scan and "_metadata" not in [c.lower() for c in docs.columns] else durable(docs, "documents")


def repeat_rows(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept."""
    names = docs.columns
    # Positions for names, so that no column clashes.
    docs = _stored(docs.toDF(*[f"c{i}" for i in range(len(names))]) if "_metadata" in [c.lower() for c in names] else docs)
    by_name = dict(zip([c.lower() for c in names], docs.columns, strict=True))
    doc_id, text, source = (F.col(by_name[c]).alias(c) for c in ("doc_id", "text", "source"))
    texts = _placed(docs, F.struct("*").alias("row"), doc_id, text, source)
    order = _order(seed).alias("order")
    sizes = durable(texts.select("source", _size().alias("size"), order, "file", "line"), "sizes")
    rows = texts.select("row", "source", order, F.regexp_like("text", F.lit(WORD)).alias("worded"), "file", "line")
    taken = assign(rows, goals(sizes, weights, epochs), F.coalesce("worded", F.lit(False))).filter("repeats > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select("row.*").toDF(*names)
