"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cells floor((a_k . x + b_k) / width) of ``projections`` Gaussian directions. A query visits,
in each table, its own bucket and those that its position within the cells makes likeliest next: perturbation sets in
ascending order of the summed squared distances to the cell walls they cross. Candidates of all tables meet for exact
distances in double precision.

Equal vectors are one candidate with its smallest ids, so a vector that a third of the rows share fills no bucket. A bucket's
queries come first in its partition and its candidates stream past them, so no bucket is ever held; buckets of more
than ``block`` candidates or ``ask`` queries are dealt to several tasks, each part of the ones meeting each part of the others. The width is the smallest that reaches the wanted recall on a
bounded sample of rows (a sample is sparser than the table, so its neighbours are farther and harder to find).

Queries whose probes reach fewer than ``k`` candidates (outliers, sparse clusters beside dense ones), and all queries where no
width reaches the wanted recall, are answered exactly: blocks of these queries meet blocks of all candidates.

Nulls and other cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no
part; a null id takes no part; ties go to the smaller id; of rows with one id the ranks are those of all of them; a table with
fewer candidates than ``k`` gives what it has; an empty one gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, sampled

SAMPLE = 8_000
WIDTHS = (0.6, 0.8, 1.0, 1.2, 1.4, 1.7, 2.0, 2.4, 2.8, 3.4, 4.0, 5.0, 6.0)  # in units of the sample's distances


class Hashes:
    """``tables`` p-stable hash tables over vectors of ``dims`` components."""

    def __init__(self, dims: int, width: float, tables: int, projections: int, probes: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.width, self.tables, self.projections, self.probes = width, tables, projections, probes
        self.reached = True  # the wanted recall, on the sample
        self.directions = rng.normal(size=(dims, tables * projections))
        self.shift = rng.uniform(0, 1, tables * projections)
        self.mix = rng.integers(1, 1 << 62, size=projections, dtype=np.int64) * 2 + 1

    def _positions(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions / self.width + self.shift).reshape(len(x), self.tables, self.projections)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket (a long) of each vector in each table."""
        cells = np.floor(self._positions(x)).astype(np.int64)
        with np.errstate(over="ignore"):
            return (cells * self.mix).sum(axis=2)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The buckets that each vector visits in each table, likeliest first."""
        at = self._positions(x)
        cells = np.floor(at)
        within = at - cells
        out = np.empty((len(x), self.tables, self.probes), dtype=np.int64)
        with np.errstate(over="ignore"):
            own = (cells.astype(np.int64) * self.mix).sum(axis=2)
            for i in range(len(x)):
                for t in range(self.tables):
                    out[i, t] = own[i, t] + self._steps(within[i, t])
        return out

    def _steps(self, within: np.ndarray) -> np.ndarray:
        """What the first perturbation sets add to a bucket, in order of their score."""
        n = self.projections
        walls = np.concatenate((within, 1 - within))  # to the cell below, to the cell above
        order = np.argsort(walls, kind="stable")
        scores = (walls[order] ** 2).tolist()
        axis, step = (order % n).tolist(), np.where(order < n, -self.mix[order % n], self.mix[order % n])
        found, heap = [np.int64(0)], [(scores[0], (0,))]
        while len(found) < self.probes and heap:
            score, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if last + 1 < 2 * n:
                heapq.heappush(heap, (score - scores[last] + scores[last + 1], (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (score + scores[last + 1], (*chosen, last + 1)))
            if len({axis[c] for c in chosen}) == len(chosen):
                found.append(step[list(chosen)].sum())
        return np.array(found + [found[0]] * (self.probes - len(found)), dtype=np.int64)


def fit(sample: np.ndarray, k: int, recall: float, tables: int, projections: int, probes: int, queries: int = 150) -> Hashes:
    """The narrowest hashes with the wanted recall of ``k`` neighbours within the sample."""
    dims = sample.shape[1] if sample.size else 1
    if len(sample) < 2:
        return Hashes(dims, 1.0, tables, projections, probes)
    asked = sample[:queries]
    d2 = (asked * asked).sum(1)[:, None] + (sample * sample).sum(1) - 2 * asked @ sample.T
    d2[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d2, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    unit = float(np.sqrt(np.maximum(np.median(np.take_along_axis(d2, near, 1)[:, -1]), 1e-12)))
    low, high, best = 0, len(WIDTHS) - 1, None  # wider cells find more
    while low <= high:
        middle = (low + high) // 2
        hashes = Hashes(dims, unit * WIDTHS[middle], tables, projections, probes)
        own, visited = hashes.buckets(sample), hashes.probed(asked)
        hits = [np.any([np.isin(own[near[i], t], visited[i, t]) for t in range(tables)], axis=0).mean() for i in range(len(asked))]
        if np.mean(hits) >= recall:
            best, high = hashes, middle - 1
        else:
            low = middle + 1
    if best is None:
        best = Hashes(dims, unit * WIDTHS[-1], tables, projections, probes)
        best.reached = False
    return best


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: (vec_id, embedding)."""
    own = vectors.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.filter(sound & F.exists("embedding", lambda x: x != 0))
    sizes = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.filter(F.size("embedding") == (sizes["n"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    """A list column as float64 rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _nearest(queries: np.ndarray, found: dict, names: list, x: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Merge candidates (x, ids) into each query's k nearest in ``found``: name -> (distances, ids)."""
    norms = (x * x).sum(axis=1)
    rough = norms - 2 * queries @ x.T + (queries * queries).sum(axis=1)[:, None]
    slack = 1e-9 * (norms.max() + 1)
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if x.shape[0] > k else np.full(len(queries), np.inf)
    for i, name in enumerate(names):
        d, own = found.get(name, (np.zeros(0), np.zeros(0, dtype=np.int64)))
        limit = min(kth[i], d[-1] ** 2 if len(d) >= k else np.inf)
        near = np.flatnonzero(rough[i] <= limit + slack)
        if not len(near):
            continue
        exact = np.sqrt(((x[near] - queries[i]) ** 2).sum(axis=1))
        d, own = np.concatenate((d, exact)), np.concatenate((own, ids[near]))
        own, first = np.unique(own, return_index=True)
        order = np.lexsort((own, d[first]))[:k]
        found[name] = d[first][order], own[order]


def search(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    tables: int = 8,
    projections: int = 8,
    probes: int = 64,
    recall: float = 0.96,
    sample: int = SAMPLE,
    block: int = 50_000,
    ask: int = 16_384,
) -> DataFrame:
    """The ``k`` nearest found of each row of ``vectors`` (vec_id, embedding) for which the column ``is_query`` holds.

    Returns query_id, rank, vec_id, score (Euclidean distance).
    """
    spark = vectors.sparkSession
    own = usable(vectors)
    # Equal vectors: their k + 1 smallest ids do (one may be the query's own). Spark cuts each task's groups before the shuffle.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = own.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1)
    distinct = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = durable(distinct.select(F.col("ids")[0].alias("rep"), "embedding", "ids"), "vectors")
    asked = own.filter(is_query)
    asked_distinct = durable(asked.groupBy("embedding").agg(F.min("vec_id").alias("q")), "queries")
    rows = sampled(distinct.select("rep", "embedding"), F.xxhash64("rep"), sample).toArrow()
    hashes = fit(_matrix(rows.column(1)), k, recall, tables, projections, probes)
    shared = spark.sparkContext.broadcast(hashes)  # dims * tables * projections numbers

    def filed(batches):
        for batch in batches:
            buckets = shared.value.buckets(_matrix(batch.column(1)))
            for t in range(tables):
                columns = [pa.array(np.full(batch.num_rows, t, dtype=np.int32)), pa.array(buckets[:, t]), batch.column(0), batch.column(1)]
                yield pa.record_batch(columns, names=["t", "bucket", "id", "embedding"])

    def asking(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                visited = shared.value.probed(_matrix(part.column(1)))
                for t in range(tables):
                    pairs = np.unique(np.stack((np.repeat(np.arange(part.num_rows), probes), visited[:, t].ravel()), axis=1), axis=0)
                    at = pa.array(pairs[:, 0])
                    columns = [pa.array(np.full(len(pairs), t, dtype=np.int32)), pa.array(pairs[:, 1]), part.column(0).take(at), part.column(1).take(at)]
                    yield pa.record_batch(columns, names=["t", "bucket", "id", "embedding"])

    kinds = f"t int, bucket long, id long, embedding {dict(distinct.dtypes)['embedding']}"
    index = distinct.select("rep", "embedding").mapInArrow(filed, kinds)
    probing = asked_distinct.select("q", "embedding").mapInArrow(asking, kinds)
    # Large buckets: few, of more than ``block`` candidates or ``ask`` queries. Each part of the one meets each part of the other.
    key = ["t", "bucket"]
    many = index.groupBy(*key).count().filter(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("parts"), F.lit(1).alias("asks"))
    if asked_distinct.count() > ask:
        often = probing.groupBy(*key).count().filter(F.col("count") > ask)
        many = many.union(often.select(*key, F.lit(1), F.ceil(F.col("count") / ask).cast("int")))
    large = durable(many.groupBy(*key).agg(F.max("parts").alias("parts"), F.max("asks").alias("asks")), "large")
    n_large = large.count()
    if n_large:
        large = F.broadcast(large) if n_large <= 100_000 else large
        parts, asks = F.coalesce("parts", F.lit(1)), F.coalesce("asks", F.lit(1))
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        index = index.join(large, key, "left").withColumn("c", own(parts)).withColumn("q", every(asks))
        probing = probing.join(large, key, "left").withColumn("q", own(asks)).withColumn("c", every(parts))
        index, probing = (x.withColumn("part", F.col("c") * asks + F.col("q")) for x in (index, probing))
    else:
        index, probing = index.withColumn("part", F.lit(0)), probing.withColumn("part", F.lit(0))
    columns = ["t", "bucket", "part", "kind", "id", "embedding"]
    both = probing.withColumn("kind", F.lit(0)).select(columns).union(index.withColumn("kind", F.lit(1)).select(columns))
    keep = k + 1  # distinct vectors; the query's own may be among them

    def meet(batches):
        here, names, queries = None, [], []  # the bucket that streams by, and its queries
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            flat = [(q, x, y) for q, (d, ids) in found.items() for x, y in zip(ids.tolist(), d.tolist(), strict=True)]
            found.clear()
            cols = list(zip(*flat, strict=True)) or [(), (), ()]
            kinds = pa.int64(), pa.int64(), pa.float64()
            return pa.record_batch([pa.array(c, type=kind) for c, kind in zip(cols, kinds, strict=True)], names=["q", "rep", "d"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            ids, x = batch.column(4).to_numpy(), _matrix(batch.column(5))
            cuts = np.flatnonzero(np.any(np.diff(keys, axis=0) != 0, axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                bucket, kind = tuple(keys[a, :3].tolist()), keys[a, 3]
                if bucket != here:
                    here, names, queries = bucket, [], []
                if kind == 0:
                    names += ids[a:b].tolist()
                    queries.append(x[a:b])
                elif names:
                    if len(queries) > 1:
                        queries = [np.concatenate(queries)]
                    for s in range(0, len(names), 256):
                        for c in range(a, b, 4096):
                            _nearest(queries[0][s : s + 256], found, names[s : s + 256], x[c : min(b, c + 4096)], ids[c : min(b, c + 4096)], keep)
            if len(found) > 50_000:
                yield out()
        yield out()

    best = Window.partitionBy("q").orderBy("d", "rep")
    again = Window.partitionBy("q").orderBy("d", "vec_id")

    def nearest(both):
        """q, d and vec_id of what the queries of each bucket find in it."""
        ordered = both.repartition("t", "bucket", "part").sortWithinPartitions("t", "bucket", "part", "kind", "id")
        near = ordered.mapInArrow(meet, "q long, rep long, d double").groupBy("q", "rep").agg(F.min("d").alias("d"))
        near = near.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= keep).select("q", "rep", "d")
        near = near.join(distinct.select("rep", "ids"), "rep").select("q", "d", F.explode("ids").alias("vec_id"))
        return near.withColumn("rn", F.row_number().over(again)).filter(F.col("rn") <= keep).select("q", "d", "vec_id")

    # The exact way for queries that the probes leave short.
    there, n_distinct = distinct.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.count("*")).first()
    if hashes.reached:
        near = durable(nearest(both), "near")
        full = near.groupBy("q").count().filter(F.col("count") >= min(keep, there)).select("q")
        short = durable(asked_distinct.join(full, "q", "left_anti"), "short")
    else:
        near, short = None, asked_distinct
    n_short = short.count()
    if n_short or near is None:
        asks, parts = max(1, -(-n_short // ask)), max(1, -(-n_distinct // block))
        bucket, part = F.pmod(F.xxhash64("id"), F.lit(asks)), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long")))
        head = short.select(F.lit(-1).alias("t"), F.col("q").alias("id"), "embedding", F.lit(0).alias("kind"))
        head = head.withColumn("bucket", bucket).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rest = distinct.select(F.lit(-1).alias("t"), F.col("rep").alias("id"), "embedding", F.lit(1).alias("kind"))
        rest = rest.withColumn("part", part).withColumn("bucket", blocks)
        exact = nearest(head.select(columns).union(rest.select(columns)))
        near = exact if near is None else near.join(short.select("q"), "q", "left_anti").union(exact)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "vec_id"))).alias("near"))
    # Every query of an equal vector takes the same list, without itself.
    named = asked.join(asked_distinct, "embedding").select(F.col("vec_id").alias("query_id"), "q")
    own_list = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    placed = named.join(lists, "q").select("query_id", F.posexplode(own_list).alias("p", "c"))
    return placed.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id"), F.col("c.d").alias("score"))
