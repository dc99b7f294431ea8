"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling polynomial hash; of each window of w neighbouring k-grams the least is chosen, the
rightmost on ties, and its position kept. Two texts that share a run of at least w + k - 1 code points share a chosen
hash from it; matches shorter than k are never noticed.

Nulls and other cases: a null text is empty and has no hashes (its fingerprint is the empty string; two empty ones
are alike, an empty and another are not); a text shorter than k is one gram of all it has; fewer than w grams are one window;
null doc_ids come first in order; rows of one doc_id are ordered by text; an empty table gives no rows; further columns of
the input are ignored. Whole texts of any length are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .tokens import slices

GRAM, WINDOW = 24, 40
_BASE = 0x9E3779B97F4A7C15  # any odd multiplier
_MASK = (1 << 64) - 1


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, by doubling: the hash of a + b is hash(a) * base**len(b) + hash(b)."""
    level, size, whole, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(codes) - k + 1
    while True:
        if k & size:  # this power of two is a part of k
            part = level[done : done + n]
            whole = part if whole is None else whole * np.uint64(pow(_BASE, size, 1 << 64)) + part
            done += size
        if done == k:
            return whole
        level = level[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + level[size:]
        size *= 2


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least key of every window of w."""
    size = 1
    while 2 * size <= w:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return keys if size == w else np.minimum(keys[: len(keys) - (w - size)], keys[w - size :])


def winnow(text: str | None, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes (32 bits) and their positions, ascending."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    chosen = []
    step = 1 << 20  # windows at a time; long texts are read in overlapping stretches
    k, last = min(k, len(codes)), None
    w = min(w, len(codes) - k + 1)
    for at in range(0, len(codes) - k - w + 2, step):
        grams = _grams(codes[at : at + step + k + w - 2], k)
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = (grams >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
        least = _least(keys, w)  # a later position has the smaller key
        new = least[np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))]
        positions = at + 0xFFFFFFFF - (new & np.uint64(0xFFFFFFFF)).astype(np.int64)
        hashes = (new >> np.uint64(32)).astype(np.uint32)
        if last is not None and positions[0] == last:
            positions, hashes = positions[1:], hashes[1:]
        if len(positions):
            last = positions[-1]
        chosen.append((hashes, positions))
    return np.concatenate([h for h, _ in chosen]), np.concatenate([p for _, p in chosen])


def digest(hashes: np.ndarray) -> str:
    """A fingerprint as text: the chosen hashes in order of position, 8 hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def covered(own: tuple[np.ndarray, np.ndarray], other: np.ndarray, n_chars: int, k: int = GRAM) -> float:
    """The share of a text's code points that lie in k-grams whose chosen hashes the other text has too, by their positions."""
    hashes, positions = own
    at = positions[np.isin(hashes, other)]
    if not len(at):
        return 0.0
    k = min(k, n_chars)
    return float(np.minimum(np.diff(at), k).sum() + k) / n_chars


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions of each row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [winnow(x, k, w) for x in part.column(1).to_pylist()]
                hashes = pa.array([h.astype(np.int64) for h, _ in found], type=pa.list_(pa.int64()))
                yield pa.record_batch(
                    [part.column(0), hashes, pa.array([p for _, p in found], type=pa.list_(pa.int64()))],
                    names=["doc_id", "hashes", "positions"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, covered_edited double"
)


def with_following(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Deal rows to ranges of ascending doc_id: (range, guest, doc_id, text).

    Each range also gets the first row of the next one (the last gets the very first) as a guest, so that every row's
    follower is at hand. Texts are shuffled once; the cuts are quantiles of the ids alone.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("at"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = keyed.filter(F.col("doc_id").isNotNull()).agg(F.percentile_approx("at", F.array(*map(F.lit, shares)), 20 * ranges)).first()[0]
    splits = [float("-inf"), *sorted(set(cuts or [0.0])), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="at", outputCol="b").transform(keyed).withColumn("range", F.col("b").cast("int"))
    # One row a range that isn't empty.
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("f")
    firsts = sorted((r["range"], r["f"]["known"], r["f"]["doc_id"]) for r in dealt.groupBy("range").agg(first).collect())
    if not firsts:
        return docs.select(F.lit(0).alias("range"), F.lit(False).alias("guest"), F.col("doc_id").cast("long"), "text").limit(0)
    guests = [(doc_id, firsts[i - 1][0]) for i, (_, _, doc_id) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(guests, "first long, host int"))  # as many rows as ranges
    visiting = dealt.join(guests, F.col("doc_id").eqNullSafe(F.col("first")), "left")
    seats = F.array_compact(
        F.array(
            F.struct("range", F.lit(False).alias("guest")),
            F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))),
        )
    )
    return visiting.select(F.explode(seats).alias("s"), "doc_id", "text").select("s.*", "doc_id", "text")


def edit_likeness(docs: DataFrame, k: int = GRAM, w: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """Fingerprint each whole text, its edited text and the next document, and compare.

    ``covered_edited`` is the share of the text that positions of shared hashes cover: what is at least unchanged of it.
    """
    bound_batches(docs.sparkSession)
    dealt = with_following(docs, ranges).withColumn("known", F.col("doc_id").isNotNull())
    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", "known", "doc_id", "text").drop("known")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "covered_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches):
        waiting = None  # the row before, whose follower comes next
        for batch in batches:
            for part in slices(batch):
                out = []
                rows = zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)
                for at, guest, doc_id, text in rows:
                    if guest and (waiting is None or waiting[0] != at):
                        continue  # only the first guest follows
                    text = text or ""
                    chosen = winnow(text, k, w)
                    if waiting is not None and waiting[0] == at:
                        _, own_id, own, own_chosen = waiting
                        own_hashes = own_chosen[0]
                        changed = edited(own, text)
                        changed_hashes = winnow(changed, k, w)[0]
                        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                        near = likeness(own_hashes, changed_hashes), likeness(own_hashes, chosen[0])
                        share = covered(own_chosen, changed_hashes, len(own), k)
                        out.append((own_id, len(own), sha, digest(own_hashes), digest(changed_hashes), *near, share))
                    waiting = None if guest else (at, doc_id, text, chosen)
                if out:
                    columns = [pa.array(x, type=kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.record_batch(columns, names=names)

    return ordered.mapInArrow(run, OUT)
