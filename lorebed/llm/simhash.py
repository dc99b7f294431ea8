"""SimHash near-duplicates by multi-index hashing.

A scheme says what is fingerprinted, under which keys a fingerprint is filed, and how many bits linked ones may differ by:

* ``Bits``: 64 bits, linked within at most 4. Two such fingerprints differ in at most 2 bits of one 32-bit half, and if the low half
  takes those two, the high half differs in at most 2 as well. So each is filed in one table a half under every key of the
  radius-1 Hamming ball around that half (33 keys): halves up to 2 bits apart meet under a common key. No link is missed.
* ``Similar``: 256 bits, linked where they differ by no more than texts of the wanted Jaccard similarity of shingles do. Such
  texts differ in every seventh bit, far beyond any whole ball. But a bit that differs is nearly always one that was close
  to a tie in both texts; so each of 10 segments is filed under the ball of its 3 least certain bits (8 keys), and two segments
  meet if they differ in these alone. Of pairs of similarity 0.8, 0.85, 0.9 that gives 0.94, 0.99, 1.00 a meeting.

Every meeting is verified on all bits. No task emits all pairs of a bucket: a bucket holds distinct fingerprints, and what
leaves it is a spanning forest of its links. Buckets beyond ``block`` members are split: each pair of blocks is a bucket of its
own (a bucket of k blocks is copied k-fold), so no link is lost and no task gathers the whole. Components are then
contracted in rounds of groupBy and join.

Nulls and other cases: a null or wordless text has fingerprint zero and links like any other; null doc_ids belong to their
component and never name it unless it has no other; repeated rows are kept; an empty table gives no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, small
from .tokens import slices

_GOLDEN, _MIX_1, _MIX_2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a whole text, repeats included; of fewer words, of the whole; of none, nothing."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], dtype="<u8")


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Each hash, and ``lanes - 1`` more that are mixed from it."""
    out = np.empty((len(hashes), lanes), dtype="<u8")
    out[:, 0] = hashes
    for k in range(1, lanes):
        x = hashes + np.uint64(k * _GOLDEN % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows have each bit."""
    n, lanes = hashes.shape
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, n, 255):  # so many add up in a byte
        octets = np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8).reshape(-1, 8 * lanes)
        ones += np.add.reduce(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return ones


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text as an unsigned int; shingles count as often as they occur."""
    hashes = shingle_hashes(text, shingle, seed)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    return int.from_bytes(np.packbits(2 * _ones(hashes[:, None]) > len(hashes), bitorder="little").tobytes(), "little")


@dataclass(frozen=True)
class Bits:
    """64 bits over word shingles; fingerprints link within ``distance`` bits, at most 4."""

    shingle: int = 4
    distance: int = 4

    lanes = 1
    reach = 33  # halves whose ball has a given key
    kind = "fp long"
    rest = ()

    def __post_init__(self):
        if self.distance > 4:
            raise ValueError("balls of radius 1 on two halves find up to 4 differing bits")

    def columns(self, texts: list[str | None]) -> list[pa.Array]:
        fps = np.array([fingerprint(x, self.shingle) for x in texts], dtype=np.uint64)
        return [pa.array(fps.view(np.int64))]

    def keys(self) -> tuple[Column, Column]:
        """Of a row: its segments (the table in the high bits); of a column ``segment``: its ball."""
        halves = F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
        segments = F.transform(halves, lambda h, i: F.struct((h + i.cast("long") * F.lit(1 << 32)).alias("segment")))
        return segments, F.transform(flips, lambda f: F.col("segment").bitwiseXOR(f))


@dataclass(frozen=True)
class Similar:
    """256 bits over word shingles; fingerprints link where the texts' Jaccard similarity is about ``similarity`` or more.

    Pairs of that similarity stay within the limit in 95 of 100 cases.
    """

    shingle: int = 5
    similarity: float = 0.8
    segments: int = 10
    soft: int = 3

    lanes = 4
    kind = "fp binary, segments array<long>, soft array<array<long>>"
    rest = ("segments", "soft")

    @property
    def width(self) -> int:
        """Bits of a segment."""
        return 64 * self.lanes // self.segments

    @property
    def reach(self) -> int:
        return sum(math.comb(self.width, k) for k in range(self.soft + 1))

    @property
    def distance(self) -> int:
        """From Jaccard to the cosine of shingle counts (of texts as long as each other), to its angle, to the bits that differ."""
        cosine = 2 * self.similarity / (1 + self.similarity)
        p, n = math.acos(cosine) / math.pi, 64 * self.lanes
        return math.floor(n * p + 1.645 * math.sqrt(n * p * (1 - p)))

    def _of(self, text: str | None) -> tuple[bytes, list[int], list[list[int]]]:
        hashes = shingle_hashes(text, self.shingle)
        margins = 2 * _ones(_lanes(hashes, self.lanes)) - len(hashes)
        bits, used = margins > 0, self.width * self.segments
        values = (bits[:used].reshape(self.segments, -1) << np.arange(self.width)).sum(axis=1) + (np.arange(self.segments) << 32)
        least = np.argsort(np.abs(margins[:used]).reshape(self.segments, -1), axis=1, kind="stable")[:, : self.soft]
        return np.packbits(bits, bitorder="little").tobytes(), values.tolist(), (np.int64(1) << least).tolist()

    def columns(self, texts: list[str | None]) -> list[pa.Array]:
        fps, values, masks = zip(*map(self._of, texts), strict=True) if texts else ((), (), ())
        return [pa.array(fps, type=pa.binary()), pa.array(values, type=pa.list_(pa.int64())), pa.array(masks, type=pa.list_(pa.list_(pa.int64())))]

    def keys(self) -> tuple[Column, Column]:
        def flipped(ball: Column, mask: Column) -> Column:
            return F.concat(ball, F.transform(ball, lambda x: x.bitwiseXOR(mask)))

        ball = F.array("segment")
        for k in range(self.soft):
            ball = flipped(ball, F.col("soft")[k])
        return F.arrays_zip(F.col("segments").alias("segment"), "soft"), ball


def fingerprints(docs: DataFrame, scheme: Bits | Similar) -> DataFrame:
    """doc_id, own (a hash of the text, to tell rows of one doc_id apart) and the scheme's columns of each row."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "own", *[x.split()[0] for x in scheme.kind.split(", ")]]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column(0), part.column(1), *scheme.columns(part.column(2).to_pylist())], names=names)

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("own"), "text")
    return read.mapInArrow(run, f"doc_id long, own long, {scheme.kind}")


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether rows of lanes differ by at most ``distance`` bits."""
    counts = np.bitwise_count(a ^ b)
    return (counts[..., 0] if a.shape[-1] == 1 else counts.sum(axis=-1, dtype=np.int64)) <= distance


def spanning_links(members: np.ndarray, others: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links (as indices into members + others) that connect what links within ``distance`` bits connect.

    Fingerprints are rows of 64-bit lanes. With ``others``, links inside each of the two blocks are left to those blocks' buckets.
    """
    fps = members if others is None else np.concatenate((members, others))
    side = None if others is None else np.arange(len(fps)) >= len(members)
    waiting, links = np.arange(len(fps)), []
    while len(waiting) > 1:
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            at = frontier.pop()
            near = _near(fps[waiting], fps[at], distance)
            if side is not None:
                near &= side[waiting] != side[at]
            if near.any():
                found = waiting[near]
                waiting = waiting[~near]
                links += [(at, x) for x in found]
                frontier += found.tolist()
    return links


def _rows(column: pa.Array, lanes: int) -> np.ndarray:
    """Fingerprints of an Arrow column as rows of lanes."""
    if lanes == 1:
        return column.to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, lanes)


def _column(fps: np.ndarray) -> pa.Array:
    if fps.shape[1] == 1:
        return pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64))
    size, whole = 8 * fps.shape[1], np.ascontiguousarray(fps).tobytes()
    return pa.array([whole[i : i + size] for i in range(0, len(whole), size)], type=pa.binary())


def near_links(distinct: DataFrame, scheme: Bits | Similar, block: int = 1 << 16) -> DataFrame:
    """Links between the distinct fingerprints ``fp``, enough of them to connect all that meet and link."""
    distance, lanes = scheme.distance, scheme.lanes
    # Each row becomes many: spread them first, however few files they came in.
    distinct = distinct.select("fp", *scheme.rest).repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    segments, ball = scheme.keys()
    filed = distinct.select("fp", F.inline(segments))
    balls = filed.select("fp", F.explode(ball).alias("key"))

    # A bucket is large only if one of the segments in its reach is common: only those are counted.
    common = filed.groupBy("segment").count().filter(F.col("count") > block // scheme.reach).select("segment")
    common = durable(common, "common")
    if common.isEmpty():
        parts = balls.withColumns({"a": F.lit(0), "b": F.lit(0), "own": F.lit(0)})
    else:
        suspects = filed.join(small(common), "segment", "left_semi").select(F.explode(ball).alias("key")).distinct()
        sizes = balls.join(small(durable(suspects, "suspects")), "key", "left_semi").groupBy("key").count().filter(F.col("count") > block)
        sizes = durable(sizes.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
            lambda k: F.struct(F.least(k, "own").alias("a"), F.greatest(k, "own").alias("b")),
        )
        parts = balls.join(small(sizes), "key", "left").withColumn("own", own)
        parts = parts.select("fp", "key", F.explode(pairs).alias("p"), "own").select("fp", "key", "p.a", "p.b", "own")

    def run(batches):
        held: list[np.ndarray] = []

        def links(fp, mine, different):
            found = spanning_links(fp[mine], fp[~mine], distance) if different else spanning_links(fp, None, distance)
            order = np.concatenate((np.flatnonzero(mine), np.flatnonzero(~mine))) if different else np.arange(len(fp))
            x, y = np.array(found, dtype=np.int64).reshape(-1, 2).T
            return fp[order[x]], fp[order[y]]

        def emit(columns, last):
            """Links of all buckets that are complete, and the rows of the one that may go on."""
            key, a, b, fp, own = columns
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            starts = np.concatenate(([0], new))
            ends = np.concatenate((new, [len(key)]))
            if not last:
                starts, ends, rest = starts[:-1], ends[:-1], starts[-1]
            else:
                rest = len(key)
            sizes = ends - starts
            two = starts[sizes == 2]  # the usual case, all at once
            near = _near(fp[two], fp[two + 1], distance) & ((a[two] == b[two]) | (own[two] != own[two + 1]))
            out = [(fp[two[near]], fp[two[near] + 1])]
            out += [links(fp[s:e], own[s:e] == a[s], a[s] != b[s]) for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True)]
            x, y = (np.concatenate(z) for z in zip(*out, strict=True))
            first = np.zeros(len(x), dtype=bool)  # the smaller one comes first
            for k in reversed(range(lanes)):
                first = (x[:, k] < y[:, k]) | ((x[:, k] == y[:, k]) & first)
            u, v = np.where(first[:, None], x, y), np.where(first[:, None], y, x)
            return pa.record_batch([_column(u), _column(v)], names=["u", "v"]), [z[rest:] for z in columns]

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [_rows(batch.column(k), lanes) if k == 3 else batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = [np.concatenate(z) for z in zip(held, cols, strict=True)] if len(held) else cols
            # a bucket that fills several batches is only joined once it ends, or at this many rows
            if held[0][0] == held[0][-1] and held[1][0] == held[1][-1] and held[2][0] == held[2][-1] and len(held[0]) < 1 << 22:
                continue
            out, held = emit(held, False)
            yield out
        if len(held) and len(held[0]):
            yield emit(held, True)[0]

    kind = scheme.kind.split(", ")[0].split()[1]
    ordered = parts.select("key", "a", "b", "fp", "own").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return ordered.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); each component has one root.

    Every round hooks each node to the neighbour that is least by a seeded hash and contracts; the number of nodes
    that remain falls by a constant factor a round. Nothing is gathered.
    """
    rank = lambda c: F.xxhash64(c, F.lit(7))
    roots, left = None, durable(links, "links")
    for _ in range(rounds):
        if left.isEmpty():
            break
        both = left.select("u", "v").union(left.select("v", "u").toDF("u", "v"))
        hook = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v").alias("n"))).alias("m"))
        own = F.struct(rank("u").alias("r"), F.col("u").alias("n"))
        hook = durable(hook.select("u", F.least("m", own)["n"].alias("to")), "hooks")
        moved = left.join(hook.withColumnRenamed("to", "a"), "u").join(hook.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        left = durable(
            moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links"
        )
        if roots is None:
            roots = hook.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            step = hook.select(F.col("u").alias("root"), "to")
            roots = durable(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    else:
        raise RuntimeError("components did not settle")
    return roots if roots is not None else links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def members(docs: DataFrame, scheme: Bits | Similar, block: int = 1 << 16) -> DataFrame:
    """doc_id, own, fp, root (the component's fingerprint) and component_id of each row of ``docs`` (doc_id, text)."""
    marked = durable(fingerprints(docs, scheme), "fingerprints")
    # Texts of one fingerprint may be uncertain of different bits; the least will do.
    rest = [F.min(x).alias(x) for x in scheme.rest]
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *rest), "distinct")
    roots = components(near_links(distinct, scheme, block)).withColumnRenamed("node", "fp")
    # Most fingerprints are one row's own: only shared and linked ones need names from elsewhere.
    shared = distinct.join(roots, "fp", "left").filter("n > 1 or root is not null")
    shared = durable(shared.select("fp", F.coalesce("root", "fp").alias("root"), "least"), "shared")
    names = durable(shared.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = durable(shared.join(small(names), "root").select("fp", F.col("root").alias("r"), "component_id"), "named")
    return marked.join(small(named), "fp", "left").select(
        "doc_id", "own", "fp", F.coalesce("r", "fp").alias("root"), F.when(F.col("r").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, scheme: Bits | Similar, block: int = 1 << 16) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, of each row of ``docs`` (doc_id, text)."""
    return members(docs, scheme, block).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """16 lowercase hex digits of a signed long column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, scheme: Bits | Similar, block: int = 1 << 16) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns kept.

    Of each component one row stays: that of the smallest doc_id (null last), then of the smallest text hash.
    """
    found = members(docs, scheme, block).groupBy("doc_id", "own", "root").agg(F.count("*").alias("n"))
    found = durable(found, "members")
    # Components of one row need no decision.
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("first"), F.sum("n").alias("rows")
    )
    first = durable(first.filter("rows > 1").select("root", "first"), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own"))
    told = found.join(small(first), "root").select(F.col("doc_id").alias("k"), F.col("own").alias("k_own"), "n", stays.alias("stays"))
    # Rows that go, and rows that stay but are there several times; most rows are neither.
    told = durable(told.filter("n > 1 or not stays").select("k", "k_own", "stays"), "told")
    n_repeated = told.filter("stays").count()
    told = small(told, 500_000)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("own"))
    marked = rows.join(told, F.col("id").eqNullSafe(F.col("k")) & (F.col("own") == F.col("k_own")), "left")
    kept = marked.filter("stays is null").select("row")
    if n_repeated:
        kept = kept.union(marked.filter("stays").dropDuplicates(["k", "k_own"]).select("row"))
    return kept.select("row.*")
