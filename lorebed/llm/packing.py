"""Best-fit packing of documents into training sequences: hierarchical residual packing.

Each task best-fits its own pieces (largest first) and emits the nearly full sequences. What its underfull ones hold is then an
item again: groups of tasks best-fit these items and emit what has become nearly full, groups of groups do so again, until
one group remains, which emits all. There is always one such round, so that what a task packed at different times
meets as well. (Underfull sequences are opened rather than kept as one item each: that takes up to 4 % fewer sequences.)

Items of one size are interchangeable, so the rounds work on counts: how many items a task (or group) has of each size, at
most ``capacity`` numbers. Best fit of counts places runs of equal items at once and gives exactly as many sequences as best
fit of the items one by one. A round's outcome is a list of ranges ("of size 600, numbers 40 to 90 go to ..."), rounds are
composed range by range, and pieces look their range up. So no task gathers items, however many are left, none is closed
early, and no piece is ever dropped.

Nulls and other cases: a null text is empty and packs as its end id; a null doc_id and repeated doc_ids or rows are
packed like any others; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, small
from .tokens import encoder, slices

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    + [("bin", pa.int64()), ("bin_offset", pa.int64()), ("number", pa.int64()), ("task", pa.int32())]
)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, number long, task int"
#: Of a child's items of one size, those numbered ``lo`` to ``lo + n - 1`` go ``offset`` ids into the sequences numbered from ``seq``, or
#: where that is null, go on as their group's items numbered from ``to_lo``.
MOVES = "child int, size long, lo long, n long, grp int, to_lo long, offset long, seq long"

def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: each item's bin and offset, and each bin's fill.

    Open bins are kept by free space; a bit mask of the spaces in use gives the tightest in one step.
    """
    place, offset, fill = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        size = int(sizes[i])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, at = capacity, len(fill)
            fill.append(0)
        place[i], offset[i] = at, capacity - space
        fill[at] += size
        if space > size:
            by_space[space - size].append(at)
            spaces |= 1 << (space - size)
    return place, offset, np.array(fill, dtype=np.int64)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only those longer than a sequence are cut, the remainder coming first."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return [(0, first)] * bool(first) + [(at, capacity) for at in range(first, length, capacity)]


@dataclass
class Run:
    """``n`` sequences alike: sequence i holds, of each slot (size, first number, offset), item first + i."""

    slots: list[tuple[int, int, int]]
    n: int

    def split(self, n: int) -> tuple[Run, Run]:
        return Run(self.slots, n), Run([(s, first + n, at) for s, first, at in self.slots], self.n - n)


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[Run, int]]:
    """Best fit, largest first, of ``counts[size]`` items a size: runs of sequences and how full they are.

    The tightest open sequence takes as many items of a size as fit in it before the next one does, as it stays the tightest.
    """
    open_runs: list[list[Run]] = [[] for _ in range(capacity + 1)]
    spaces = 0

    def put(run: Run, space: int) -> None:
        nonlocal spaces
        open_runs[space].append(run)
        spaces |= 1 << space

    for size in sorted(counts, reverse=True):
        left, done = counts[size], 0
        while left:
            fitting = spaces >> size
            if fitting:
                space = size + (fitting & -fitting).bit_length() - 1
                run = open_runs[space].pop()
                if not open_runs[space]:
                    spaces &= ~(1 << space)
            else:
                space = capacity
                run = Run([], -(-left // (capacity // size)))
            each = min(space // size, left)  # fewer only where the last items meet one sequence
            n = min(run.n, left // each)
            taking, rest = run.split(n)
            slots = taking.slots + [(size, done + j * n, capacity - space + j * size) for j in range(each)]
            put(Run(slots, n), space - each * size)
            if rest.n and (rest.slots or left > n * each):
                put(rest, space)
            done, left = done + n * each, left - n * each
    return [(run, capacity - space) for space, runs in enumerate(open_runs) for run in runs if run.slots]


def _local(vocabulary: str, end_id: int, capacity: int, full: int, at_once: int):
    """Tokenise, cut, and best-fit at most ``at_once`` partial pieces at a time; what is in no nearly full sequence is numbered by size."""

    def run(batches):
        coder, task = encoder(vocabulary), TaskContext.get().partitionId()
        width, bins = coder.dtype.itemsize, task << 36
        seen = np.zeros(capacity + 1, dtype=np.int64)  # items left so far, by size

        def packed(rows):
            nonlocal bins
            columns = [np.array(x, dtype=np.int64) for x in list(zip(*rows, strict=True))[1:]]
            sizes = columns[2]
            place, offset, fill = best_fit(sizes, capacity)
            left = np.flatnonzero(fill[place] < full)
            left = left[np.argsort(sizes[left], kind="stable")]
            times = np.bincount(sizes[left], minlength=capacity + 1)
            number = np.zeros(len(sizes), dtype=np.int64)
            number[left] = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + seen[sizes[left]]
            np.add(seen, times, out=seen)
            open_ = np.zeros(len(sizes), dtype=bool)
            open_[left] = True
            out = [pa.array([r[0] for r in rows], type=pa.int64()), *columns, pa.array(place + bins, mask=open_), offset]
            out += [pa.array(number, mask=~open_), np.full(len(rows), task)]
            bins += len(fill)
            return pa.record_batch([pa.array(x, type=f.type) for x, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

        whole, partial = [], []
        for batch in batches:
            for part in slices(batch):
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(texts, end_id), strict=True):
                    wide = np.frombuffer(ids, dtype=coder.dtype).astype("<u4")
                    for k, (start, n) in enumerate(cut(len(ids) // width, capacity)):
                        row = (doc_id, k, start, n, zlib.crc32(wide[start : start + n]))
                        (whole if n == capacity else partial).append(row)
                if len(whole) >= 50_000:
                    yield packed(whole)
                    whole = []
                if len(partial) >= at_once:
                    yield packed(partial)
                    partial = []
        for rows in (whole, partial):
            if rows:
                yield packed(rows)

    return run


def _merge(capacity: int, full: int, round_: int, last: bool):
    """Best-fit the counts of a group's children (child, size, n); nearly full sequences, and in the last round all, are done."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        grp = int(items["grp"].iloc[0])
        items = items.sort_values(["size", "child"], kind="stable")
        own = {}  # of each size: children, and where their numbers start and end among the group's
        for size, part in items.groupby("size", sort=False):
            ends = part["n"].to_numpy().cumsum()
            own[int(size)] = part["child"].to_numpy(), ends - part["n"].to_numpy(), ends
        rows, sequences, going = [], 0, dict.fromkeys(own, 0)
        for packed, fill in best_fit_counts({size: int(ends[-1]) for size, (_, _, ends) in own.items()}, capacity):
            done = last or fill >= full
            seq = (round_ << 59) | (grp << 35) | sequences
            sequences += packed.n if done else 0
            for size, first, offset in packed.slots:
                children, starts, ends = own[size]
                to = going[size]
                going[size] += 0 if done else packed.n
                at = int(np.searchsorted(ends, first, side="right"))
                while at < len(ends) and starts[at] < first + packed.n:
                    a, b = max(first, int(starts[at])), min(first + packed.n, int(ends[at]))
                    goal = (None, offset, seq + a - first) if done else (to + a - first, None, None)
                    rows.append((int(children[at]), size, a - int(starts[at]), b - a, grp, *goal))
                    at += 1
        names = [x.split()[0] for x in MOVES.split(", ")]
        return pd.DataFrame({name: pd.array(x, dtype="Int64") for name, x in zip(names, zip(*rows, strict=True), strict=True)})

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 2,
    capacity: int = 1024,
    nearly_full: float = 0.995,
    fan_in: int = 16,
    at_once: int = 200_000,
) -> DataFrame:
    """Pack the token ids of each row of ``docs`` (doc_id, text), with ``end_id`` after each, into sequences.

    ``at_once`` bounds the pieces that a task holds; what it leaves underfull each time is packed on in the rounds.
    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    bound_batches(docs.sparkSession)
    full = int(capacity * nearly_full)
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_local(vocabulary, end_id, capacity, full, at_once), PIECES)
    pieces = durable(pieces, "pieces")
    left = pieces.filter("bin is null").groupBy(F.col("task").alias("child"), F.col("length").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    groups = (pieces.agg(F.max("task")).first()[0] or 0) + 1
    moves, round_ = None, 0
    while moves is None or groups > 1:
        groups, round_ = -(-groups // fan_in), round_ + 1
        left = left.withColumn("grp", F.floor(F.col("child") / fan_in).cast("int"))
        step = durable(left.groupBy("grp").applyInPandas(_merge(capacity, full, round_, groups == 1), MOVES), "moves")
        left = step.filter("seq is null").groupBy(F.col("grp").alias("child"), "size").agg(F.sum("n").alias("n"))
        moves = step if moves is None else durable(_then(moves, step), "moves")
    found = small(moves.select("child", F.col("size").alias("s"), "lo", "n", "offset", "seq"))
    within = (F.col("task") == F.col("child")) & (F.col("length") == F.col("s")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("lo") + F.col("n"))
    placed = pieces.filter("bin is null").join(found, within)
    placed = placed.withColumn("sequence_id", -1 - (F.col("seq") + F.col("number") - F.col("lo")))  # below 0: made in a round
    done = pieces.filter("bin is not null").withColumns({"sequence_id": F.col("bin"), "offset": F.col("bin_offset")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return done.select(columns).union(placed.select(columns))


def _then(moves: DataFrame, step: DataFrame) -> DataFrame:
    """``moves``, those that go on continued by ``step``: both are ranges, so each pair of them that overlaps is one."""
    going, onward = moves.filter("seq is null").alias("m"), step.alias("s")
    a = F.greatest("m.to_lo", "s.lo")
    n = F.least(F.col("m.to_lo") + F.col("m.n"), F.col("s.lo") + F.col("s.n")) - a
    joined = going.join(onward, (F.col("m.grp") == F.col("s.child")) & (F.col("m.size") == F.col("s.size")) & (n > 0))
    ahead = a - F.col("s.lo")
    both = joined.select(
        "m.child", "m.size", (F.col("m.lo") + a - F.col("m.to_lo")).alias("lo"), n.alias("n"), "s.grp",
        (F.col("s.to_lo") + ahead).alias("to_lo"), "s.offset", (F.col("s.seq") + ahead).alias("seq"),
    )
    return moves.filter("seq is not null").union(both)
