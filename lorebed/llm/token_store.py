"""Token-id files with Elias-Fano document boundaries.

File format: a Parquet table of blocks. A block holds the ids of consecutive documents end to end (``ids``: little-endian
unsigned 16 or 32 bits, ``width`` bytes each) and where each document ends (``bounds``: an Elias-Fano sequence). Blocks of
a shard follow each other by ``block``; shards follow each other by ``shard``; documents ascend throughout. No table
of 64-bit offsets is kept: a document's place is its block's place plus what the select structure answers, and the reader asks it.

Elias-Fano layout, little-endian: uint32 n, uint32 universe, uint8 l; the l low bits of each value, packed; the high
parts in unary, packed; one uint32 position for each 64th one-bit of the unary part (the select samples).

Nulls and other cases: a null text is empty (only the end id); null doc_ids come first; equal doc_ids are ordered by a hash of the text;
an empty table gives no rows; further columns of the input are ignored. Texts of any length stay whole: a document larger
than a block gets a block of its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, new_path
from .tokens import encoder, slices

SAMPLE = 64
_HEAD = struct.Struct("<IIB")
BLOCKS = (
    "shard int, block int, before long, n_docs int, n_ids long, width int, doc_ids array<bigint>, bounds binary, ids binary"
)


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


class EliasFano:
    """A non-decreasing sequence of ints below 2**32, with select in near-minimal space."""

    def __init__(self, data: bytes):
        self.data = data
        self.n, self.universe, self.low_bits = _HEAD.unpack_from(data)
        self._low = _HEAD.size
        self._high = self._low + (self.n * self.low_bits + 7) // 8
        self._n_high = self.n + (self.universe >> self.low_bits) + 1
        self._samples = self._high + (self._n_high + 7) // 8

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        places = (values >> low) + np.arange(n)
        high = np.zeros(n + (universe >> low) + 1, dtype=np.uint8)
        high[places] = 1
        lows = (values[:, None] >> np.arange(low)) & 1
        return cls(_HEAD.pack(n, universe, low) + _pack(lows.ravel()) + _pack(high) + places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, reading a bounded stretch of the unary part from the nearest sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int.from_bytes(self.data[(at := self._samples + 4 * (i // SAMPLE)) : at + 4], "little")
        left = i % SAMPLE
        while left:
            place += 1
            left -= self.data[self._high + (place >> 3)] >> (place & 7) & 1
        first = i * self.low_bits
        window = int.from_bytes(self.data[self._low + (first >> 3) : self._low + ((first + self.low_bits + 7) >> 3)], "little")
        return (place - i) << self.low_bits | window >> (first & 7) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        raw = np.frombuffer(self.data, dtype=np.uint8)
        high = np.flatnonzero(np.unpackbits(raw[self._high : self._samples], bitorder="little", count=self._n_high))
        low = np.unpackbits(raw[self._low : self._high], bitorder="little", count=self.n * self.low_bits)
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        return ((high - np.arange(self.n)) << self.low_bits) + low.reshape(self.n, self.low_bits).astype(np.int64) @ weights


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_ids: int = 1 << 17) -> None:
    """Encode the whole text of each row of ``docs`` (doc_id, text), append ``end_id``, and write blocks in ascending doc_id order."""
    bound_batches(docs.sparkSession)
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64())]
        + [("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("bounds", pa.binary()), ("ids", pa.binary())]
    )

    def blocks(batches):
        coder, shard = encoder(vocabulary), TaskContext.get().partitionId()
        width, block, before = coder.dtype.itemsize, 0, 0
        doc_ids, parts, ends = [], [], [0]

        def flush():
            nonlocal block, before
            bounds = EliasFano.encode(np.array(ends[1:])).data
            row = [shard, block, before, len(doc_ids), ends[-1], width, list(doc_ids), bounds, b"".join(parts)]
            block, before = block + 1, before + ends[-1]
            doc_ids.clear(), parts.clear(), ends.__setitem__(slice(None), [0])
            return pa.record_batch([pa.array([x], type=f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(texts, end_id), strict=True):
                    n = len(ids) // width
                    if doc_ids and ends[-1] + n > block_ids:
                        yield flush()
                    doc_ids.append(doc_id), parts.append(ids), ends.append(ends[-1] + n)
        if doc_ids:
            yield flush()

    # The hash and the row's number split an id of very many rows over several shards.
    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = own.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """Each document of the files at ``path``: doc_id, start, n_tokens, ids_crc32 (over unsigned 32-bit ids), ids (binary), width."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("shard", pa.int32()), ("in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        + [("ids", pa.binary()), ("width", pa.int32())]
    )

    def documents(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                bounds, ids, width = EliasFano(row["bounds"]), row["ids"], row["width"]
                ends = [bounds.select(i) for i in range(bounds.n)]
                spans = list(zip([0, *ends], ends, strict=False))
                wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                crc, own = [zlib.crc32(wide[a:b]) for a, b in spans], [ids[a * width : b * width] for a, b in spans]
                starts, sizes = [row["before"] + a for a, _ in spans], [b - a for a, b in spans]
                columns = [row["doc_ids"], [row["shard"]] * bounds.n, starts, sizes, crc, own, [width] * bounds.n]
                yield pa.record_batch([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    stored = spark.read.schema(BLOCKS).parquet(path)
    # One row a shard: as many as there were tasks. Their places are running sums of the shards' sizes.
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    if sizes.count() <= 100_000:  # rows of two numbers
        places = F.broadcast(places)
    rows = stored.mapInArrow(documents, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long, ids binary, width int")
    return rows.join(places, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "ids", "width"
    )


def document_ids(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` to token files and return what they hold, read back: doc_id, start, n_tokens, ids_crc32."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
