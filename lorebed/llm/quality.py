"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text itself.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2])

The bracket is the sum-of-squares identity: all pairwise interactions in time linear in a document's features. Features
are hashed lower-case words, how words are written (their shape), and binned statistics of the text's structure
and length. Language, source, ids and labels are never among them.

Fitting uses at most ``sample`` labelled rows (those least by a seeded hash of the id), scored features of which
come to the driver; scoring covers every whole text.

Nulls and other cases: a null text is empty and scores like an empty one; null doc_ids are scored; repeated rows score
alike; labels that are null, or of ids that are null or absent, teach nothing; without any usable label every score is 0.5;
an empty table gives no rows; further columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, sampled
from .tokens import slices

WORDS = 1 << 15
STATISTICS = 1 << 11  # slots for shapes and bins
WIDTH = WORDS + STATISTICS
RANK = 8
SAMPLE = 5_000


def _slot(name: str) -> int:
    return WORDS + zlib.crc32(name.encode()) % STATISTICS


def shape(word: str) -> str:
    """How a word is written: runs of letters (case kept), digits, and marks."""
    out = []
    for c in word[:24]:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c < "\x7f" else "?"
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:6])


_words: dict[str, tuple[int, int]] = {}


def _known(word: str) -> tuple[int, int]:
    """Slots of a word and of its shape; each worker remembers a bounded number."""
    if len(_words) > 150_000:
        _words.clear()
    key = word.strip(".,;:!?\"'()*#$%&|").lower()
    found = (zlib.crc32(key.encode("utf-8", "replace")) % WORDS, _slot("shape " + shape(word)))
    if len(word) <= 40:
        _words[word] = found
    return found


def statistics(text: str, words: list[str], counts: Counter) -> list[tuple[str, float]]:
    """Named structure statistics of a text, each on its own scale."""
    n, lines = len(words), text.split("\n")
    chars = max(1, len(text))
    filled = [x for x in lines if x]
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = sum(len(w) for w in counts)
    return [
        ("words", np.log1p(n)),
        ("lines", np.log1p(len(filled))),
        ("line words", np.log1p(n / max(1, len(filled)))),
        ("word length", (chars - n) / max(1, n)),
        ("distinct word length", letters / max(1, len(counts))),
        ("distinct", 10 * len(counts) / max(1, n)),
        ("top word", 10 * max(counts.values(), default=0) / max(1, n)),
        ("repeats", 10 * repeated / max(1, n)),
        ("repeated lines", 10 * (len(filled) - len(set(filled))) / max(1, len(filled))),
        ("bars", 20 * counts.get("|", 0) / max(1, n)),
        ("stops", 10 * sum(x.rstrip().endswith((".", "!", "?")) for x in filled) / max(1, len(filled))),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots (distinct, ascending) and values of one whole text; words and shapes are of unit length, bins are 1/2 each."""
    words = (text or "").split()
    counts = Counter(words)
    get = _words.get
    found = [get(w) or _known(w) for w in counts]
    times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    parts, values = [], []
    for k, damp in ((0, np.log1p), (1, np.sqrt)):
        slots, at = np.unique(pairs[:, k], return_inverse=True)
        x = damp(np.bincount(at, weights=times, minlength=len(slots))) if len(slots) else np.zeros(0)
        parts.append(slots), values.append(x / max(1e-9, np.sqrt((x * x).sum())))
    bins = [(_slot(f"{name} {int(2 * x)}"), 0.5) for name, x in statistics(text or "", words, counts)]
    slots = np.concatenate([*parts, np.array([s for s, _ in bins], dtype=np.int64)])
    x = np.concatenate([*values, np.array([v for _, v in bins])])
    slots, at = np.unique(slots, return_inverse=True)
    return slots, np.bincount(at, weights=x)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray  # WIDTH
    factors: np.ndarray  # WIDTH x RANK

    @classmethod
    def constant(cls) -> FactorisationMachine:
        return cls(0.0, np.zeros(WIDTH, dtype=np.float32), np.zeros((WIDTH, RANK), dtype=np.float32))

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Between 0 and 1, one a row."""
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(s) for s, _ in rows)])[:-1]
        slots, x = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
        vx = self.factors[slots] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        z = self.bias + np.add.reduceat(self.linear[slots] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.05, seed: int = 42):
        """AdaGrad on the logistic loss; the rarer class counts for more, by the root of the ratio."""
        model, rng = cls.constant(), np.random.default_rng(seed)
        good = labels.mean() if len(labels) else 0.5
        if not 0 < good < 1:
            model.bias = 0.0 if not len(labels) else 3.0 if good else -3.0
            return model
        weight = np.where(labels > 0, 1.0, np.sqrt(good / (1 - good))) if good > 0.5 else np.where(labels > 0, np.sqrt((1 - good) / good), 1.0)
        w, v = np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK))
        gw, gv, bias, gb = np.full(WIDTH, 1e-3), np.full((WIDTH, RANK), 1e-3), np.log(good / (1 - good)), 1e-3
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
                starts = np.cumsum([0, *(len(rows[i][0]) for i in part)])[:-1]
                slots, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                vx = v[slots] * x[:, None]
                sums = np.add.reduceat(vx, starts)
                z = bias + np.add.reduceat(w[slots] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, starts)).sum(axis=1)
                miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part] / len(part)
                used, at = np.unique(slots, return_inverse=True)
                dw = np.bincount(at, weights=miss[of] * x, minlength=len(used)) + 1e-5 * w[used]
                dv = 1e-5 * v[used]
                np.add.at(dv, at, miss[of][:, None] * x[:, None] * (sums[of] - vx))
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += miss.sum() ** 2
                w[used] -= rate * dw / np.sqrt(gw[used])
                v[used] -= rate * dv / np.sqrt(gv[used])
                bias -= rate * miss.sum() / np.sqrt(gb)
        return cls(float(bias), w.astype(np.float32), v.astype(np.float32))


def held_out(doc_id):
    """Whether a row is kept from fitting: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled ids that are not held out.

    An id counts once: of several labels the smallest, of several rows the one whose text is least by a hash.
    """
    bound_batches(docs.sparkSession)
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = [(r.doc_id, r.quality) for r in sampled(usable, F.xxhash64("doc_id"), sample).collect()]
    if not rows:
        return FactorisationMachine.constant()
    chosen = docs.sparkSession.createDataFrame(rows, "doc_id long, quality int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``sample`` rows of two numbers
    own = F.struct(F.xxhash64("text").alias("h"), "text")
    texts = texts.groupBy("doc_id", "quality").agg(F.min(own)["text"].alias("text"))

    def run(batches):
        for batch in batches:
            found = [features(x) for x in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("quality"), pa.array([s for s, _ in found], type=pa.list_(pa.int64()))]
                + [pa.array([x for _, x in found], type=pa.list_(pa.float64()))],
                names=["doc_id", "quality", "slots", "x"],
            )

    found = texts.mapInArrow(run, "doc_id long, quality int, slots array<long>, x array<double>").toArrow()
    slots, x = found.column("slots").combine_chunks(), found.column("x").combine_chunks()
    cut = slots.offsets.to_numpy()[1:-1]
    own = list(zip(np.split(slots.values.to_numpy(), cut), np.split(x.values.to_numpy(), cut), strict=True)) if len(found) else []
    ids, quality = found.column("doc_id").to_numpy(), found.column("quality").to_numpy()
    order = np.argsort(ids, kind="stable")  # rows arrive in any order
    return FactorisationMachine.fit([own[i] for i in order], quality[order].astype(np.float64))


def score(docs: DataFrame, model: FactorisationMachine, keep: bool = False) -> DataFrame:
    """doc_id and score of each row; with ``keep`` all columns of ``docs``, then the score (whatever they are called)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # WIDTH * (RANK + 1) floats
    used = docs if keep else docs.select(F.col("doc_id").cast("long"), "text")
    text = [c.lower() for c in used.columns].index("text")

    def run(batches):
        machine = shared.value
        for batch in batches:
            for part in slices(batch):
                found = machine.scores([features(x) for x in part.column(text).to_pylist()])
                columns = [*(part.columns if keep else part.columns[:1]), pa.array(found, type=pa.float64())]
                yield pa.record_batch(columns, names=[f"c{i}" for i in range(len(columns))])

    kinds = [f.dataType.simpleString() for f in used.schema][: None if keep else 1] + ["double"]
    plain = used.toDF(*[f"c{i}" for i in range(len(used.columns))])
    scored = plain.mapInArrow(run, ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds)))
    return scored if keep else scored.toDF("doc_id", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``labels`` doesn't reject, all columns kept."""
    scored = score(docs, train(docs, labels, sample), keep=True)
    return scored.filter(F.col(scored.columns[-1]) >= threshold).drop(scored.columns[-1]).toDF(*docs.columns)
