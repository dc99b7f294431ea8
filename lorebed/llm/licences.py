"""Licence scan: a trained paragraph classifier with an unknown class, confirmed by comparison with templates.

Words give sparse n-grams: runs of 1 to 3 words, and runs in which a word that only licence names have is put as "a name", so
that "released under the <name> license" is learnt once for all of them. A logistic regression for each family, and one for
``unknown`` (no licence), gives probabilities; so a paragraph may hold several families ("under MIT or Apache-2.0"). They are
trained here on names in notices, passages of licences, and texts that are none, among them windows of the corpus itself; a
temperature fitted on forms of notices that aren't learnt from calibrates all of them.

Paragraphs end at blank lines, so notices that are wrapped over lines stay whole. A paragraph is scored in overlapping windows
of ``WINDOW`` words, every one of them; a family is reported where it is likely in a window and in the same window widened (so
that no part of "Lesser General Public License" passes for GPL), no licence is unlikely there, and the widened window
has the words of one of the family's templates. Of a paragraph's windows the surest counts.

Nulls and other cases: a null or empty text has no licence (family null, 0 found, no paragraph); null doc_ids and
repeated rows are scanned like others; of equally likely paragraphs the first is reported; an empty table gives no rows;
further columns of the input are ignored. Paragraphs and texts of any length are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drawn
from .licence_texts import CALIBRATING, DUAL, FORMS, NAMES, OTHER, PASSAGES, TALK
from .tokens import slices

UNKNOWN = "unknown"
WINDOW, STEP, AROUND = 16, 4, 8  # words in a window, between windows, and added on each side of a likely one
SAMPLE, EACH = 400, 5  # documents of the corpus that negatives are taken from, and windows of each

#: Words that only names of licences have (fixed values).
MARKS = (
    "mit", "expat", "x11", "apache", "asl", "bsd", "isc", "zlib", "libpng", "gnu", "gpl", "gplv2", "gplv3", "lgpl", "lgplv3", "agpl",
    "agplv3", "affero", "gfdl", "fdl", "mozilla", "mpl", "eclipse", "epl", "eupl", "boost", "bsl", "unlicense", "cc", "cc0", "creative",
)
_TOKEN = re.compile(r"[^\W\d_]+\d*|\d+(?:\.\d+)*")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass(frozen=True)
class Vocabulary:
    """Words and n-grams by number; a word of no n-gram is 0."""

    words: dict[str, int]
    marks: np.ndarray  # whether a word is one that only names have
    name: int  # the number that stands for those
    grams: np.ndarray  # ascending

    @classmethod
    def of(cls, texts: list[list[str]], least: int = 2) -> Vocabulary:
        """Of the n-grams that at least ``least`` texts have."""
        words = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}), 2)}
        marks = np.zeros(len(words) + 2, dtype=bool)
        marks[[words[m] for m in MARKS if m in words]] = True
        whole = cls(words, marks, 1, np.zeros(0, dtype=np.int64))
        found = np.concatenate([np.unique(whole.keys(whole.numbers(t))[1]) for t in texts])
        grams, times = np.unique(found, return_counts=True)
        return cls(words, marks, 1, grams[times >= least])

    def numbers(self, tokens: list[str]) -> np.ndarray:
        get = self.words.get
        return np.fromiter((get(t, 0) for t in tokens), dtype=np.int64, count=len(tokens))

    def keys(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of known words start, ascending, and their keys."""
        base = len(self.words) + 2
        padded = np.concatenate((w, np.zeros(2, dtype=np.int64)))
        masked = np.where(self.marks[padded], self.name, padded)
        at = np.flatnonzero(w)
        out = []
        for put in (padded, masked):
            a, b, c = put[at], put[at + 1], put[at + 2]
            two, three = b > 0, (b > 0) & (c > 0)
            if put is masked:  # only what has a name and another word in it
                names = (a == self.name).astype(int) + (b == self.name)
                two &= names == 1
                names += c == self.name
                three &= (names > 0) & (names < 3)
            else:
                out.append((at, a))
            out += [(at[two], a[two] + base * b[two]), (at[three], a[three] + base * (b[three] + base * c[three]))]
        places, keys = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(places, kind="stable")
        return places[order], keys[order]

    def features(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of the vocabulary start, ascending, and their slots."""
        places, keys = self.keys(w)
        if not len(self.grams) or not len(keys):
            return places[:0], keys[:0]
        slots = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        known = self.grams[slots] == keys
        return places[known], slots[known]


def _regress(rows: list[np.ndarray], goal: np.ndarray, n_slots: int, rounds: int, rate: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions, one a column of ``goal``, by AdaGrad. Weights and biases."""
    rng = np.random.default_rng(seed)
    n = goal.shape[1]
    w, b = np.zeros((n_slots, n)), np.log((goal.mean(axis=0) + 1e-3) / (1 - goal.mean(axis=0)))
    square_w, square_b = np.full((n_slots, n), 1e-4), np.full(n, 1e-4)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            sizes = np.array([len(rows[i]) for i in part])
            part, sizes = part[sizes > 0], sizes[sizes > 0]
            slots = np.concatenate([rows[i] for i in part])
            starts = np.cumsum(sizes) - sizes
            z = b + np.add.reduceat(w[slots], starts)
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal[part]) / len(part)
            order = np.argsort(slots, kind="stable")
            used, first = np.unique(slots[order], return_index=True)
            step = np.add.reduceat(np.repeat(miss, sizes, axis=0)[order], first) + 1e-6 * w[used]
            square_w[used] += step * step
            w[used] -= rate * step / np.sqrt(square_w[used])
            step = miss.sum(axis=0)
            square_b += step * step
            b -= rate * step / np.sqrt(square_b)
    return w, b


@dataclass(frozen=True)
class Model:
    families: list[str]  # the last is ``unknown``
    vocabulary: Vocabulary
    weights: np.ndarray  # n-grams x families
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[tuple[frozenset, bool]]]  # words and pairs of words; whether of a passage

    def logits(self, w: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each window from ``starts`` to ``ends`` over the word numbers ``w``: families' logits, not calibrated."""
        places, slots = self.vocabulary.features(w)
        sums = np.concatenate((np.zeros((1, len(self.families))), np.cumsum(self.weights[slots], axis=0)))
        a, b = np.searchsorted(places, starts), np.searchsorted(places, ends)
        return self.bias + sums[b] - sums[a]

    def probabilities(self, tokens: list[str]) -> dict[str, float]:
        """Of a text as one window."""
        z = self.logits(self.vocabulary.numbers(tokens), np.array([0]), np.array([len(tokens)]))[0]
        return dict(zip(self.families, 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30))), strict=True))

    def likely(self, z: np.ndarray, sure: float) -> np.ndarray:
        """Probabilities of the families, 0 where they are not ``sure`` or no licence is as likely as not."""
        p = 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))
        return np.where((p[:, :-1] >= sure) & (p[:, -1:] < 0.5), p[:, :-1], 0.0)

    def similarity(self, family: str, tokens: list[str]) -> float:
        """How much of a template the words hold; of a passage, how much of the words or of the passage, whichever is the shorter."""
        own = _pairs(tokens)
        return max((len(t & own) / max(1, min(len(t), len(own)) if passage else len(t)) for t, passage in self.templates.get(family, ())), default=0.0)


def _pairs(tokens: list[str]) -> frozenset:
    return frozenset(tokens) | frozenset(zip(tokens, tokens[1:], strict=False))


def _windows(tokens: list[str]) -> list[list[str]]:
    return [tokens[i : i + WINDOW] for i in range(0, max(1, len(tokens) - WINDOW + STEP), STEP)]


def examples(forms: list[str], seed: int = 42, passages: bool = True, fold: int = 0) -> list[tuple[frozenset[str], list[str]]]:
    """(families, words): names in ``forms``, alone and among other words; passages in windows; texts without a licence.

    Of the latter, ``fold`` 0 gives two thirds and 1 the others.
    """
    rng = np.random.default_rng(seed)
    other = [words_of(x) for x in OTHER]
    families = list(NAMES)
    pick = lambda: str(rng.choice(NAMES[families[rng.integers(len(families))]]))
    filled = lambda form: form.format(pick(), pick()) if form.count("{}") == 2 else form.format(pick())

    def among(tokens: list[str]) -> list[str]:
        before, after = other[rng.integers(len(other))], other[rng.integers(len(other))]
        return before[len(before) - rng.integers(0, 8) :] + tokens + after[: rng.integers(0, 8)]

    out = []
    for family, names in NAMES.items():
        for k, name in enumerate(names):
            for j, form in enumerate(forms):
                tokens = words_of(form.format(name))
                out.append((frozenset({family}), among(tokens) if (k + j) % 2 else tokens))
                if len(words_of(name)) == 1 and passages:  # a single word has the context alone
                    out.append((frozenset({family}), tokens if (k + j) % 2 else among(tokens)))
    both = [*DUAL, *(form.replace("{}", "{}" + join + "{}") for form in forms for join in (" or ", " and the "))]
    for form in both * 20 if passages else ():
        two = rng.choice(len(families), 2, replace=False)
        out.append((frozenset(families[i] for i in two), words_of(form.format(*(rng.choice(NAMES[families[i]]) for i in two)))))
    for family, texts in PASSAGES.items() if passages else ():
        for tokens in map(words_of, texts):
            cut = [x for x in _windows(tokens) if len(x) > 4 or len(tokens) <= 4] + [tokens]
            out += [(frozenset({family}), x) for x in cut * 2] + [(frozenset({family}), among(tokens)) for _ in range(6) if len(tokens) < WINDOW]
    none = [x for tokens in other for x in [tokens, *_windows(tokens)]]
    none += [words_of(filled(form)) for form in TALK for _ in range(40)]
    none += [among(tokens[i : i + 5]) for tokens in other for i in range(0, len(tokens), 5)]
    none += [[m] for m in MARKS] * 6
    out += [(frozenset({UNKNOWN}), x) for i, x in enumerate(none) if (i % 3 == 2) == (fold == 1)]
    return out


def train(corpus: tuple[str, ...] = (), rounds: int = 16, rate: float = 0.2) -> Model:
    """Fit on the examples and on windows of ``corpus`` in which a first fit sees no licence; calibrate on other forms and texts."""
    rows = examples(FORMS)
    families = [*dict.fromkeys([*NAMES, *PASSAGES]), UNKNOWN]
    templates = {f: [(_pairs(words_of(n)), False) for n in names] for f, names in NAMES.items()}
    for family, texts in PASSAGES.items():
        templates[family] = templates.get(family, []) + [(_pairs(words_of(t)), True) for t in texts]

    def fitted(rows):
        vocabulary = Vocabulary.of([t for _, t in rows])
        goal = np.array([[f in own for f in families] for own, _ in rows], dtype=np.float64)
        w, b = _regress([vocabulary.features(vocabulary.numbers(t))[1] for _, t in rows], goal, len(vocabulary.grams), rounds, rate)
        return Model(families, vocabulary, w, b, 1.0, templates)

    model = fitted(rows)
    if corpus:
        cut = [x for x in map(words_of, corpus) if any(w in model.vocabulary.words for w in x)]
        if cut:
            clean = [x for x, found in zip(cut, scan_texts([" ".join(x) for x in cut], model), strict=True) if not found]
            model = fitted(rows + [(frozenset({UNKNOWN}), x) for x in clean])
    held = examples(CALIBRATING, seed=7, passages=False, fold=1)
    goal = np.array([[f in own for f in families] for own, _ in held])
    z = np.concatenate([model.logits(model.vocabulary.numbers(t), np.array([0]), np.array([len(t)])) for _, t in held])

    def loss(t):
        return np.logaddexp(0, np.where(goal, -z, z) / t).mean()

    return Model(families, model.vocabulary, model.weights, model.bias, min((k / 20 for k in range(4, 81)), key=loss), templates)


@cache
def model() -> Model:
    """Without a corpus's own negatives."""
    return train()


def fit(docs: DataFrame, sample: int = SAMPLE, each: int = EACH) -> Model:
    """A model whose negatives are also of ``docs``: ``each`` windows, evenly over the whole text, of ``sample`` different texts drawn by a hash."""

    def cut(batches):
        for batch in batches:
            texts = []
            for text in batch.column(0).to_pylist():
                tokens = _TOKEN.findall(text.lower())
                texts += [" ".join(tokens[i : i + WINDOW]) for i in range(0, len(tokens), max(WINDOW, -(-len(tokens) // each)))]
            yield pa.record_batch([pa.array(texts, type=pa.string())], names=["text"])

    h = F.xxhash64("text")
    chosen = drawn(docs.select("text"), h, 8 * sample).filter("text <> ''").distinct().orderBy(h, "text").limit(sample)
    return train(tuple(r.text for r in chosen.mapInArrow(cut, "text string").orderBy("text").collect()))


Found = tuple[int, str, float, float, int]  # paragraph, family, probability, similarity, line


def scan_texts(texts: list[str | None], m: Model, sure: float = 0.5, alike: float = 0.75, at_once: int = 1 << 16) -> list[list[Found]]:
    """The licences of each text: one row a paragraph and family, with the line where its surest window starts."""
    tokens: list[str] = []
    bounds, owner = [], []  # of each paragraph: its words among all, its text and number
    for i, text in enumerate(texts):
        for k, part in enumerate(_BLANK.split((text or "").lower())):
            own = _TOKEN.findall(part)
            if own:
                bounds.append((len(tokens), len(tokens) + len(own)))
                owner.append((i, k))
                tokens += own
                tokens += ("", "")  # so that no n-gram passes from one paragraph to the next
    out: list[dict[tuple[int, str], Found]] = [{} for _ in texts]
    if not bounds:
        return [[] for _ in texts]
    w = m.vocabulary.numbers(tokens)
    first, last = np.array(bounds).T
    n = np.maximum(1, -(-(last - first - WINDOW) // STEP) + 1)
    of = np.repeat(np.arange(len(n)), n)
    starts = first[of] + STEP * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    for at in range(0, len(of), at_once):
        p, a = of[at : at + at_once], starts[at : at + at_once]
        b = np.minimum(a + WINDOW, last[p])
        low, high = int(a[0]), int(b.max())
        near = m.likely(m.logits(w[low : high + 2], a - low, b - low), sure)  # two words on, as n-grams of the last word go
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            continue
        wide_a, wide_b = np.maximum(a[hit] - AROUND, first[p[hit]]), np.minimum(b[hit] + AROUND, last[p[hit]])
        low, high = int(wide_a.min()), int(wide_b.max())
        both = np.minimum(near[hit], m.likely(m.logits(w[low : high + 2], wide_a - low, wide_b - low), sure))
        for j, f in zip(*np.nonzero(both), strict=True):
            (i, k), family, sureness = owner[p[hit[j]]], m.families[f], round(float(both[j, f]), 6)
            known = out[i].get((k, family))
            if known and known[2] >= sureness:
                continue
            similarity = m.similarity(family, tokens[wide_a[j] : wide_b[j]])
            if similarity >= alike:
                out[i][k, family] = (k, family, sureness, similarity, int(a[hit[j]] - first[p[hit[j]]]))
    return [[(*x[:4], _line(text, x[0], x[4])) for x in sorted(found.values())] for text, found in zip(texts, out, strict=True)]


def _line(text: str, paragraph: int, word: int) -> int:
    """The line of a text in which a paragraph's ``word`` stands."""
    low = text.lower()
    begin = 0
    for k, gap in enumerate(_BLANK.finditer(low)):
        if k == paragraph:
            break
        begin = gap.end()
    for k, token in enumerate(_TOKEN.finditer(low, begin)):
        if k == word:
            return low.count("\n", 0, token.start())
    return 0


OUT = "doc_id long, family string, probability double, similarity double, paragraph int, line int, families array<string>, n_found int"


def scan(docs: DataFrame, sure: float = 0.5, alike: float = 0.75, fitted: Model | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the surest licence and where it is, all families found, and in how many paragraphs."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(fitted or fit(docs))  # some ten thousand n-grams; grows with the examples, not the data
    types = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32()]
    names = ["doc_id", "family", "probability", "similarity", "paragraph", "line", "families", "n_found"]

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for doc_id, found in zip(part.column(0).to_pylist(), scan_texts(part.column(1).to_pylist(), m, sure, alike), strict=True):
                    k, family, p, s, line = max(found, key=lambda x: (round(x[2], 6), -x[0])) if found else (None,) * 5
                    rows.append((doc_id, family, p, s, k, line, sorted({x[1] for x in found}), len({x[0] for x in found})))
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)
