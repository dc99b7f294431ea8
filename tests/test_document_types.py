"""The rule classifier's shortcuts against a plain reading of its table."""

import random
import re

import pyarrow.parquet as pq
import pytest

from lorebed.operators import document_types as dt


def plain_score(signal, texts):
    where = ("content", "title") if signal.where == "either" else (signal.where,)
    patterns = [re.compile(p) for p in signal.patterns]
    if signal.count == "matches":
        n = sum(len(list(p.finditer(texts[w]))) for p in patterns for w in where)
    else:
        n = sum(any(p.search(texts[w]) for w in where) for p in patterns)
    return next((score for least, score in signal.steps if n >= least), 0.0)


def texts_of_signals(seed):
    """Texts of words, marks and numbers that the patterns ask for."""
    rnd = random.Random(seed)
    words = sorted({w for s in dt.SIGNALS + dt.PENALTIES for p in s.patterns for w in re.findall(r"[A-Za-z]{2,}", p)})
    marks = [":", ". ", "\n", "\n\n", "|", "[1]", "(Smith et al., 2019)", "1. ", "2) ", "$5", "10 kw", "p < 0.05", "[ ]", "q: ", "? \nA", "\t\t", " a ", "March 3, 2020", "How to "]
    return ["".join(rnd.choice([rnd.choice(words) + " ", rnd.choice(marks)]) for _ in range(rnd.randint(30, 300))) for _ in range(60)]


@pytest.mark.parametrize("seed", range(3))
def test_scores_equal_a_plain_reading(seed):
    made = texts_of_signals(seed)
    for text, title in zip(made, made[1:], strict=False):
        texts = {"raw": text, "content": text.lower(), "title": title[:60].lower(), "url": ""}
        for signal in dt.SIGNALS + dt.PENALTIES:
            assert dt._score(signal, texts) == plain_score(signal, texts), (signal.name, text)


def test_scores_equal_a_plain_reading_on_documents(small):
    for text in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist():
        texts = {"raw": text or "", "content": (text or "").lower(), "title": (text or "")[:80].lower(), "url": ""}
        assert [dt._score(s, texts) for s in dt.SIGNALS] == [plain_score(s, texts) for s in dt.SIGNALS]
