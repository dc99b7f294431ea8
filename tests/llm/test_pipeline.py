"""The pipeline against a plain version of each stage on what the stage before it kept."""

import re

import corpus_pipeline
import pytest

from lorebed.llm import mixing, packing, quality
from lorebed.llm.tokens import default_vocabulary
from lorebed.sources.tables import table


@pytest.fixture(scope="module")
def stages(spark, small):
    from lorebed.llm.common import durable

    docs, kept = table(spark, small, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, small), name)
        kept.append(docs)
    return kept


def test_order_and_columns(spark, small, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    columns = table(spark, small, "documents").columns
    assert all(s.columns == columns for s in stages[:-1])


def test_classifier_rejects_what_it_scores_low(spark, small, stages):
    docs = table(spark, small, "documents")
    model = quality.train(docs, table(spark, small, "labels"))
    want = {r.doc_id for r in docs.collect() if model.scores([quality.features(r.text)])[0] >= 0.5}
    assert {r.doc_id for r in stages[0].collect()} == want


def test_one_of_each_group_stays(stages):
    """Exact copies and all whose shingles are alike by 0.9 leave one row; a row that goes is like one that stays or goes."""
    rows = {r.doc_id: r.text for r in stages[0].collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    shingles = {}
    for i, text in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    like = {i: [] for i in rows}
    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            alike = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
            if alike >= 0.5:
                like[a].append((b, alike))
                like[b].append((a, alike))
    assert not any(alike >= 0.9 and i in kept and j in kept for i in ids for j, alike in like[i])
    assert all(like[i] for i in ids if i not in kept)
    assert all(i in kept for i in ids if not like[i] or all(j > i for j, _ in like[i]))


def test_rows_are_repeated_as_mixed(stages):
    want = {r.doc_id: r.repeats for r in mixing.mix(stages[1]).collect() if r.repeats}
    got = {}
    for r in stages[2].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_all_that_is_left_is_packed(stages):
    pieces = stages[3].collect()
    again = packing.pack(stages[2], default_vocabulary()).collect()
    key = lambda p: (p.doc_id, p.piece, p.start, p.length, p.ids_crc32)
    assert sorted(map(key, pieces)) == sorted(map(key, again))
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 1024


def test_run_gives_the_last_stage(spark, small, stages):
    assert corpus_pipeline.run(spark, small).count() == stages[-1].count()


def written_tables(spark, make, tmp_path, rows, labels):
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows_and_clashing_columns_pass_through_all_stages(spark, make, odd_rows, tmp_path):
    good = " ".join(f"plain{i} words of a text" for i in range(40))
    rows = odd_rows + [(100 + i, f"{good} {i}" if i % 2 else "$$$ !!! ###", "ab"[i % 3 % 2]) for i in range(60)]
    labels = [(100 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, 1, 0), (2, None, 0)]
    sf_dir = written_tables(spark, make, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == make([]).columns, name
        assert {r.text for r in docs.collect()} <= {t for _, t, _ in rows}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert pieces and {p.doc_id for p in pieces} <= {i for i, _, _ in rows}
    assert sum(p.doc_id is not None and p.doc_id >= 100 for p in pieces)


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_empty_tables_pass_through(spark, make, tmp_path, rows):
    sf_dir = written_tables(spark, make, tmp_path, rows, [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
