"""The stages against what they should keep, one after the other."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import pytest
import test_native
import test_text_operators

from feedloom.llm import langid

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_return_columns_of_documents(steps):
    for _, before, after in steps[:-1]:
        assert after.dtypes == before.dtypes
    assert set(steps[0][1].columns) < set(steps[-1][2].columns)


def test_language_stage_keeps_known_languages(spark, steps):
    _, before, after = steps[0]
    found = langid.predict(before, langid.train(before)).collect()
    want = {r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LIKENESS}
    assert {r.doc_id for r in after.collect()} == want
    assert len(want) >= 0.95 * before.count()


def test_near_duplicate_stage(steps):
    _, before, after = steps[1]
    want = test_text_operators.brute_components([(r.doc_id, r.text) for r in before.collect()], 80)
    assert {r.doc_id for r in after.collect()} == {i for i, x in want.items() if x[2]}


def test_decontamination_stage(spark, steps):
    _, before, after = steps[2]
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    found = test_native.brute_contamination([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in items])
    assert {r.doc_id for r in after.collect()} == {r[0] for r in found if not r[5]}


def test_secret_stage_masks_and_keeps_every_document(steps):
    _, before, after = steps[3]
    old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
    assert old.keys() == new.keys()
    for i, r in old.items():
        spans = test_native.base_spans(r.text)
        assert (r.text != new[i].text) or not spans
        assert all(r.text[a:b] not in new[i].text or b - a < 12 for a, _, b in spans)
        assert new[i].n_chars == len(new[i].text)


def test_mix_stage(steps):
    _, before, after = steps[4]
    size = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text)) for r in before.collect()}
    rows = after.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.copies <= 3 and r.taken == r.copies * size[r.doc_id] for r in rows)
    by = {}
    for r in rows:
        x = by.setdefault(r.source, [0, r.target, 0])
        x[0], x[2] = x[0] + r.taken, max(x[2], size[r.doc_id])
    largest = {}
    for r in before.collect():
        largest[r.source] = max(largest.get(r.source, 0), size[r.doc_id])
    assert all(abs(x[0] - x[1]) <= largest[s] for s, x in by.items())


def test_run_gives_the_same_rows(spark, steps):
    def digest(df):
        return sorted(hashlib.md5(str(tuple(r)).encode()).hexdigest() for r in df.collect())

    assert digest(corpus_pipeline.run(spark, SF_DIR)) == digest(steps[-1][2])


def test_odd_and_empty_documents(spark, odd_rows, no_rows):
    for docs in (odd_rows, no_rows):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF_DIR)
            assert after.count() <= n and set(docs.columns) <= set(after.columns)
