"""Each pipeline stage on its own input, against plain Python."""

import re

import numpy as np
import pytest

import corpus_pipeline
from isoloom.llm import quality_pu
from isoloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_drops_what_the_classifier_rejects(spark, docs):
    got = STAGE["quality"](spark, docs, SF)
    m = quality_pu.fit(docs, table(spark, SF, "labels"))
    good = {r.doc_id for r in quality_pu.score(docs, m).where("predicted = 1").collect()}
    assert got.columns == docs.columns and rows(got) == rows(docs.where(docs.doc_id.isin(*good)))


def test_near_copies_leave_one_of_each_group(spark, docs):
    got = STAGE["near_dups"](spark, docs, SF)
    sets = {}
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {k for k in sets if find(k) == k}


def test_secrets_are_gone_and_other_rows_untouched(spark, docs):
    got = {r.doc_id: r for r in STAGE["secrets"](spark, docs, SF).collect()}
    old = {r.doc_id: r for r in docs.collect()}
    assert set(got) == set(old)
    for k, r in got.items():
        assert not re.search("[0-9a-f]{24}", r.text) and r.n_chars == len(r.text)
        assert r.text == old[k].text or "<SECRET>" in r.text


def test_mixing_repeats_rows_up_to_twice(spark, docs):
    got = STAGE["mixing"](spark, docs, SF)
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    times = {}
    for r in got.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert got.columns == docs.columns and max(times.values()) <= 2
    assert sum(size[k] * n for k, n in times.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.01)


def test_tokens_match_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in STAGE["tokens"](spark, docs, SF).collect():
        assert r.ids == t.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_empty_table_passes_through(spark, docs):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, SF)
        assert got.count() == 0
        if name != "tokens":
            assert got.columns == docs.columns
