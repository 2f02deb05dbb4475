from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import DATA
from tests.llm.test_neardup import brute
from tests.llm.test_secretscan import brute as base_spans
from veritab.llm import mixing, pieces
from veritab.llm.vocabulary import load
from veritab.session import durable


@pytest.fixture(scope="module")
def outputs(spark, documents):
    """What each stage returns, starting from documents with some that must go."""
    extra = spark.createDataFrame(
        [(10_001, "12345 !!", None, "src1", 8), (10_002, None, "en", "src1", None), (10_003, "", "en", None, 0)],
        documents.schema,
    )
    docs = durable(documents.unionByName(extra).unionByName(documents.limit(5)))
    found = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = durable(stage(spark, docs, DATA))
    return found


def rows(df):
    return df.collect()


def test_each_stage_but_the_last_keeps_the_columns(outputs):
    names = ["input", *(name for name, _ in corpus_pipeline.STAGES)]
    for name in names[:-1]:
        assert outputs[name].columns == outputs["input"].columns


def test_language_rejects_what_has_none_and_keeps_the_rest(outputs):
    kept = Counter(r.doc_id for r in rows(outputs["language_id"]))
    assert not {10_001, 10_002, 10_003} & set(kept)
    assert sum(kept.values()) == outputs["input"].count() - 3


def test_one_document_of_each_group_stays(outputs):
    before = {r.doc_id: r.text for r in rows(outputs["language_id"])}
    component = brute(sorted(before.items()), corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    kept = Counter(r.doc_id for r in rows(outputs["near_dedup"]))
    assert set(kept.values()) == {1}
    assert set(kept) == {k for k, c in component.items() if k == c}


def test_secrets_are_gone(outputs):
    before = {r.doc_id: r.text for r in rows(outputs["near_dedup"])}
    for r in rows(outputs["secret_scan"]):
        assert not base_spans(r.text)
        assert r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "<SECRET>" in r.text


def test_copies_are_those_of_the_mix(outputs):
    allocated = {r.key: r.copies for r in rows(mixing.allocate(outputs["secret_scan"]))}
    assert Counter(r.doc_id for r in rows(outputs["mixing"])) == Counter({k: n for k, n in allocated.items() if n})


def test_pieces_decode_to_the_texts(outputs):
    decoder = pieces.Decoder(load())
    texts = {r.doc_id: r.text for r in rows(outputs["mixing"])}
    final = rows(outputs["sentencepiece"])
    assert len(final) == outputs["mixing"].count()
    for r in final:
        assert decoder.decode(r.piece_ids) == texts[r.doc_id] and r.n_pieces == len(r.piece_ids)
