from math import isclose

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import language
from veritab.llm.vocabulary import load


@pytest.fixture(scope="module")
def model(documents):
    return language.train(documents.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), per_language=40)


def all_segmentations(model, pieces, word):
    """Summed probability over every way to cut ``word``, by listing them."""
    if not word:
        return np.ones(len(model.languages))
    total = np.zeros(len(model.languages))
    for n in range(1, len(word) + 1):
        row = pieces.get(word[:n], model.trie.unknown if n == 1 else 0)
        if row:
            total += np.exp(model.weights[row]) * all_segmentations(model, pieces, word[n:])
    return total


@pytest.fixture(scope="module")
def piece_rows():
    usable = [p for p in dict.fromkeys(load().pieces) if p and p == p.lower()]
    usable = [p for p in usable if not p.removeprefix("▁") or language.LETTERS.fullmatch(p.removeprefix("▁"))]
    return {p: k for k, p in enumerate(usable, 1)}


def test_forward_sums_all_segmentations(model, piece_rows):
    words = ["▁the", "▁éelle", "▁x", "▁schkeit", "▁漢字a", "▁", "▁ŋŋ"]
    got = language.log_likelihoods(model, words)
    for word, logs in zip(words, got):
        assert np.allclose(logs, np.log(all_segmentations(model, piece_rows, word)))


def test_probabilities_sum_to_one(model):
    assert np.allclose(np.exp(model.weights[1:-1]).sum(0), 1)


def test_expected_counts_cover_every_letter(model, piece_rows):
    words = ["▁the", "▁andthe"]
    uses = language.expected(model, words, np.ones((2, len(model.languages))))
    lengths = np.array([0, *map(len, piece_rows), 1])
    assert np.allclose((uses * lengths[:, None]).sum(0), sum(map(len, words)))


def test_held_out_accuracy(documents, model):
    told = language.identify(documents.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2), model)
    assert told.where("lang = lang_pred").count() >= 0.95 * told.count()


def test_odd_rows(odd_documents, no_documents, model):
    told = language.identify(odd_documents, model)
    assert {"lang_pred", "score", "score_"} <= set(told.columns)
    rows = told.collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered)
        assert 0 <= r.score_ <= 1
    assert language.identify(no_documents, model).count() == 0


def test_no_labels_means_undetermined(odd_documents, no_documents):
    model = language.train(no_documents)
    assert {r.lang_pred for r in language.identify(odd_documents, model).collect()} == {"und"}


def test_very_long_run_stays_finite(model):
    scores = language.log_likelihoods(model, language.runs("漢" * 5000) + language.runs("e" * 5000))
    assert np.isfinite(scores).all()


def test_score_is_the_posterior(model):
    names, scores = language.Scorer(model).predict(["the", None, "12"])
    total = language.log_likelihoods(model, ["▁the"])[0]
    assert isclose(scores[0], np.exp(total.max()) / np.exp(total).sum(), rel_tol=1e-9)
    assert names[1:] == ["und", "und"]
