from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm import pieces
from veritab.llm.vocabulary import load


@pytest.fixture(scope="module")
def sampler():
    return pieces.Sampler(load())


@pytest.fixture(scope="module")
def decoder():
    return pieces.Decoder(load())


def test_round_trip_of_any_text(sampler, decoder):
    @settings(max_examples=150, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
    def check(text):
        ids = sampler.encode([text], np.array([7]), 1)[0]
        assert decoder.decode(ids.tolist()) == text

    check()


def test_batch_and_cache_do_not_matter(sampler):
    texts = ["The cat sat on the mat.", "", "an other text", "The cat sat on the mat."]
    keys = np.array([1, 2, 3, 4])
    together = sampler.encode(texts, keys, 1)
    alone = [pieces.Sampler(load()).encode([t], keys[k : k + 1], 1)[0] for k, t in enumerate(texts)]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))
    other_seed = sampler.encode(texts, keys, 2)
    assert not all(np.array_equal(a, b) for a, b in zip(together, other_seed))


def all_paths(sampler, unit):
    if not unit:
        return {(): 1.0}
    found = {}
    for n in range(1, len(unit) + 1):
        if (i := sampler.ids.get(unit[:n])) is not None:
            for rest, w in all_paths(sampler, unit[n:]).items():
                found[(i, *rest)] = w / (i + 100)
    return found


def test_sampled_shares_are_those_of_the_lattice(sampler):
    paths = all_paths(sampler, " then")
    total = sum(paths.values())
    drawn = Counter(tuple(x.tolist()) for x in sampler.encode(["then"] * 20_000, np.arange(20_000), 5))
    assert set(drawn) <= set(paths)
    for path, weight in paths.items():
        assert abs(drawn[path] / 20_000 - weight / total) < 0.015


def test_very_long_unit(sampler, decoder):
    text = "ab" * 40_000
    ids = sampler.encode([text], np.array([3]), 1)[0]
    assert decoder.decode(ids.tolist()) == text


def test_spark_round_trip(odd_documents, no_documents, documents):
    for table in (odd_documents, documents):
        rows = pieces.decode(pieces.encode(table)).collect()
        assert len(rows) == table.count()
        assert all(r.decoded == r.text for r in rows)
        assert all((r.piece_ids is None) == (r.text is None) for r in rows)
    assert pieces.encode(no_documents).count() == 0


def test_reruns_agree(documents):
    first = {r.doc_id: r.piece_ids for r in pieces.encode(documents).collect()}
    again = {r.doc_id: r.piece_ids for r in pieces.encode(documents.repartition(5)).collect()}
    assert first == again


def test_draws_step_through_the_candidates_of_a_state():
    """Cumulated probabilities start anew in each state, whatever is held: they had the state's number added before."""
    sampler = pieces.Sampler(load())
    texts = ["the unseen 世\U0001f642 words", None, "", "\U0001f642", "the unseen words of others"]
    keys = np.arange(len(texts))
    got = sampler.encode(texts, keys, 1)
    assert sampler.top.max() == 1.0
    assert got[1] is None and len(got[2]) == 0
    decoder = pieces.Decoder(load())
    assert [decoder.decode(ids.tolist()) for ids in got if ids is not None] == [t for t in texts if t is not None]
    for text, key, ids in zip(texts, keys, got):
        alone = pieces.Sampler(load()).encode([text], np.array([key]), 1)[0]
        assert ids is None if text is None else ids.tolist() == alone.tolist()
